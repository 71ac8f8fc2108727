import zlib

from readloom.llm import sharding


def check(rows, out, shards=24):
    assert sorted([(r.doc_id, r.size, r.text_crc32) for r in out], key=str) == sorted([(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows], key=str)
    by = {}
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r)
    largest = max((r.size for r in out), default=0)
    mean = sum(r.size for r in out) / shards
    for shard, own in by.items():
        assert 0 <= shard < shards
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - mean) <= largest


def test_query(spark, sf, docs):
    check(docs, sharding.op4_splitter_shards(spark, sf).collect())


def test_odd_rows(odd, odd_rows):
    check(odd_rows, sharding.assign(odd).collect())
    assert sharding.assign(odd.limit(0)).count() == 0


def test_one_text_in_most_rows_is_divided(spark):
    rows = [(i, "same text") for i in range(5000)] + [(5000 + i, f"text {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, sharding.assign(df).collect())
    from pyspark.sql import functions as F

    records = df.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), (F.octet_length("text") + 8).cast("long").alias("size"))
    sizes = [r[1] for r in sharding.divided(records, len(rows)).groupBy("range").count().collect()]
    assert max(sizes) < 6 * sum(sizes) / len(sizes)


def test_written_shards(spark, tmp_path, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sharding.write_shards(df, sharding.assign(df, 4), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(docs) and back.select("__shard").distinct().count() == 4


def test_repeated_rows_are_divided(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(sharding, "RANGE_ROWS", 50)
    rows = [(None, "same text")] * 4000 + [(i, f"text {i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, sharding.assign(df).collect())
    records = df.select(F.lit(sharding.FIRST).alias("id"), F.xxhash64("text").alias("h"), (F.octet_length("text") + 8).cast("long").alias("size"), F.monotonically_increasing_id().alias("row")).cache()
    sizes = [r[0] for r in sharding.divided(records, len(rows)).groupBy("range").agg(F.sum("size")).collect()]
    assert max(sizes) <= sharding.OVERFULL * sum(sizes) / 121
    # without a number of the row, one key is one range, and the search for a boundary ends
    assert sharding.divided(records.drop("row"), len(rows)).groupBy("range").count().count() > 10


def test_few_large_records(spark):
    rows = [(i, "x" * (100_000 if i % 100 == 0 else 1)) for i in range(1000)]
    check(rows, sharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect())
