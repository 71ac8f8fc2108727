"""Operator 4: sharding by sampled splitters.

Records are ordered by (hash of the text, document id, number of the row), so that equal texts stay together unless a
shard ends among them.  A sample of keys, each drawn with a chance that grows with its record's size, gives quantile
boundaries; they part the records into many more ranges than there are shards.  Exact sizes of the ranges, added up, say
where each begins; ranges that came out overfull are drawn from and divided, again and again until none is that has more
than one key.  The shards are then cut at equal shares of the bytes, through the range that a cut falls into.

Only DataFrame functions are used, and only keys and sizes are shuffled, not texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.llm.common import table, written

SHARDS = 24
RANGE_ROWS = 20_000  # of a range, about
MOST_RANGES = 1 << 14
OVERSAMPLING = 8  # sampled keys for each range
OVERFULL = 2.0  # times the mean bytes
FIRST, LAST = -(1 << 63), (1 << 63) - 1


Key = tuple[int, ...]


def keys_of(records: DataFrame) -> list[str]:
    """The columns that make up the key, in order; a number of the row, where there is one, tells repeated rows apart."""
    return [c for c in ("h", "id", "row") if c in records.columns]


def draw(records: DataFrame, n: int, total: float) -> list[Key]:
    """About ``n`` keys at most, drawn without replacement, the chance of a record growing with its size; in order.

    Every record gets the number -ln(u) / size, u from a hash of its key; the records with the least are the sample.
    ``total``, the sum of the sizes, says below which number about twice ``n`` records lie: only these are ordered.
    """
    keys = keys_of(records)
    u = (F.pmod(F.xxhash64(*keys, F.lit(7)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    numbered = records.select(*keys, (-F.log(u) / F.col("size")).alias("number")).filter(F.col("number") < F.lit((2.0 * n + 64) / max(total, 1e-9)))
    return sorted(tuple(r) for r in numbered.orderBy("number", *keys).limit(n).select(*keys).collect())


def quantiles(sample: list[Key], parts: int) -> list[Key]:
    """At most ``parts`` - 1 boundaries that part the sample evenly."""
    return sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []


def range_of(bounds: list[Key], keys: tuple[str, ...] | list[str] = ("h", "id")) -> Column:
    """The number of boundaries not above the key: a binary search in as many steps as that number has bits."""
    if not bounds:
        return F.lit(0)
    bits = len(bounds).bit_length()
    padded = bounds + [(LAST,) * len(keys)] * ((1 << bits) - len(bounds))
    columns = [F.split(F.lit(",".join(str(b[i]) for b in padded)), ",").cast("array<bigint>") for i in range(len(keys))]  # folded to constants
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])

    def step(acc: Column, size: Column) -> Column:
        not_above = F.lit(True)
        for column, key in reversed(list(zip(columns, keys))):
            at = F.get(column, acc + size - 1)
            not_above = (at < F.col(key)) | ((at == F.col(key)) & not_above)
        return F.when(not_above, acc + size).otherwise(acc)

    return F.least(F.aggregate(steps, F.lit(0), step), F.lit(len(bounds)))


def divided(records: DataFrame, rows: int) -> DataFrame:
    """``records`` (key columns, size, ...) with the column ``range``: ranges of the key in order, bounded in size.

    Ranges that come out over OVERFULL times the mean are drawn from again, each for itself, and divided, until none is
    left that has more than one key; the boundaries are then one longer list.  As ids and row numbers are part of the
    key, one text that very many records share is divided too.
    """
    keys = keys_of(records)
    parts = max(1, min(MOST_RANGES, rows, max(rows // RANGE_ROWS + 1, SHARDS * 4)))
    total = records.agg(F.sum("size")).first()[0] or 0
    bounds = quantiles(draw(records, parts * OVERSAMPLING, total), parts)
    mean = total / parts
    whole: set[Key] = set()  # the first keys of ranges that can't be divided
    while True:
        edges = [(FIRST,) * len(keys), *bounds]
        placed = records.withColumn("range", range_of(bounds, keys))
        several = reduce(lambda a, b: a | b, [F.min(k) < F.max(k) for k in keys])
        ranges = placed.groupBy("range").agg(F.sum("size").alias("size"), several.alias("several"))
        full = {r["range"]: r["size"] for r in ranges.filter((F.col("size") > F.lit(OVERFULL * mean)) & F.col("several")).collect() if edges[r["range"]] not in whole}
        if not full:
            return placed
        pieces = {r: int(n / mean) + 1 for r, n in full.items()}
        sample = draw(placed.filter(F.col("range").isin(list(full))), sum(pieces.values()) * OVERSAMPLING, sum(full.values()))
        more = set(bounds)
        for r in full:
            end = bounds[r] if r < len(bounds) else (LAST + 1,) * len(keys)
            own = [k for k in sample if edges[r] <= k < end]
            new = set(quantiles(own, pieces[r])) - more - {edges[r]}
            if not new:
                whole.add(edges[r])  # what was drawn is all one key, its first
            more |= new
        bounds = sorted(more)


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null); one row for each row of ``docs``.

    Size: UTF-8 bytes of the text (none if null) plus 8; the checksum of a null text is that of an empty one.  Shards
    are filled in order of (hash of the text, id); repeated rows take slots one after the other, in no stated order
    among themselves.  A shard's bytes differ from the mean by less than one record at each end; with fewer records
    than shards some shards are empty.  Other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    records = docs.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(body).cast("long") + 8).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("h"), F.coalesce(F.col(key).cast("long"), F.lit(FIRST)).alias("id"), F.monotonically_increasing_id().alias("row"))
    records = written(records, "records")  # from here on a row keeps its number
    rows, total = records.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    placed = divided(records, rows)

    # where each range begins, in bytes and in records
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, not records
    ranges = placed.groupBy("range").agg(F.sum("size").alias("range_size"), F.count("*").alias("range_rows"))
    ranges = ranges.select("range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("range_rows").over(before), F.lit(0)).alias("base_rows"))
    within = Window.partitionBy("range").orderBy("h", "id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumn("upto", F.sum("size").over(within)).withColumn("rank", F.row_number().over(Window.partitionBy("range").orderBy("h", "id", "row")))
    # the middle of a record says to which shard it belongs
    middle = F.col("base") + F.col("upto") - F.col("size") / 2
    cut = F.least(F.floor(middle * shards / F.lit(max(total, 1))).cast("int"), F.lit(shards - 1))
    spread = written(local.join(F.broadcast(ranges) if rows // RANGE_ROWS < MOST_RANGES else ranges, "range").select("doc_id", "size", "text_crc32", cut.alias("shard"), (F.col("base_rows") + F.col("rank") - 1).alias("place")), "placed")
    first = spread.groupBy("shard").agg(F.min("place").alias("first"))  # one row for each shard
    return spread.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, key: str = "doc_id") -> None:
    """Writes ``docs`` as one folder of Parquet files for each shard, in order of slot; ``key`` must be unique."""
    places = assigned.select(F.col("doc_id").alias("__key"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    rows = docs.join(places, docs[key] == places["__key"]).drop("__key")
    rows.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot").withColumnRenamed("__slot", "slot").write.partitionBy("__shard").parquet(path)


def op4_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``documents``: 24 shards."""
    return assign(table(spark, sf_dir, "documents"))
