import struct

import corpus_pipeline
from readloom.llm import pii
from tests.llm import brute, test_bpe


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = [tuple(r) for r in docs.collect()]
    columns = docs.columns
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "near_dedup", "decontamination", "personal_data", "byte_bpe"]

    def step(name, rows):
        out = steps[name](spark, spark.createDataFrame(rows, docs.schema), sf)
        assert out.columns == columns
        return sorted(tuple(r) for r in out.collect())

    now = now + [(10_001, "12 + 34 = 46", None, None, 12), (10_002, None, None, None, None)]
    now = step("language_id", now)
    assert [r[0] for r in now] == sorted(r[0] for r in docs.collect())
    comp = brute.near([r[:2] for r in now], 5)
    want = sorted(r for r in now if comp[r[0]][1] == r[0])
    now = step("near_dedup", now)
    assert now == want and len(now) < docs.count()
    bad = {r[0] for r in brute.contaminated([r[:2] for r in now], bench) if r[-1]}
    want = [r for r in now if r[0] not in bad]
    now = step("decontamination", now)
    assert now == want and bad
    want = [(i, u := pii.redact(t, pii.find(t)), *rest[:-1], len(u)) for i, t, *rest in now]
    now = step("personal_data", now)
    assert now == want and not [r for r in now if pii.find(r[1])]
    out = steps["byte_bpe"](spark, spark.createDataFrame(now, docs.schema), sf).collect()
    assert sorted((r.doc_id, list(struct.unpack(f"<{r.n_tokens}I", r.ids))) for r in out) == [(r[0], test_bpe.LIBRARY.encode_ordinary(r[1])) for r in now]
    assert {(r.doc_id, r.decoded_sha256) for r in out} == {(r[0], brute.sha(r[1])) for r in now}
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id").collect())) == sorted((r.doc_id,) for r in out)


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
        assert out.columns == (docs.columns if name != "byte_bpe" else ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])
