import random

import numpy as np
import pytest

from readloom.llm import near_dedup
from readloom.llm.wordhash import Words, shingle_set
from tests.llm import brute


def compare(df, rows, n):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}
    assert got == brute.near(rows, n)
    assert all(r.kept == (r.doc_id == r.component_id) for r in df.collect())


def test_query(spark, sf, docs):
    compare(near_dedup.op10_near_dedup(spark, sf), docs, 2)


def test_chains_and_crowded_families(spark):
    r = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):  # edits that put many pairs just above and just below the threshold
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(60)] = f"v{r.randint(0, 12)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, t) for i, t in enumerate(["a", "A", "a b", "a b c d e", "a b c d e f", "", None])]
    for n in (2, 5):
        compare(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n_words=n), rows, n)


def families(r, n, width, edits, places):
    """Edits of one text that put many pairs just above and just below the threshold."""
    base = [f"w{i}" for i in range(width)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(width)] = f"v{r.randint(0, places)}"
        rows.append((5000 - i, " ".join(w)))
    return rows


@pytest.mark.parametrize("rows_at_once, bytes_at_once, broadcast, salt", [(4, 2000, 0, 3), (4, 1 << 20, 10**6, 256), (40, 8000, 0, 1)])
def test_many_small_blocks_and_no_broadcast(spark, monkeypatch, rows_at_once, bytes_at_once, broadcast, salt):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", rows_at_once)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", bytes_at_once)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(near_dedup, "SALT_PAIRS", salt)
    rows = families(random.Random(9), 120, 60, 6, 12)
    compare(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n_words=2), rows, 2)


def test_rows_sent_are_in_proportion_to_the_members(spark, monkeypatch):
    """A root's members: one large component and 40 others.  Only then is a group of blocks larger than its members."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 512)
    for n in (1000, 4000, 16000):
        members = spark.range(n).select(F.lit(0).alias("a"), "id", F.when(F.col("id") < 40, F.col("id")).otherwise(40).alias("component"))
        groups = near_dedup._block_groups(members, ["id"], F.lit(1), near_dedup.BLOCK_ROWS)
        sent = groups.count()
        assert n <= sent <= n + 40 * (n // 512 + 2)
        assert groups.groupBy("a", "x", "y").count().agg(F.max("count")).first()[0] <= 2 * 512 * 1.25
    alone = spark.range(3000).select(F.lit(0).alias("a"), "id", F.col("id").alias("component"))
    met = near_dedup._block_groups(alone, ["id"], F.lit(1), near_dedup.BLOCK_ROWS).select("x", "y", "id")
    assert met.alias("l").join(met.alias("r"), ["x", "y"]).select(F.col("l.id"), F.col("r.id")).distinct().count() == 3000 * 3000


def test_estimate_is_unbiased_for_large_and_small_sets():
    r = random.Random(1)
    for size in (6, 60, 2000):
        errors = []
        for _ in range(25):
            shared = [f"s{r.random()}" for _ in range(size * 2 // 3)]
            sets = [" ".join(shared + [f"o{r.random()}" for _ in range(size // 3)]) for _ in range(2)]
            doc, h = Words(sets, True).shingles(1)
            regs = near_dedup.sketch(doc, h, 2)
            a, b = (set(shingle_set(s, 1).tolist()) for s in sets)
            n = np.array([len(a)])
            errors.append(near_dedup.estimate(regs[:1], regs[1:], n, n)[0] - len(a & b) / len(a | b))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_odd_rows(odd):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd, n_words=2).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (8, 2, 8, True), (9, 2, 8, False), (None, 2, None, True), (None, 0, None, True)} <= got
    assert next(x for x in got if x[0] == 7)[2] == 6
    one = near_dedup.one_of_each(odd, n_words=2)
    assert one.columns == odd.columns
    assert sorted([r.doc_id for r in one.collect()], key=str) == sorted([1, 2, 3, 4, 6, 8, None, None, 11, 12], key=str)
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0
