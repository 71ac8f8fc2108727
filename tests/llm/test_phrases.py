import random

import pytest

from readloom.llm import phrases
from tests.llm import brute


def test_query(spark, sf, docs):
    got = sorted(map(tuple, phrases.op2_phrase_dedup(spark, sf).collect()))
    assert got == sorted(brute.repeats(docs))


def made(seed):
    r = random.Random(seed)
    passages = [" ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(9, 40))) for _ in range(8)] + ["x " * 40, "p q " * 20]
    rows = []
    for i in range(60):
        parts = [r.choice(passages) if r.random() < 0.5 else " ".join(r.choice("abcdefghij") for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 5))]
        rows.append((r.randint(0, 50), "\n".join(parts)))
    return rows


def test_shared_passages_periods_and_repeated_ids(spark):
    for seed in range(3):
        rows = made(seed)
        got = phrases.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=False)
        assert sorted(map(tuple, got.collect())) == sorted(brute.repeats(rows))


@pytest.mark.parametrize("bound", [0, 10**6])
def test_a_passage_in_half_of_the_rows_many_shards_and_no_broadcast(spark, monkeypatch, bound):
    monkeypatch.setattr(phrases, "BROADCAST", bound)
    monkeypatch.setattr(phrases, "SHARD_BYTES", 700)
    rows = made(11)
    rows += [(100 + i, f"{rows[7][1]} own{i} " + "the common passage that stands in half of all rows and is longer than a window " * (1 + i % 2)) for i in range(60)] + [(300 + i, rows[7][1]) for i in range(9)]
    got = phrases.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=False)
    assert sorted(map(tuple, got.collect())) == sorted(brute.repeats(rows))


def test_odd_rows(odd, odd_rows):
    out = phrases.remove_repeats(odd)
    got = out.collect()
    assert sorted([tuple(r)[:4] for r in got], key=str) == sorted(brute.repeats(odd_rows), key=str)
    assert all(brute.sha(r.kept_text) == r.kept_sha256 for r in got)
    assert phrases.remove_repeats(odd.limit(0)).count() == 0
