import random

import pytest

from readloom.llm import decontaminate
from tests.llm import brute

COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def got(df):
    return sorted([tuple(r) for r in df.select(*COLUMNS).collect()], key=str)


def test_query(spark, sf, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert got(decontaminate.op8_decontaminate(spark, sf)) == sorted(brute.contaminated(docs, items), key=str)


def test_repeated_terms_short_items_and_ties(spark):
    r = random.Random(3)
    items = [(1, "a b a b a b a b a b a b a b a"), (2, "short item"), (3, "short item"), (4, None), (5, "..."), (None, "a b c"), (6, "never seen words"), (7, " ".join(r.choice("abc") for _ in range(25)))]
    rows = [(i, " ".join(r.choice(["a", "b", "A", "c.", "short item", "a b " * 9, items[7][1]]) for _ in range(r.randint(0, 25)))) for i in range(60)]
    out = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got(out) == sorted(brute.contaminated(rows, items), key=str)


@pytest.mark.parametrize("bound", [0, 200_000])
def test_a_passage_in_half_of_the_rows_and_no_broadcast(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_TERMS", bound)
    r = random.Random(5)
    word = lambda: r.choice(["the", "of", f"w{r.randrange(50)}"])
    items = [(f"i{k}", " ".join(word() for _ in range(r.choice([3, 13, 14, 40])))) for k in range(12)]
    rows = [(i, " ".join([*[word() for _ in range(20)], items[3][1] if i % 2 else items[r.randrange(12)][1][: r.randrange(200)], *["the"] * (i % 5)])) for i in range(120)]
    out = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    assert got(out) == sorted(brute.contaminated(rows, items), key=str)


def test_odd_rows(spark, odd, odd_rows):
    items = [(1, "the cat the cat the"), (2, "日本語のテキスト"), (2, "one")]
    table = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(odd, table)
    assert got(out) == sorted(brute.contaminated(odd_rows, items), key=str)
    kept = decontaminate.clean(odd, table)
    assert kept.columns == odd.columns and sorted([r.doc_id for r in kept.collect()], key=str) == sorted([1, 2, 3, 6, 7, 12, None, None], key=str)
    assert decontaminate.contamination(odd.limit(0), table).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(odd, table.limit(0)).collect()} == {0}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x blue y red"), (2, "blue red"), (3, "red a b c d blue")], "doc_id long, text string")
    terms = spark.createDataFrame([("red",), ("blue",)], "term string")
    index = decontaminate.PositionalIndex(docs, terms)
    index.store(terms)
    assert sorted(map(tuple, index.near(["red", "blue"], 4).collect())) == [(1, 0), (1, 3), (2, 0)]
    assert {(r.term, r.df) for r in index.frequencies().collect()} == {("red", 3), ("blue", 3)}


def test_proximity_of_terms_that_are_not_stored(spark):
    docs = spark.createDataFrame([(1, "red green blue")], "doc_id long, text string")
    terms = spark.createDataFrame([("red",), ("blue",), ("nowhere",)], "term string")
    index = decontaminate.PositionalIndex(docs, terms)
    with pytest.raises(KeyError):
        index.near(["red"], 4)
    index.store(terms)
    assert index.near(["red", "nowhere"], 4).collect() == []
    with pytest.raises(KeyError, match="green"):
        index.near(["red", "green"], 4)
