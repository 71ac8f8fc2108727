import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark, sf):
    """(doc_id, text) of the small corpus, in order of id."""
    return sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names clash with those of results."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (1, None, "a", "1"), (2, "", "a", None), (3, " \t\n", None, "x"), (4, "one", "b", "x"), (4, "one", "b", "x"), (5, "ONE", "b", "x"),
        (6, long, "b", "x"), (7, long + " end", "c", "x"), (8, "the cat " * 30, "c", "x"), (9, "the cat " * 30, "c", "x"),
        (None, "the cat " * 30, "c", "x"), (None, None, None, None), (11, "日本語のテキスト ☃ Ünïcode don't 123  x", "d", "x"), (12, "a b", "d", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, kept string")


@pytest.fixture(scope="session")
def odd_rows(odd):
    return [(r.doc_id, r.text) for r in odd.collect()]
