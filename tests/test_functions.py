import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readloom.functions import flags, pos, ranges
from readloom.functions.stats import describe
from readloom.operators import joins, scan
from readloom.operators.checker import BIT


def test_bytes():
    assert [ranges.parse_bytes(x) for x in ("100k", "16m", "32MB", "7", 5, "1g")] == [102400, 16 << 20, 32 << 20, 7, 5, 1 << 30]
    assert [ranges.format_bytes(n) for n in (26169, 597_454, 531, 1 << 20)] == ["25.6K", "583K", "531", "1.00M"]
    with pytest.raises(ValueError):
        ranges.parse_bytes("x")


def test_ranges():
    assert ranges.parse_ranges("10k-39374,287709-312795") == [(10240, 39374), (287709, 312795)]
    assert ranges.parse_ranges("5+3, 1, 7-9") == [(1, 2), (5, 9)]
    with pytest.raises(ValueError, match="a, 5-3"):
        ranges.parse_ranges("a,1,5-3")


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=8))
def test_coalesced_ranges_hold_the_same_numbers(rs):
    out = ranges.coalesce(rs)
    assert {x for lo, hi in out for x in range(lo, hi)} == {x for lo, hi in rs for x in range(lo, hi)}
    assert all(a[1] < b[0] for a, b in zip(out, out[1:]))


def test_intervals():
    lengths = {"1": 1000, "x:y": 50}
    assert ranges.parse_intervals("1:5-9,1:9-20,1:900-,x:y", lengths) == {"1": [(5, 20), (900, 1000)], "x:y": [(0, 50)]}
    with pytest.raises(ValueError, match="no contig"):
        ranges.parse_intervals("2", lengths)


def test_positions():
    # known distances: truncation towards zero, not down
    assert pos.plain_distance((0, 45846), (239479, 312)) == 224301
    assert pos.plain_distance((239479, 312), (484396, 25)) == 244917 + int((25 - 312) / 3)
    assert pos.plain_distance((5, 0), (5, 0)) == 0 and pos.plain_distance((9, 0), (5, 0)) == 0


def test_statistics_of_known_samples(spark):
    s = describe(spark.createDataFrame([(224301,), (244822,), (113078,)], "x int"), "x").first()
    assert (s.n, s.median, s.mad, round(s.sd)) == (3, 224301, 20521, 57877)
    none = describe(spark.createDataFrame([], "x int"), "x")
    assert none.count() == 0
    one = describe(spark.createDataFrame([(4,), (None,)], "x int"), "x").first()
    assert (one.n, one.p05, one.p95, one.mad) == (1, 4, 4, 0)


def test_flags(spark):
    mask = BIT["noReadName"] | BIT["invalidCigarOp"]
    row = spark.createDataFrame([(mask, 2)], "m int, b int").select(flags.names(F.col("m")), flags.count_failing(F.col("m"), F.col("b"))).first()
    assert tuple(row) == ("noReadName,invalidCigarOp", 3)


def test_joins_and_scans_on_edges(spark):
    left = spark.createDataFrame([(1, 5), (2, 7), (3, 9), (4, None)], "id int, t int").withColumn("k", F.lit(0))
    right = spark.createDataFrame([(7, "a"), (7, "b"), (8, "c")], "t int, v string").withColumn("k", F.lit(0))
    got = {r.id: r.next_t for r in joins.asof_forward(left.filter("t is not null"), right, "t", ["k"], ["v"]).collect()}
    assert got == {1: 7, 2: 7, 3: None}
    rows = spark.createDataFrame([(1, "c", 0, 10), (2, "c", 10, 20), (3, "d", 0, 5), (4, "c", 5, 5)], "id int, k string, start long, end long")
    w = spark.createDataFrame([("c", 9, 11), ("c", 10, 10), ("c", 0, 100_000)], "k string, start long, end long")
    for small in (0, 100):
        found = joins.interval_semi_join(rows, w, "k", small=small)
        assert {1, 2} <= {r.id for r in found.collect()} <= {1, 2, 4} and found.columns == rows.columns
    assert sorted(map(tuple, joins.coalesce_intervals(w, ["k"]).collect())) == [("c", 0, 100_000)]
    assert scan.prefix_sum(rows.limit(0), "start", ["id"]).count() == 0
    sums = scan.prefix_sum(rows, "end", ["id"]).orderBy("id").collect()
    assert [r.before for r in sums] == [0, 10, 30, 35]
    ends = joins.resolve_ends(spark.createDataFrame([("c", 1, None), ("c", 2, 3)], "contig string, start long, end long"), spark.createDataFrame([(0, "c", 50)], "idx int, name string, length long"))
    assert sorted(map(tuple, ends.collect())) == [("c", 1, 50), ("c", 2, 3)]
