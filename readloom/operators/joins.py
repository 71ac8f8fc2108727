"""Joins that a plain equality can't express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BIN = 1 << 14


def asof_forward(left: DataFrame, right: DataFrame, on: str, by: list[str], take: list[str]) -> DataFrame:
    """Each row of ``left`` with ``take`` (and ``on`` as next_<on>) of the first row of ``right`` of the same ``by``
    whose ``on`` is not before its own; nulls where there is none.

    Both sides are put in one order and the next right row is looked up by a window: one shuffle by ``by``, no pairs.
    """
    columns = left.columns
    one = left.select(F.lit(1).alias("__side"), *[F.col(c).alias(f"__k_{c}") for c in by], F.col(on).alias("__on"), F.struct(*columns).alias("__left"), F.lit(None).alias("__right"))
    taken = F.struct(F.col(on).alias(f"next_{on}"), *take)
    other = right.select(F.lit(0).alias("__side"), *[F.col(c).alias(f"__k_{c}") for c in by], F.col(on).alias("__on"), F.lit(None).alias("__left"), taken.alias("__right"))
    ahead = Window.partitionBy(*[f"__k_{c}" for c in by]).orderBy(F.col("__on").desc(), F.col("__side").asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = one.unionByName(other).withColumn("__next", F.last("__right", ignorenulls=True).over(ahead))
    return both.filter("__side = 1").select("__left.*", "__next.*")


def merge_diff(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """(key, side) of the keys that only one side has: ``left`` or ``right``."""
    both = left.select(*key, F.lit(True).alias("__l")).join(right.select(*key, F.lit(True).alias("__r")), key, "full_outer")
    return both.filter(F.col("__l").isNull() | F.col("__r").isNull()).select(*key, F.when(F.col("__l"), "left").otherwise("right").alias("side"))


def interval_semi_join(rows: DataFrame, intervals: DataFrame, key: str, start: str = "start", end: str = "end", bin_size: int = BIN, small: int = 10_000) -> DataFrame:
    """The rows whose half-open [start, end) overlaps one of ``intervals`` (same columns) with the same ``key``.

    A few intervals are broadcast.  Others are dealt, like the rows, into bins of ``bin_size``; rows meet the intervals
    of their bins, and a row that meets several stays one row.
    """
    w = intervals.select(F.col(key).alias("__k"), F.col(start).alias("__lo"), F.col(end).alias("__hi")).filter("__lo < __hi")
    meets = (F.col(key) == F.col("__k")) & (F.col(start) < F.col("__hi")) & (F.col(end) > F.col("__lo"))
    if w.limit(small + 1).count() <= small:
        return rows.join(F.broadcast(w), meets, "left_semi")
    bins = lambda lo, hi: F.sequence(F.floor(lo / bin_size), F.floor((hi - 1) / bin_size))
    tagged = rows.withColumn("__id", F.monotonically_increasing_id())
    real = F.col(start) < F.col(end)
    dealt = tagged.filter(real).select("__id", key, start, end, F.explode(bins(F.col(start), F.col(end))).alias("__bin"))
    found = dealt.join(w.withColumn("__bin", F.explode(bins(F.col("__lo"), F.col("__hi")))), "__bin").filter(meets).select("__id").distinct()
    return tagged.join(found, "__id", "left_semi").drop("__id")


def with_contigs(reads: DataFrame, contigs: DataFrame, idx: str = "ref_idx") -> DataFrame:
    """``reads`` with contig and length by index; a file's contigs are few, and are broadcast."""
    names = contigs.select(F.col("idx").alias("__idx"), F.col("name").alias("contig"), F.col("length").alias("contig_length"))
    return reads.join(F.broadcast(names), F.col(idx) == F.col("__idx"), "left").drop("__idx")


def resolve_ends(intervals: DataFrame, contigs: DataFrame) -> DataFrame:
    """``intervals`` (contig, start, end and others) with open ends (null) at the contig's length; unknown contigs go."""
    names = contigs.select(F.col("name").alias("contig"), F.col("length").alias("__length"))
    end = F.coalesce("end", "__length").alias("end")
    return intervals.join(F.broadcast(names), "contig").select(*[end if c == "end" else F.col(c) for c in intervals.columns])


def set_difference(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """The distinct rows that only one side has, and in ``side`` the name of that one."""
    one = lambda a, b, name: a.subtract(b).withColumn("side", F.lit(name))
    return one(left, right, names[0]).union(one(right, left, names[1]))


def distinct_union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The distinct rows of all, which have the same columns in the same places, in order."""
    for other in others:
        first = first.union(other)
    return first.distinct().orderBy(*first.columns)


def coalesce_intervals(intervals: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The union of half-open intervals of each key as disjoint ones; touching intervals become one."""
    by = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.filter(F.col(start) < F.col(end)).withColumn("__new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)))
    island = F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("__island", island).groupBy(*key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def null_safe_differ(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)
