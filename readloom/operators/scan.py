"""Scans over an order: prefix sums, neighbours, numbering, and balanced groups.

A window without a key would order a whole table in one task; where rows can be many, ``prefix_sum`` and ``number`` work
range by range: ranges of the order are summed first, and only the sums of the ranges pass through one task.  The
ranges are written to the shared folder in between: their boundaries are sampled, and must be the same for both steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.sources.shared import written

BEFORE = (Window.unboundedPreceding, -1)


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    return written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")


def prefix_sum(df: DataFrame, value: str, order: list[str], out: str = "before") -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` over all rows before it in ``order`` (which must be total)."""
    ranged = _ranged(df, order)
    sums = ranged.groupBy("__range").agg(F.sum(value).alias("__sum"))
    base = sums.select("__range", F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(*BEFORE)), F.lit(0)).alias("__base"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(*BEFORE)), F.lit(0))
    return ranged.withColumn("__own", own).join(F.broadcast(base), "__range").withColumn(out, F.col("__base") + F.col("__own")).drop("__range", "__own", "__base")


def number(df: DataFrame, order: list[str], out: str = "number") -> DataFrame:
    """``df`` with ``out``, its place in ``order`` from 0."""
    return prefix_sum(df.withColumn("__one", F.lit(1).cast("bigint")), "__one", order, out).drop("__one")


def size_buckets(df: DataFrame, size: str, order: list[str], split_size: int, out: str = "bucket") -> DataFrame:
    """``df`` with ``out``: the sum of sizes before a row over ``split_size``, rounded down."""
    return prefix_sum(df, size, order, "__before").withColumn(out, F.floor(F.col("__before") / split_size)).drop("__before")


def previous(value: str, order: list[str], by: list[str] | None = None, default=None) -> Column:
    return F.lag(value, 1, default).over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order))


def following(value: str, order: list[str], by: list[str] | None = None, default=None) -> Column:
    return F.lead(value, 1, default).over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order))


def first_of_each(df: DataFrame, by: list[str], order: list[str], take: list[str]) -> DataFrame:
    """``take`` of the first row of each group; a partial aggregate, nothing is sorted."""
    least = F.min(F.struct(*order, *[c for c in take if c not in order])).alias("__least")
    return df.groupBy(*by).agg(least).select(*by, *[F.col(f"__least.{c}") for c in take])


def cumulative(df: DataFrame, by: str, values: list[str]) -> DataFrame:
    """For each value its sum over the rows up to this one (``<value>_cdf``); a few rows in one order."""
    upto = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({f"{v}_cdf": F.sum(v).over(upto) for v in values})
