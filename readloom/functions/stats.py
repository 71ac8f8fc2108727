"""Descriptive statistics as one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PERCENTILES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)


def ranked(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The rows of non-null ``value`` with ``rank`` (from 1) and ``n`` within their group."""
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("x")).withColumns({"rank": F.row_number().over(by.orderBy("x")), "n": F.count("*").over(by)})


def _at(p: float) -> list[Column]:
    """Weights of a row in the percentile at rank (n + 1) p, held within the ranks there are."""
    r = F.least(F.greatest((F.col("n") + 1) * F.lit(p), F.lit(1.0)), F.col("n").cast("double"))
    return F.greatest(F.lit(0.0), 1 - F.abs(F.col("rank") - r)) * F.col("x")


def percentiles(df: DataFrame, value: str, keys: list[str] | None = None, at: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """A column p05, p10, ... for each of ``at``: linear between the ranks around (n + 1) p."""
    rows = ranked(df, value, keys or [])
    aggregates = [F.sum(_at(p)).alias(f"p{round(100 * p):02d}") for p in at]
    return (rows.groupBy(*keys) if keys else rows.groupBy()).agg(*aggregates)


def describe(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """n, mean, sd (of the population), median, mad (median distance from the median, not scaled) and percentiles.

    A row for each group; groups without a value are missing.  The rows of a group are ordered by a window, which
    spills, and never collected into one value.
    """
    keys = keys or []
    one = percentiles(df, value, keys)
    if not keys:
        one = one.withColumn("__all", F.lit(0))
        df = df.withColumn("__all", F.lit(0))
    by = keys or ["__all"]
    base = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    away = df.join(F.broadcast(one.select(*by, "p50")) if not keys else one.select(*by, "p50"), by).select(*by, F.abs(F.col(value) - F.col("p50")).alias("away"))
    mad = percentiles(away, "away", by, (0.5,)).withColumnRenamed("p50", "mad")
    out = base.join(one, by).join(mad, by).withColumn("median", F.col("p50"))
    return out.select(*keys, "n", "mean", "sd", "median", "mad", *[f"p{round(100 * p):02d}" for p in PERCENTILES])
