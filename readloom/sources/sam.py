"""Text alignment files, by native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.ranges import parse_bytes
from readloom.sources.files import size_below


def reference_length(cigar: Column) -> Column:
    """Reference bases that a cigar consumes; at least one."""
    runs = F.regexp_extract_all(cigar, F.lit("([0-9]+)[MDN=X]"), F.lit(1))
    return F.greatest(F.lit(1).cast("bigint"), F.aggregate(runs, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint")))


def header_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.col("value").startswith("@"))


def contigs(spark: SparkSession, path: str) -> DataFrame:
    """(idx, name, length) from the header; ``idx`` in order of the lines of one file."""
    lines = header_lines(spark, path).filter(F.col("value").startswith("@SQ")).withColumn("at", F.monotonically_increasing_id())
    part = lambda tag: F.regexp_extract("value", f"\\t{tag}:([^\\t]+)", 1)
    rows = lines.select("at", part("SN").alias("name"), part("LN").cast("bigint").alias("length"))
    from pyspark.sql.window import Window

    return rows.select((F.row_number().over(Window.orderBy("at")) - 1).alias("idx"), "name", "length")  # the header is small


def load_sam(spark: SparkSession, path: str, split_size: int | None = None) -> DataFrame:
    """One row for each record: the columns of the binary source but for virtual positions.

    Spark splits text by its own settings; where ``split_size`` asks for more parts than these give, the lines are dealt
    over as many (a shuffle, which doesn't keep their order).

    ``start`` counts from 0 and ``end`` is exclusive; ``contig`` is null for ``*``.  A line of fewer than eleven fields
    is not a record and raises when it is read.
    """
    lines = spark.read.text(path)
    if split_size:
        size = size_below(path)
        parts, own = -(-size // split_size), parse_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
        if parts > max(-(-size // own), 1):
            lines = lines.repartition(parts)
    lines = lines.filter(~F.col("value").startswith("@") & (F.col("value") != ""))
    f = F.split("value", "\t", 12)
    # filters may be evaluated in any order: a header line never raises
    checked = F.when((F.size(f) >= 11) | F.col("value").startswith("@"), f).otherwise(F.raise_error(F.concat(F.lit("not a record: "), F.col("value"))))
    rows = lines.select(checked.alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    tags = F.transform(F.filter(F.split(F.coalesce(at(11), F.lit("")), "\t"), lambda t: F.length(t) > 4), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), t.substr(F.lit(6), F.length(t)).alias("v")))
    named = lambda c: F.when(c != "*", c)
    rows = rows.select(
        at(0).alias("name"), at(1).cast("int").alias("flag"), named(at(2)).alias("contig"), (at(3).cast("bigint") - 1).alias("start"), at(4).cast("int").alias("mapq"), at(5).alias("cigar"),
        F.when(at(6) == "=", named(at(2))).otherwise(named(at(6))).alias("mate_contig"), (at(7).cast("bigint") - 1).alias("mate_start"), at(8).cast("int").alias("tlen"), at(9).alias("seq"), at(10).alias("qual"),
        F.when(at(9) == "*", 0).otherwise(F.length(at(9))).alias("seq_len"), F.map_from_entries(tags).alias("tags"),
    )
    return rows.withColumn("end", F.col("start") + reference_length(F.col("cigar")))


def sam_lines(reads: DataFrame) -> DataFrame:
    """The records of ``reads`` as lines (column ``value``), without a header."""
    tag = F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.when(e["value"].rlike("^-?[0-9]{1,9}$"), F.lit(":i:")).otherwise(F.lit(":Z:")), e["value"]))
    fields = ["name", F.col("flag").cast("string"), F.coalesce("contig", F.lit("*")), (F.col("start") + 1).cast("string"), F.col("mapq").cast("string"), F.coalesce("cigar", F.lit("*")), F.coalesce("mate_contig", F.lit("*")), (F.col("mate_start") + 1).cast("string"), F.col("tlen").cast("string"), F.coalesce("seq", F.lit("*")), F.coalesce("qual", F.lit("*")), F.array_join(tag, "\t")]
    return reads.select(F.regexp_replace(F.concat_ws("\t", *fields), "\t$", "").alias("value"))
