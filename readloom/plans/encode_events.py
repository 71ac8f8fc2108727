"""The events table as alignment records, so that the formats can be run against plain SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.sources.files import there
from readloom.sources.load import load_bam
from readloom.sources.sam import sam_lines
from readloom.sources.save import write_bam
from readloom.sources.shared import fresh_path

CONTIGS = [(f"u{i}", 1 << 29) for i in range(8)]
_encoded: dict[tuple, str] = {}


def event_reads(events: DataFrame) -> DataFrame:
    """A record for each event: contig by user, start by seconds since 2024, unmapped if the event is an error."""
    error = F.col("event_type") == "error"
    n = (F.col("event_id") % 50 + 1).cast("int")
    return events.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("name"),
        F.when(error, 4).otherwise(0).alias("flag"),
        (F.col("user_id") % 8).cast("int").alias("ref_idx"),
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").cast("bigint").alias("start"),
        (F.col("event_id") % 61).cast("int").alias("mapq"),
        F.when(error, F.lit("*")).otherwise(F.concat(n.cast("string"), F.lit("M"))).alias("cigar"),
        F.substring(F.repeat(F.lit("ACGTN"), 10), F.lit(1), n).alias("seq"),
        F.create_map(F.lit("VC"), F.round(F.col("value") * 100).cast("bigint").cast("string")).alias("tags"),
    )


def events_bam(spark: SparkSession, sf_dir: str, **options) -> str:
    """The path of the events as one sorted, indexed file in the shared folder; encoded once for each session, and again
    where the file is gone."""
    key = (spark.sparkContext.applicationId, sf_dir, *sorted(options.items()))
    if key not in _encoded or not there(_encoded[key]):
        path = fresh_path(spark, "events.bam")
        write_bam(event_reads(spark.read.parquet(f"{sf_dir}/events.parquet")), path, CONTIGS, **options)
        _encoded[key] = path
    return _encoded[key]


def events_laid_out(spark: SparkSession, sf_dir: str) -> str:
    """The same in one part of stored blocks: where each record lies follows from the records' sizes, also in SQL."""
    return events_bam(spark, sf_dir, parts=1, level=0)


def events_sam(spark: SparkSession, sf_dir: str) -> str:
    """The same as a folder of text files, each with the header."""
    key = (spark.sparkContext.applicationId, sf_dir, "sam")
    if key not in _encoded or not there(_encoded[key]):
        path = fresh_path(spark, "events.sam")
        lines = sam_lines(load_bam(spark, events_bam(spark, sf_dir)))
        head = spark.createDataFrame([(f"@SQ\tSN:{name}\tLN:{n}",) for name, n in CONTIGS], "value string").coalesce(1)
        head.write.text(path)
        lines.write.mode("append").text(path)
        _encoded[key] = path
    return _encoded[key]
