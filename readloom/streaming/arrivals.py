"""A folder that finished text alignment files, or block tables, keep arriving in, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def block_tables(spark: SparkSession, folder: str) -> DataFrame:
    """(file, start, compressed_size, uncompressed_size) of the ``.blocks`` tables that arrive."""
    rows = spark.readStream.schema("start long, compressed_size int, uncompressed_size int").option("pathGlobFilter", "*.blocks").csv(folder)
    return rows.select(F.col("_metadata.file_name").alias("file"), "*")


def ratios(blocks: DataFrame) -> DataFrame:
    """Compression ratio of each file so far; a running aggregate whose state is a row for each file."""
    sums = blocks.groupBy("file").agg(F.count("*").alias("blocks"), F.sum("compressed_size").alias("compressed"), F.sum("uncompressed_size").alias("uncompressed"))
    return sums.withColumn("ratio", F.col("uncompressed") / F.col("compressed"))
