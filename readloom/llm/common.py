"""What the training-data operators share: the folder that the cluster shares, and tables written to it."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.sources.files import filesystem  # noqa: F401
from readloom.sources.shared import fresh_path as fresh_dir  # noqa: F401
from readloom.sources.shared import written  # noqa: F401

BATCH_ROWS = 1000  # rows that are worked on at once, at most: texts are long, and a batch is held several times over


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)``, where ``run`` gets batches of at most BATCH_ROWS rows, cut from those Spark sends.

    At the end of a partition the worker, which lives on beside a full heap, gives back the memory that it has freed.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                yield batch.slice(at, BATCH_ROWS)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(cut(batches))
        give_back()

    return df.mapInArrow(whole, schema)


def give_back() -> None:
    """Returns freed memory to the system, where the C library and Arrow can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def written_ids(df: DataFrame, name: str) -> DataFrame:
    """What an aggregate or join of ids gives, written in an eighth as many files as shuffles have partitions.

    Partitions are as many as texts need; small tables in as many files would be mostly the making of files.
    """
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.coalesce(max(1, most // 8)), name)


def broadcast_if_small(written_table: DataFrame, most: int) -> DataFrame:
    """A written table, with the hint to broadcast it if it has at most ``most`` rows; otherwise joins shuffle it."""
    return F.broadcast(written_table) if written_table.count() <= most else written_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """``col`` with A-Z lower-cased and every other character as it was."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
