"""Sinks: binary files, their block and record tables, and separated text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.ranges import within
from readloom.operators.scan import number
from readloom.sources.bam import register
from readloom.sources.files import filesystem
from readloom.sources.load import blocks, load_bam, read_header


def write_lines(rows: DataFrame, path: str, separator: str = ",") -> int:
    """Writes the rows, in their order, as one text file of plain values; they stream through the driver."""
    system, name = filesystem(path)
    n = 0
    with system.open_output_stream(name) as out:
        for row in rows.toLocalIterator(prefetchPartitions=True):
            out.write((separator.join("" if v is None else str(v) for v in row) + "\n").encode())
            n += 1
    return n


def index_blocks(spark: SparkSession, path: str, out: str | None = None) -> str:
    """Writes the table of a file's blocks next to it (``.blocks``), found in parallel."""
    out = out or path + ".blocks"
    write_lines(blocks(spark, path).select("start", "compressed_size", "uncompressed_size").orderBy("start"), out)
    return out


def index_records(spark: SparkSession, path: str, out: str | None = None, strict: bool = False) -> str:
    """Writes the table of a file's record positions (``.records``).  A record cut short by the file's end raises if
    ``strict``, and otherwise is left out."""
    out = out or path + ".records"
    reads = load_bam(spark, path, decode="none", mode="FAILFAST" if strict else "PERMISSIVE")
    write_lines(reads.select("block_pos", "offset").orderBy("block_pos", "offset"), out)
    return out


def write_bam(reads: DataFrame, path: str, contigs: list[tuple[str, int]], sort: bool = True, parts: int | None = None, **options) -> None:
    """Writes records as one file and its index; with ``sort``, in order of contig and start (unplaced ones last).

    Each of the sorted ``parts``, which tasks write at once, begins a block; with one part, the file's layout depends on
    the records alone.  The parts are joined on the driver; with ``folder=True`` they stay files of their own, each with
    its index, for ``load_folder``.
    """
    register(reads.sparkSession)
    if sort:
        order = [F.when(F.col("ref_idx") < 0, 1 << 30).otherwise(F.col("ref_idx")), F.col("start"), F.col("name")]
        reads = (reads.repartitionByRange(parts, *order) if parts else reads.repartitionByRange(*order)).sortWithinPartitions(*order)
    text = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    reads.write.format("bam").options(contigs=json.dumps(contigs), **text).mode("append").save(path)


def rewrite(spark: SparkSession, path: str, out: str, ranges: list[tuple[int, int]] | None = None, block_aligned: bool = False, index: bool = True) -> None:
    """Writes the records of ``path`` whose number, in file order, is in ``ranges``, anew, by default with records that
    run on from block to block."""
    reads = load_bam(spark, path)
    if ranges is not None:
        # only positions are numbered; the records follow by a join
        wanted = number(load_bam(spark, path, decode="none").select("block_pos", "offset"), ["block_pos", "offset"]).filter(within(F.col("number"), ranges))
        reads = reads.join(wanted, ["block_pos", "offset"], "left_semi")
    order = ["block_pos", "offset"]
    write_bam(reads.repartitionByRange(*order).sortWithinPartitions(*order), out, list(read_header(path).contigs), sort=False, block_aligned=block_aligned, index=index)
