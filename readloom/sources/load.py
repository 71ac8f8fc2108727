"""Loading alignment files as DataFrames."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.functions.pos import plain_distance
from readloom.functions.ranges import overlaps, parse_bytes, parse_intervals, within
from readloom.operators.joins import distinct_union
from readloom.operators.scan import size_buckets
from readloom.sources import bai, bam_codec, sam
from readloom.sources.bam import SPLIT_SIZE, register
from readloom.sources.files import RandomAccess, extension, size_of


class UnsupportedFormatError(ValueError):
    """A format that needs a codec that isn't there."""


def load_reads(spark: SparkSession, path: str, split_size: int | str = SPLIT_SIZE, **options) -> DataFrame:
    """The records of a file, by its extension: bam (see BamReader for options) or sam."""
    kind = extension(path)
    if kind == "sam":
        return sam.load_sam(spark, path, None if split_size == SPLIT_SIZE else parse_bytes(split_size))
    if kind == "bam":
        return load_bam(spark, path, split_size, **options)
    if kind == "cram":
        raise UnsupportedFormatError(f"{path}: this format needs a reference-based codec")
    raise ValueError(f"Can't load reads from path {path}")


def load_bam(spark: SparkSession, path: str, split_size: int | str = SPLIT_SIZE, **options) -> DataFrame:
    if extension(path) != "bam":
        raise ValueError(f"Expected 'bam' extension: {path}")
    return load_folder(spark, path, split_size, **options)


def load_folder(spark: SparkSession, path: str, split_size: int | str = SPLIT_SIZE, **options) -> DataFrame:
    """The records of all alignment files in a folder, with their ``file``."""
    register(spark)
    return spark.read.format("bam").options(split_size=str(parse_bytes(split_size)), **{k: str(v) for k, v in options.items()}).load(path)


def load_reads_and_positions(spark: SparkSession, path: str, split_size: int | str = SPLIT_SIZE, **options) -> DataFrame:
    """The records with ``pos``, a struct (block_pos, offset) that orders as virtual positions do."""
    return load_bam(spark, path, split_size, **options).withColumn("pos", F.struct("block_pos", "offset"))


class SplitsAndReads(NamedTuple):
    splits: DataFrame
    reads: DataFrame


def splits_of(reads: DataFrame, file_size: int) -> DataFrame:
    """(split, start, end) of the splits that have records: each ends where the next begins, the last at the file's end."""
    first = reads.groupBy("split").agg(F.min(F.struct("block_pos", "offset")).alias("start"))
    last = F.struct(F.lit(file_size).cast("bigint").alias("block_pos"), F.lit(0).alias("offset"))
    return first.select("split", "start", F.lead("start", 1).over(Window.orderBy("start")).alias("next")).select("split", "start", F.coalesce("next", last).alias("end"))


def load_splits_and_reads(spark: SparkSession, path: str, split_size: int | str = SPLIT_SIZE, **options) -> SplitsAndReads:
    positions = load_bam(spark, path, split_size, **(options | {"decode": "none"}))
    return SplitsAndReads(splits_of(positions, size_of(path)), load_bam(spark, path, split_size, **options))


def load_intervals(spark: SparkSession, path: str, intervals: str, split_size: int | str = SPLIT_SIZE, ratio: float = 3.0, **options) -> DataFrame:
    """The mapped records that overlap ``intervals``; of a binary file only the chunks that its index names are read."""
    if extension(path) == "sam":
        lengths = {r.name: r.length for r in sam.contigs(spark, path).collect()}
        wanted = parse_intervals(intervals, lengths)
        return sam.load_sam(spark, path).filter(overlaps(F.col("contig"), F.col("start"), F.col("end"), F.col("flag"), wanted))
    if extension(path) == "cram":
        raise UnsupportedFormatError(f"{path}: this format needs a reference-based codec")
    return load_bam(spark, path, split_size, intervals=intervals, ratio=ratio, **options)


def load_placed(spark: SparkSession, path: str, contig: str, start: int = 0, end: int = 1 << 29, split_size: int | str = SPLIT_SIZE, **options) -> DataFrame:
    """The records, mapped or not, that are placed on ``contig`` with a start in [start, end); only the chunks that the
    companion index names are read.  A contig that isn't known has none."""
    if start >= end:
        return load_bam(spark, path, split_size, place=json.dumps({}), **options)
    reads = load_bam(spark, path, split_size, place=json.dumps({contig: [start, end]}), **options)
    return reads.filter((F.col("contig") == contig) & (F.col("start") >= start) & (F.col("start") < end))


def interval_chunks(path: str, intervals: str) -> list[bai.Chunk]:
    """The merged chunks of the index that ``intervals`` need."""
    header = read_header(path)
    number = {name: i for i, (name, _) in enumerate(header.contigs)}
    wanted = parse_intervals(intervals, dict(header.contigs))
    return bai.interval_chunks(bai.read_index(path), {number[c]: r for c, r in wanted.items()})


def read_header(path: str) -> bam_codec.Header:
    with RandomAccess(path) as file:
        return bam_codec.read_header(file)


def contigs(spark: SparkSession, path: str) -> DataFrame:
    """(idx, name, length)"""
    if extension(path) == "sam":
        return sam.contigs(spark, path)
    rows = [(i, name, n) for i, (name, n) in enumerate(read_header(path).contigs)]
    return spark.createDataFrame(rows, "idx int, name string, length long")


def index_table(spark: SparkSession, path: str) -> DataFrame:
    """(ref, bin, start, end, size) of every chunk of a companion index; ``size`` is an estimate in compressed bytes."""
    rows = [(ref, number, tuple(c.start), tuple(c.end), plain_distance(c.start, c.end)) for ref, r in enumerate(bai.read_index(path)) for number, chunks in sorted(r.bins.items()) for c in chunks]
    pos = "struct<block_pos:bigint,offset:int>"
    return spark.createDataFrame(rows, f"ref int, bin int, start {pos}, end {pos}, size long")


def index_addresses(spark: SparkSession, path: str) -> DataFrame:
    """All distinct positions that a companion index names, in order."""
    t = index_table(spark, path)
    linear = [(tuple(p),) for r in bai.read_index(path) for p in r.linear]
    more = spark.createDataFrame(linear, "pos struct<block_pos:bigint,offset:int>")
    return distinct_union(t.select(F.col("start").alias("pos")), t.select("end"), more)


def blocks(spark: SparkSession, path: str, split_size: int | str = SPLIT_SIZE, ranges: str | None = None) -> DataFrame:
    """start, compressed_size, uncompressed_size and split of the blocks of a file, found by search."""
    register(spark)
    return spark.read.format("bgzf_blocks").options(split_size=str(parse_bytes(split_size)), ranges=ranges or "").load(path)


def blocks_from_index(spark: SparkSession, path: str, split_size: int | str = SPLIT_SIZE, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """The same from a ``.blocks`` table; ``split`` is the compressed bytes before a block, kept ones only, over the
    split size.  A line that can't be read raises."""
    rows = spark.read.schema("start long, compressed_size int, uncompressed_size int").option("mode", "FAILFAST").csv(path)
    kept = size_buckets(rows.filter(within(F.col("start"), ranges)), "compressed_size", ["start"], parse_bytes(split_size), "split")
    return kept.select(F.col("split").cast("int").alias("split"), "start", "compressed_size", "uncompressed_size")


def record_positions(spark: SparkSession, path: str, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """(block_pos, offset) from a ``.records`` table, those whose block is in ``ranges``."""
    rows = spark.read.schema("block_pos long, offset int").option("mode", "FAILFAST").csv(path)
    return rows.filter(within(F.col("block_pos"), ranges))


def path_list(spark: SparkSession, path: str, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """(idx, path) of a list of paths, a line each, blank ones dropped; those whose number is in ``ranges``."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.trim("value").alias("path")).filter("path <> ''")
    numbered = lines.select((F.row_number().over(Window.orderBy("at")) - 1).alias("idx"), "path")
    return numbered.filter(within(F.col("idx"), ranges))


def file_tree(spark: SparkSession, root: str, pattern: str = "*.bam") -> DataFrame:
    """(path, length, modified) of the files below a folder, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
