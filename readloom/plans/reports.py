"""Audits of record boundaries and splits: one function for each report, each result a DataFrame."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import flags as fl
from readloom.functions import pos as vp
from readloom.functions.ranges import format_bytes, parse_bytes
from readloom.functions.stats import describe
from readloom.operators.checker import BIT, MAX_READ_SIZE, READS_TO_CHECK, checker
from readloom.operators.joins import set_difference
from readloom.operators.scan import cumulative
from readloom.sources.bam import first_of_split
from readloom.sources.bam_codec import decode, record_offsets
from readloom.sources.bgzf import Inflated
from readloom.sources.files import RandomAccess, size_of
from readloom.sources.load import blocks, load_bam, read_header, splits_of
from readloom.sources.shared import written

SPLIT = "2m"  # compressed bytes whose positions one task checks
CALLS = "block_pos long, offset int, strict boolean, flags int, reads_before int, other boolean"


def calls(spark: SparkSession, path: str, other: str = "naive", split_size: str = SPLIT, ranges: str | None = None, reads_to_check: int = READS_TO_CHECK) -> DataFrame:
    """Both checkers' calls at every inflated position of the blocks in ``ranges``.

    ``flags`` and ``reads_before`` say what the strict rules found: the failing checks of the record that failed, and
    how many records before it passed (or, where ``strict``, how many were read).
    """
    lengths = read_header(path).lengths
    make = checker(other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        with RandomAccess(path) as file:
            data, at, expected = None, 0, -1
            for batch in batches:
                for start, compressed, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    if start != expected:
                        data, at = Inflated(file, start), 0
                    strict = checker("strict")(data, lengths, reads_to_check)
                    loose = make(data, lengths, reads_to_check)
                    ok, mask, before = strict.calls(at, at + size)
                    also = loose.calls(at, at + size)[0]
                    yield pa.RecordBatch.from_pydict({"block_pos": np.full(size, start), "offset": np.arange(size, dtype=np.int32), "strict": ok, "flags": mask, "reads_before": before, "other": also})
                    data.discard(at + size)
                    at, expected = 0, start + compressed

    found = blocks(spark, path, split_size, ranges)
    return found.select("start", "compressed_size", "uncompressed_size").mapInArrow(run, CALLS)


def classified(rows: DataFrame, expected: str, actual: str) -> DataFrame:
    """``rows`` with ``outcome``: TP, FP, FN or TN."""
    e, a = F.col(expected), F.col(actual)
    return rows.withColumn("outcome", F.when(e & a, "TP").when(a, "FP").when(e, "FN").otherwise("TN"))


def confusion(rows: DataFrame, expected: str, actual: str, keys: list[str] | None = None) -> DataFrame:
    e, a = F.col(expected), F.col(actual)
    n = lambda c, name: F.count_if(c).alias(name)
    return (rows.groupBy(*keys) if keys else rows).agg(n(e & a, "tp"), n(~e & a, "fp"), n(e & ~a, "fn"), n(~e & ~a, "tn"))


def against(rows: DataFrame, truth: DataFrame, out: str = "expected") -> DataFrame:
    """``rows`` of positions with ``out``: whether ``truth`` (block_pos, offset) has them."""
    marked = truth.select("block_pos", "offset").distinct().withColumn("__there", F.lit(True))
    return rows.join(marked, ["block_pos", "offset"], "left").withColumn(out, F.col("__there").isNotNull()).drop("__there")


def check_bam(spark: SparkSession, path: str, truth: DataFrame | None = None, other: str = "naive", **options) -> dict[str, DataFrame]:
    """``summary`` (positions, sizes, ratio, reads, confusion), ``sites`` (calls that differ, each with the next record)
    and ``histogram`` (of the flags of false positives).

    With ``truth`` the strict calls are held against it, otherwise the other checker's against the strict ones.
    """
    rows = calls(spark, path, other, **options)
    if truth is not None:
        rows, expected, actual = against(rows, truth), "expected", "strict"
    else:
        expected, actual = "strict", "other"
    size = compression(blocks(spark, path, ranges=options.get("ranges")), F.col("compressed_size"), F.col("uncompressed_size"))  # a position is an inflated byte
    summary = confusion(rows, expected, actual).join(F.broadcast(size), F.lit(True))
    summary = summary.select((F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("positions"), "compressed", "ratio", (F.col("tp") + F.col("fn")).alias("reads"), "fp", "fn")
    wrong = classified(rows, expected, actual).filter(F.col(expected) != F.col(actual))
    sites = annotated(spark, path, wrong)
    histogram = wrong.filter("outcome = 'FP'").groupBy("flags").count().select(fl.names(F.col("flags")).alias("failing"), "flags", "count").orderBy(F.desc("count"), "flags")
    return {"summary": summary, "sites": sites, "histogram": histogram}


def annotated(spark: SparkSession, path: str, sites: DataFrame) -> DataFrame:
    """``sites`` with the next record: its position, how far it is (in bytes if it begins in the same block, else an
    estimate in compressed ones), and how it is displayed; nulls where none follows.

    Each site is looked up by itself in the file, from its own block on: nothing is shuffled or ordered.
    """
    header = read_header(path)
    extra = ["next_block", "next_offset", "contig", "start", "flag", "ref_idx", "seq_len", "name"]
    columns = sites.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        with RandomAccess(path) as file:
            for batch in batches:
                out: list[list] = [[] for _ in extra]
                for block, offset in zip(batch.column("block_pos").to_pylist(), batch.column("offset").to_pylist()):
                    if (block, offset) < header.end:
                        block, offset = header.end
                    data = Inflated(file, block)
                    at = checker("strict")(data, header.lengths).next_start(offset)
                    found: list = [None] * len(extra)
                    if at is not None and (whole := next(record_offsets(data, at, 1 << 62, strict=False), None)) is not None:
                        d = decode(data, [whole], header.contigs, "core")
                        found = [*data.position(at), *(d[c][0] for c in extra[2:])]
                    for column, v in zip(out, found):
                        column.append(v.item() if hasattr(v, "item") else v)
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(o, k) for o, k in zip(out, kinds)]], names=[*columns, *(f"__{c}" for c in extra)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sites.schema) + ", __next_block long, __next_offset int, __contig string, __start long, __flag int, __ref_idx int, __seq_len int, __name string"
    found = sites.mapInArrow(run, schema)
    next_block, next_offset = F.col("__next_block"), F.col("__next_offset")
    delta = vp.distance(next_block, next_offset, F.col("block_pos"), F.col("offset"))
    next_pos = F.when(next_block.isNotNull(), F.struct(next_block.alias("block_pos"), next_offset.alias("offset")))
    before = F.when(next_block == F.col("block_pos"), next_offset - F.col("offset")).otherwise(delta)
    return found.select(*columns, next_pos.alias("next_pos"), before.alias("before"), record_shown("__").alias("read"), fl.names(F.col("flags")).alias("failing"))


def record_shown(prefix: str = "") -> Column:
    """``name k/n LENb aligned read @ contig:start``, or where it is placed; ``prefix``: of the columns' names."""
    flag, contig, name, ref_idx, seq_len, start = (F.col(prefix + c) for c in ("flag", "contig", "name", "ref_idx", "seq_len", "start"))
    on = lambda bit: flag.bitwiseAND(F.lit(bit)) != 0
    which = F.when(on(1), F.when(on(64), F.lit(" 1/2")).otherwise(F.lit(" 2/2"))).otherwise(F.lit(""))
    place = F.concat(contig, F.lit(":"), (start + 1).cast("string"))
    where = F.when(~on(4), F.concat(F.lit("aligned read @ "), place)).when(ref_idx >= 0, F.concat(F.lit("unmapped read (placed at "), place, F.lit(")"))).otherwise(F.lit("unmapped read"))
    return F.concat(name, which, F.lit(" "), seq_len.cast("string"), F.lit("b "), where)


def full_check(spark: SparkSession, path: str, **options) -> dict[str, DataFrame]:
    """What the strict rules find at every position that isn't a record start.

    ``totals``: positions for each flag; ``by_failing``: positions and flag totals by how many checks fail, with sums up
    to that number; ``critical`` and ``close``: the positions where only one or two checks fail; ``histogram``: their
    combinations.  Positions with nothing but too few bytes for a record are left out, except in ``totals``.
    """
    rows = calls(spark, path, "strict", **options).filter(~F.col("strict")).withColumn("n_failing", fl.count_failing(F.col("flags"), F.col("reads_before")))
    totals = fl.unpivoted(rows.agg(*fl.totals(F.col("flags"))), []).select("flag", "total", "position").orderBy(F.desc("total"), "position").drop("position")
    considered = rows.filter(~((F.col("flags") == BIT["tooFewFixedBlockBytes"]) & (F.col("reads_before") == 0)))
    by = considered.groupBy("n_failing").agg(F.count("*").alias("positions"), *fl.totals(F.col("flags")))
    near = considered.filter("n_failing <= 2")
    histogram = near.groupBy("n_failing", "flags").count().select("n_failing", fl.names(F.col("flags")).alias("failing"), "count").orderBy("n_failing", F.desc("count"), "failing")
    names = [c for c in by.columns if c != "n_failing"]
    return {"totals": totals, "by_failing": cumulative(by, "n_failing", names), "critical": near.filter("n_failing = 1"), "close": near.filter("n_failing = 2"), "histogram": histogram}


def first_records(spark: SparkSession, path: str, checkers: tuple[str, ...] = ("strict", "naive"), max_read_size: int = MAX_READ_SIZE, **options) -> DataFrame:
    """start, compressed_size, and for each checker the (block_pos, offset) of the first record from the block on."""
    header = read_header(path)
    made = [checker(c) for c in checkers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos = pa.struct([("block_pos", pa.int64()), ("offset", pa.int32())])
        with RandomAccess(path) as file:
            for batch in batches:
                out: list[list] = [[] for _ in made]
                for start in batch.column(0).to_pylist():
                    for i, make in enumerate(made):
                        data, at = Inflated(file, start), 0
                        if start <= header.end[0]:  # before the header's end nothing is a record
                            data, at = Inflated(file, header.end[0]), header.end[1]
                        found = make(data, header.lengths, READS_TO_CHECK, max_read_size).next_start(at)
                        out[i].append(None if found is None else dict(zip(("block_pos", "offset"), data.position(found))))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(o, pos) for o in out]], names=["start", "compressed_size", *checkers])

    pos = "struct<block_pos:bigint,offset:int>"
    return blocks(spark, path, options.pop("split_size", SPLIT), **options).select("start", "compressed_size").mapInArrow(run, "start long, compressed_size int, " + ", ".join(f"{c} {pos}" for c in checkers))


def check_blocks(spark: SparkSession, path: str, other: str = "naive", **options) -> dict[str, DataFrame]:
    """``mismatches``: blocks whose first record the checkers see differently; ``summary``: how many, and the compressed
    bytes before them, from which a split would go wrong (one for a first block), and the ``verdict``: ``aligned`` if
    every block's first record begins the block, ``aligned but for blocks without`` if so where a record begins at all,
    else ``positions``; ``offsets``: statistics of the first records' offsets; ``histogram``: blocks for each of these
    offsets, null for blocks in which no record begins."""
    rows = first_records(spark, path, ("strict", other), **options)
    # the block before is the one that ends where this one begins
    before = blocks(spark, path, **{k: v for k, v in options.items() if k in ("split_size", "ranges")}).select((F.col("start") + F.col("compressed_size")).alias("start"), F.col("compressed_size").alias("risk"))
    rows = rows.join(before, "start", "left").withColumn("risk", F.coalesce("risk", F.lit(1)))
    wrong = rows.filter(~F.col("strict").eqNullSafe(F.col(other)))
    total = size_of(path)
    summary = rows.agg(F.count("*").alias("blocks"), F.count_if(~F.col("strict").eqNullSafe(F.col(other))).alias("mismatched"), F.coalesce(F.sum(F.when(~F.col("strict").eqNullSafe(F.col(other)), F.col("risk"))), F.lit(0)).alias("bytes_at_risk"), F.count_if(F.col("strict").isNull() | (F.col("strict.block_pos") != F.col("start"))).alias("without_record"), F.coalesce(F.bool_and(F.col("strict.offset") == 0), F.lit(True)).alias("aligned")).withColumn("file_size", F.lit(total)).withColumn("share", F.col("bytes_at_risk") / F.lit(total))
    away = F.count_if((F.col("strict.block_pos") == F.col("start")) & (F.col("strict.offset") != 0))
    verdict = F.when(F.col("away") > 0, "positions").when(F.col("without_record") > 0, "aligned but for blocks without").otherwise("aligned")
    summary = summary.join(F.broadcast(rows.agg(away.alias("away"))), F.lit(True)).withColumn("verdict", verdict).drop("away")
    mine = rows.select(F.when(F.col("strict.block_pos") == F.col("start"), F.col("strict.offset")).alias("offset"))
    histogram = mine.groupBy("offset").agg(F.count("*").alias("blocks"))
    return {"mismatches": wrong, "summary": summary, "offsets": describe(mine, "offset"), "histogram": histogram}


def compute_splits(spark: SparkSession, path: str, split_size: int | str, checker_name: str = "strict", **options) -> DataFrame:
    """(split, start, end, length, reads) of the splits with records; ``length`` is an estimate in compressed bytes."""
    reads = load_bam(spark, path, split_size, decode="none", checker=checker_name, **options)
    splits = splits_of(reads, size_of(path))
    length = vp.distance(F.col("end.block_pos"), F.col("end.offset"), F.col("start.block_pos"), F.col("start.offset"))
    counts = reads.groupBy("split").agg(F.count("*").alias("reads"))
    return splits.join(counts, "split").withColumn("length", length)


def split_sizes(spark: SparkSession, path: str, split_size: int | str, **options) -> DataFrame:
    """(split, reads) of every split of a file, also of those in which no record's block begins."""
    counts = load_bam(spark, path, split_size, decode="none", **options).groupBy("split").agg(F.count("*").alias("reads"))
    n = -(-size_of(path) // parse_bytes(split_size))
    every = spark.range(n).select(F.col("id").cast("int").alias("split"))
    return every.join(counts, "split", "left").select("split", F.coalesce("reads", F.lit(0)).alias("reads"))


def asserted(rows: DataFrame, expected: str, actual: str) -> DataFrame:
    """``rows``, of which reading one where the two calls differ raises."""
    return rows.filter(F.assert_true(F.col(expected) == F.col(actual), F.concat(F.lit("calls differ at "), vp.shown(F.col("block_pos"), F.col("offset")))).isNull())


def split_starts(spark: SparkSession, paths: list[str], split_size: int | str, checkers: tuple[str, ...], tasks: int | None = None) -> DataFrame:
    """(path, checker, split, start, us): the first record of every split of all ``paths`` that has one, by each checker,
    and the microseconds that the search took.  One job; a task looks no further than a split's first record."""
    size = parse_bytes(split_size)
    sizes = [(p, -(-size_of(p) // size)) for p in paths]  # a number for each file
    total = sum(n for _, n in sizes) * len(checkers)
    rows = spark.createDataFrame([(p, c, n) for p, n in sizes for c in checkers], "path string, checker string, n int")
    rows = rows.filter("n > 0").select("path", "checker", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("split"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, took = [], []
            for path, name, split in zip(*(c.to_pylist() for c in batch.columns)):
                began = time.perf_counter_ns()
                found = first_of_split(path, split * size, (split + 1) * size, name)
                took.append((time.perf_counter_ns() - began) // 1000)
                starts.append(None if found is None else dict(zip(("block_pos", "offset"), found)))
            kind = pa.struct([("block_pos", pa.int64()), ("offset", pa.int32())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, kind), pa.array(took, pa.int64())], names=["path", "checker", "split", "start", "us"])

    dealt = rows.repartition(max(1, min(total, tasks or 8 * spark.sparkContext.defaultParallelism + total // 64)))
    return dealt.mapInArrow(run, "path string, checker string, split int, start struct<block_pos:bigint,offset:int>, us long")


def compare_splits(spark: SparkSession, paths: list[str], split_size: int | str, other: str = "naive") -> dict[str, DataFrame]:
    """``files``: for each path both checkers' numbers of splits, how many only one has (by start), and the milliseconds
    that finding them took in all; ``differences``: those splits; ``ratios``: statistics of the times' ratios.

    All files are searched in one job; a path that is named twice counts once."""
    found = written(split_starts(spark, sorted(set(paths)), split_size, ("strict", other)), "splits")
    mine, also = F.col("checker") == "strict", F.col("checker") == other
    there = found.filter("start is not null")
    sides = there.groupBy("path", "start").agg(F.bool_or(mine).alias("strict"), F.bool_or(also).alias("other"))
    differences = sides.filter("strict <> other").select("path", F.when(F.col("strict"), "left").otherwise("right").alias("side"), "start")
    lone = sides.groupBy("path").agg(F.count_if(F.col("strict") & ~F.col("other")).alias("only_strict"), F.count_if(F.col("other") & ~F.col("strict")).alias("only_other"))
    ms = lambda c: (F.sum(F.when(c, F.col("us"))) / 1000).cast("int")
    files = found.groupBy("path").agg(F.count_if(mine & F.col("start").isNotNull()).alias("strict_splits"), F.count_if(also & F.col("start").isNotNull()).alias("other_splits"), ms(mine).alias("strict_ms"), ms(also).alias("other_ms"))
    files = files.join(lone, "path", "left").select("path", "strict_splits", "other_splits", F.coalesce("only_strict", F.lit(0)).alias("only_strict"), F.coalesce("only_other", F.lit(0)).alias("only_other"), "strict_ms", "other_ms")
    ratios = describe(files.select((F.greatest(F.col("strict_ms"), F.lit(1)) / F.greatest(F.col("other_ms"), F.lit(1))).alias("ratio")), "ratio")
    return {"files": files, "differences": differences, "ratios": ratios}


def count_reads(spark: SparkSession, path: str, split_size: int | str, checkers: tuple[str, ...] = ("strict", "naive"), runs: int = 1) -> DataFrame:
    """(checker, reads, error, runs, ms): how many runs gave which number, or failed."""
    rows = []
    for name in checkers:
        for _ in range(runs):
            began = time.perf_counter()
            try:
                n, error = load_bam(spark, path, split_size, decode="none", checker=name).count(), None
            except Exception as e:  # a wrong start makes a reader fail: that is a result here
                n, error = None, type(e).__name__
            rows.append((name, n, error, int(1000 * (time.perf_counter() - began))))
    return spark.createDataFrame(rows, "checker string, reads long, error string, ms int").groupBy("checker", "reads", "error").agg(F.count("*").alias("runs"), F.min("ms").alias("ms"))


def first_reads(spark: SparkSession, path: str, split_size: int | str, checker_name: str = "strict") -> DataFrame:
    """(split, name) of the first record of each split that has any."""
    reads = load_bam(spark, path, split_size, decode="core", checker=checker_name)
    return reads.groupBy("split").agg(F.min_by("name", F.struct("block_pos", "offset")).alias("name"))


def time_load(spark: SparkSession, path: str, split_size: int | str, checkers: tuple[str, ...] = ("strict", "naive")) -> DataFrame:
    """(checker, splits, ms, error): how long it took each checker to give the first record of every split."""
    rows = []
    for name in checkers:
        began = time.perf_counter()
        try:
            n, error = first_reads(spark, path, split_size, name).count(), None
        except Exception as e:  # a wrong start makes a reader fail: that is a result here
            n, error = None, type(e).__name__
        rows.append((name, n, int(1000 * (time.perf_counter() - began)), error))
    return spark.createDataFrame(rows, "checker string, splits long, ms int, error string")


def compare_first_reads(spark: SparkSession, path: str, split_size: int | str, other: str = "naive") -> DataFrame:
    """The names that are first in a split for one checker only."""
    return set_difference(*(first_reads(spark, path, split_size, c).select("name") for c in ("strict", other)), ("strict", other))


def compression(rows: DataFrame, compressed: Column, inflated: Column, keys: list[Column] | None = None) -> DataFrame:
    """(keys, compressed, uncompressed, ratio): sums over the rows, and inflated bytes for a compressed one."""
    sums = rows.groupBy(*(keys or [])).agg(F.sum(compressed).alias("compressed"), F.sum(inflated).alias("uncompressed"))
    return sums.withColumn("ratio", F.col("uncompressed") / F.col("compressed"))


def rendered(summary: DataFrame) -> str:
    """The summary of ``check_bam`` in the lines that ``parsed_reports`` reads."""
    return rendered_rows(summary).first().value + "\n"


def rendered_rows(summaries: DataFrame) -> DataFrame:
    """``summaries``, rows as that of ``check_bam``, with their text as ``value``."""
    text = lambda c: F.col(c).cast("string")
    matched = (F.col("fp") == 0) & (F.col("fn") == 0)
    wrong = F.concat(text("fp"), F.lit(" false positives, "), text("fn"), F.lit(" false negatives"))
    size = F.lit(None).cast("string")
    x = F.col("compressed").cast("double")
    for i, unit in reversed(list(enumerate(["", "K", "M", "G", "T"]))):
        v = x / float(1 << 10 * i)
        places = F.greatest(F.lit(0), 3 - F.length(F.floor(v).cast("string")))
        shown = F.format_string("%d", F.col("compressed").cast("bigint")) if not i else F.concat(F.when(places == 2, F.format_string("%.2f", v)).when(places == 1, F.format_string("%.1f", v)).otherwise(F.format_string("%.0f", v)), F.lit(unit))
        size = F.coalesce(size, F.when((v >= 1) | F.lit(i == 0), shown))
    lines = [F.concat(text("positions"), F.lit(" uncompressed positions")), F.concat(size, F.lit(" compressed")), F.concat(F.lit("Compression ratio: "), F.format_string("%.2f", F.col("ratio").cast("double"))), F.concat(text("reads"), F.lit(" reads")), F.when(matched, F.lit("All calls matched!")).otherwise(wrong)]
    return summaries.withColumn("value", F.concat_ws("\n", *lines))


def parsed_reports(spark: SparkSession, path: str) -> DataFrame:
    """(file, positions, reads, fp, fn, and the columns of a partitioned folder) from the text reports of ``check_bam`` in
    a folder, one report a file."""
    lines = spark.read.text(path, wholetext=True)
    more = [c for c in lines.columns if c != "value"]
    lines = lines.select(F.col("_metadata.file_name").alias("file"), "value", *more)
    part = lambda pattern, i=1: F.regexp_extract("value", pattern, i).try_cast("bigint")
    wrong = r"(\d+) false positives, (\d+) false negatives"
    return lines.select("file", *more, part(r"(\d+) uncompressed positions").alias("positions"), part(r"(?m)^(\d+) reads$").alias("reads"), F.coalesce(part(wrong), F.lit(0)).alias("fp"), F.coalesce(part(wrong, 2), F.lit(0)).alias("fn"))


def limited(rows: DataFrame, most: int, title: str, cut_title: str | None = None) -> str:
    """Up to ``most`` rows as indented lines under ``title``, which is ``cut_title`` where there are more; the first
    column's values.  ``{n}`` in a title is the number of rows, ``{most}`` that of those shown."""
    n = rows.count()
    shown = [str(r[0]) for r in rows.limit(most).collect()]
    head = title if n <= most else cut_title or f"{title} (first {{most}} of {{n}}):"
    return "\n".join([head.format(n=n, most=most), *(f"\t{line}" for line in shown), *(["\t\u2026"] if n > most else [])]) + "\n"


#: The columns of a row of the summary table over many files, in order.
TSV_COLUMNS = ("file", "positions", "compressed", "ratio", "reads", "fp", "fn", "blocks", "mismatched", "without_record", "bytes_at_risk", "file_size", "share")


def summary_rows(spark: SparkSession, paths: list[str], other: str = "naive", **options) -> DataFrame:
    """TSV_COLUMNS, a row for each path: the summaries of ``check_bam`` and ``check_blocks`` beside each other."""
    rows = None
    for path in paths:
        one = check_bam(spark, path, other=other, **options)["summary"].join(F.broadcast(check_blocks(spark, path, other, **options)["summary"]), F.lit(True))
        one = one.withColumn("file", F.lit(path)).select(*TSV_COLUMNS)
        rows = one if rows is None else rows.union(one)
    return rows


def write_tsv(rows: DataFrame, path: str) -> None:
    """Writes ``summary_rows`` as tab-separated text with a header."""
    rows.coalesce(1).write.option("sep", "\t").option("header", "true").csv(path)  # a row for each file


def parsed_block_reports(spark: SparkSession, path: str) -> DataFrame:
    """(file, blocks, mismatched, bytes_at_risk, file_size) from the text reports of ``check_blocks`` in a folder; both
    spellings of a mismatch are read."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    part = lambda pattern, i=1: F.regexp_extract("value", pattern, i).try_cast("bigint")
    bad, good, risk = r"mis-?matched in (\d+) of (\d+) BGZF blocks", r"position matched in (\d+) BGZF blocks", r"(?m)^(\d+) of (\d+) "
    return lines.select("file", F.coalesce(part(bad, 2), part(good)).alias("blocks"), F.coalesce(part(bad), F.lit(0)).alias("mismatched"), F.coalesce(part(risk), F.lit(0)).alias("bytes_at_risk"), part(risk, 2).alias("file_size"))


def rendered_blocks(summary: DataFrame) -> str:
    """The summary of ``check_blocks`` in the lines that ``parsed_block_reports`` reads."""
    r = summary.first()
    if not r.mismatched:
        return f"First read-position matched in {r.blocks} BGZF blocks totaling {format_bytes(r.file_size, 'B')} (compressed)\n"
    return f"First read-position mismatched in {r.mismatched} of {r.blocks} BGZF blocks\n\n{r.bytes_at_risk} of {r.file_size} ({r.share}) compressed positions would lead to bad splits\n"
