"""The reports as commands: ``python -m readloom COMMAND PATH ...``.

Text goes to standard output, or with ``-o`` to a file.  The session is the one that is there, or one made with the
settings of ``spark-submit``; ``spark.checkpoint.dir`` must name a shared folder on a cluster.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import pos as vp
from readloom.functions.ranges import format_bytes, parse_bytes, parse_ranges
from readloom.functions.stats import describe
from readloom.plans import reports
from readloom.sources import load, save
from readloom.sources.files import write_bytes


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readloom", description="Audits of record boundaries and splits of alignment files.")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, split: str | None = None, many: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text, description=text)
        c.add_argument("path", nargs="+" if many else None, help="alignment files, or lists of them, a path a line" if many else "an alignment file")
        c.add_argument("-o", "--out", help="the file that the text goes to")
        c.add_argument("-l", "--limit", type=int, default=1_000_000, help="rows of a list that are printed at most")
        if split:
            c.add_argument("-m", "--split-size", default=split, help="compressed bytes of a split, such as 2m")
        return c

    for name, text in (("check-bam", "Two checkers' calls at every position."), ("full-check", "What the rules find at every position that begins no record.")):
        c = command(name, text, "2m")
        c.add_argument("-r", "--ranges", help="block starts to look at: a-b, a+length or a, comma-separated")
    sub.choices["check-bam"].add_argument("-t", "--records", help="a table of records to hold the strict calls against")
    c = command("check-blocks", "The first record of every block by two checkers.", "2m")
    c.add_argument("-r", "--ranges", help="block starts to look at")
    c = command("compute-splits", "The splits of a file, and their sizes.", "32m")
    c.add_argument("-c", "--checker", default="strict")
    c.add_argument("-p", "--parts", action="store_true", help="statistics of the records of each split, empty ones included")
    c = command("compare-splits", "Two checkers' splits of many files.", "32m", many=True)
    c.add_argument("-r", "--ranges", help="numbers of a list's files to look at")
    c = command("count-reads", "How many records each checker's splits give, and how fast.", "32m")
    c.add_argument("-n", "--runs", type=int, default=1)
    command("time-load", "The first record of every split, how fast each checker finds them, and where they differ.", "32m")
    c = command("index-blocks", "Writes the table of a file's blocks.")
    c = command("index-records", "Writes the table of a file's records.")
    c.add_argument("-s", "--strict", action="store_true", help="fail at a record cut short, instead of leaving it out")
    c = command("rewrite", "Writes a file's records anew.")
    c.add_argument("to")
    c.add_argument("-r", "--ranges", help="numbers of the records to write")
    c.add_argument("-a", "--aligned", action="store_true", help="records begin in the block where they fit whole")
    c.add_argument("-b", "--index-blocks", action="store_true", help="write the table of blocks too")
    c.add_argument("-i", "--index-records", action="store_true", help="write the table of records too")
    return p


def shown(rows: DataFrame) -> DataFrame:
    """Sites as lines: position, what it is, the failing checks, and the record that follows."""
    after = F.when(F.col("next_pos").isNotNull(), F.concat(F.lit(", "), F.col("before").cast("string"), F.lit(" before "), F.col("read"))).otherwise("")
    return rows.select(F.concat(vp.shown(F.col("block_pos"), F.col("offset")), F.lit(":\t"), *([F.col("outcome"), F.lit(" ")] if "outcome" in rows.columns else []), F.col("failing"), after).alias("line"))


def table(rows: DataFrame, most: int, title: str) -> str:
    """Rows as tab-separated lines."""
    rows = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    return reports.limited(rows.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in rows.columns])), most, title)


def run(spark: SparkSession, o: argparse.Namespace) -> str:
    path = o.path
    if o.command == "check-bam":
        truth = load.record_positions(spark, o.records) if o.records else None
        found = reports.check_bam(spark, path, truth, split_size=o.split_size, ranges=o.ranges)
        return reports.rendered(found["summary"]) + reports.limited(shown(found["sites"]), o.limit, "{n} differing calls:") + table(found["histogram"], o.limit, "Checks that false positives fail:")
    if o.command == "full-check":
        found = reports.full_check(spark, path, split_size=o.split_size, ranges=o.ranges)
        sites = lambda name: shown(reports.annotated(spark, path, found[name].limit(o.limit)))
        out = [reports.limited(sites("critical"), o.limit, "{n} positions where one check fails:"), reports.limited(sites("close"), o.limit, "{n} positions where two checks fail:")]
        return "".join([*out, table(found["histogram"], o.limit, "Their checks:"), table(found["totals"], o.limit, "All failing checks:")])
    if o.command == "check-blocks":
        found = reports.check_blocks(spark, path, split_size=o.split_size, ranges=o.ranges)
        return reports.rendered_blocks(found["summary"]) + f"First records: {found['summary'].first().verdict}\n" + table(found["offsets"], 1, "Offsets of first records: n, mean, sd, median, mad, percentiles") + table(found["mismatches"].select("start", "compressed_size", F.to_json("strict"), F.to_json("naive")), o.limit, "{n} blocks that differ:")
    if o.command == "compute-splits":
        splits = reports.compute_splits(spark, path, o.split_size, o.checker)
        out = table(describe(splits, "length"), 1, "Sizes of splits: n, mean, sd, median, mad, percentiles")
        if o.parts:
            out += table(describe(reports.split_sizes(spark, path, o.split_size, checker=o.checker), "reads"), 1, "Records of splits:")
        lines = splits.orderBy("split").select(vp.shown(F.col("start.block_pos"), F.col("start.offset")).alias("a"), vp.shown(F.col("end.block_pos"), F.col("end.offset")).alias("b"), "length", "reads")
        return out + table(lines, o.limit, "{n} splits:")
    if o.command == "compare-splits":
        paths = [p for p in path if p.endswith(".bam")]
        for name in set(path) - set(paths):
            paths += [r.path for r in load.path_list(spark, name, parse_ranges(o.ranges, sizes=False) if o.ranges else None).collect()]  # a path a line
        found = reports.compare_splits(spark, paths, o.split_size)
        return table(found["files"], o.limit, "{n} files: path, splits, other splits, only here, only there, milliseconds of both") + table(found["differences"].select("path", "side", vp.shown(F.col("start.block_pos"), F.col("start.offset"))), o.limit, "{n} differing splits:") + table(found["ratios"], 1, "Ratios of times:")
    if o.command == "count-reads":
        return table(reports.count_reads(spark, path, o.split_size, runs=o.runs), o.limit, "Checker, records, error, runs, milliseconds:")
    if o.command == "time-load":
        return table(reports.time_load(spark, path, o.split_size), o.limit, "Checker, splits, milliseconds, error:") + table(reports.compare_first_reads(spark, path, o.split_size), o.limit, "{n} first records of one checker only:")
    if o.command == "index-blocks":
        return save.index_blocks(spark, path) + "\n"
    if o.command == "index-records":
        return save.index_records(spark, path, strict=o.strict) + "\n"
    save.rewrite(spark, path, o.to, parse_ranges(o.ranges, sizes=False) if o.ranges else None, o.aligned)
    done = [o.to, *([save.index_blocks(spark, o.to)] if o.index_blocks else []), *([save.index_records(spark, o.to)] if o.index_records else [])]
    return "\n".join(done) + "\n"


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = parser().parse_args(arguments)
    if "split_size" in o and parse_bytes(o.split_size) <= 0:
        raise SystemExit(f"not a split size: {o.split_size}")
    text = run(spark or SparkSession.builder.getOrCreate(), o)
    if o.out:
        write_bytes(o.out, text.encode())
        print(f"{format_bytes(len(text.encode()), 'B')} written to {o.out}")
    else:
        sys.stdout.write(text)
    return 0
