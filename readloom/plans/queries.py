"""The driver's queries: each operator over the relational tables or over alignment files made from them, and SQL that
gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.functions import flags as fl
from readloom.functions import pos as vp
from readloom.functions import ranges as rg
from readloom.functions.stats import describe
from readloom.operators import joins, scan
from readloom.operators.checker import FLAGS
from readloom.plans import reports
from readloom.plans.encode_events import CONTIGS, events_bam, events_laid_out, events_sam
from readloom.sources.bam_codec import encode_header
from readloom.sources.bgzf import MAX_PAYLOAD, TRAILER
from readloom.sources.load import blocks, blocks_from_index, index_table, load_bam, load_intervals, load_reads, load_reads_and_positions, load_splits_and_reads, path_list, record_positions
from readloom.sources.save import index_blocks, index_records, rewrite
from readloom.sources.shared import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_SECONDS = "(CAST(floor(epoch(ts)) AS BIGINT) - 1704067200)"
_SPLITS = ("20k", "100k", "32m")


# Where the events lie in ``events_laid_out``: the header in a block of its own, then the records in order, in stored
# blocks of MAX_PAYLOAD bytes, each with 31 bytes around its payload.
_HEAD = len(encode_header(CONTIGS))
_BLOCK = f"{_HEAD + 31} + {MAX_PAYLOAD + 31} * ({{0}} // {MAX_PAYLOAD})"
_LAID = f"""
e AS (SELECT event_id, 'e' || event_id AS name, user_id % 8 AS ref, {_SECONDS} AS start, event_type = 'error' AS error, event_id % 50 + 1 AS n FROM events),
r AS (SELECT *, CAST(36 + length(name) + 1 + CASE WHEN error THEN 0 ELSE 4 END + (n + 1) // 2 + n + 7 AS BIGINT) AS size FROM e),
s AS (SELECT *, row_number() OVER o AS i, CAST(sum(size) OVER o - size AS BIGINT) AS lies, CAST(sum(size) OVER () AS BIGINT) AS total FROM r WINDOW o AS (ORDER BY ref, start, name)),
p AS (SELECT *, {_BLOCK.format("lies")} AS block_pos, lies % {MAX_PAYLOAD} AS "offset", {_BLOCK.format("(lies + size)")} AS stop_block, (lies + size) % {MAX_PAYLOAD} AS stop_offset FROM s),
b AS (SELECT CAST(0 AS BIGINT) AS start, CAST({_HEAD} AS BIGINT) AS n UNION ALL SELECT {_HEAD + 31} + {MAX_PAYLOAD + 31} * k, least({MAX_PAYLOAD}, total - {MAX_PAYLOAD} * k) FROM (SELECT max(total) AS total FROM s), unnest(range(0, (total + {MAX_PAYLOAD - 1}) // {MAX_PAYLOAD})) AS t(k)),
f AS (SELECT sum(n + 31) + {len(TRAILER)} AS file_size, sum(n) AS inflated, count(*) AS blocks FROM b)
"""
_KIB = 1 << 10


def _bin(start: str, end: str) -> str:
    """SQL of the smallest bin that holds [start, end)."""
    return "CASE " + " ".join(f"WHEN {start} >> {shift} = ({end} - 1) >> {shift} THEN {first} + ({start} >> {shift})" for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))) + " ELSE 0 END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Alignment files made from events


@query("SELECT 'u' || (user_id % 8) AS contig, count(*) AS reads, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS unmapped FROM events GROUP BY 1")
def bam_count_by_contig(spark, sf_dir):
    reads = load_bam(spark, events_bam(spark, sf_dir), "100k", decode="core")
    return reads.groupBy("contig").agg(F.count("*").alias("reads"), F.count_if(F.col("flag").bitwiseAND(F.lit(4)) != 0).alias("unmapped"))


@query(f"SELECT 'e' || event_id AS name, 'u' || (user_id % 8) AS contig, {_SECONDS} AS start, {_SECONDS} + CASE WHEN event_type = 'error' THEN 1 ELSE 1 + event_id % 50 END AS \"end\", CAST(event_id % 61 AS INTEGER) AS mapq, CAST(1 + event_id % 50 AS INTEGER) AS seq_len, CASE WHEN event_type = 'error' THEN '*' ELSE (1 + event_id % 50) || 'M' END AS cigar, CAST(round(value * 100) AS BIGINT) AS vc FROM events")
def bam_positions_roundtrip(spark, sf_dir):
    reads = load_bam(spark, events_bam(spark, sf_dir), "100k")
    return reads.select("name", "contig", "start", "end", "mapq", "seq_len", "cigar", F.col("tags")["VC"].cast("bigint").alias("vc"))


@query(f"SELECT 'e' || event_id AS name, 'u' || (user_id % 8) AS contig, {_SECONDS} AS start FROM events WHERE event_type <> 'error' AND ((user_id % 8 = 1 AND {_SECONDS} < 600000 AND {_SECONDS} + 1 + event_id % 50 > 86400) OR (user_id % 8 = 3 AND {_SECONDS} + 1 + event_id % 50 > 2000000))")
def bam_interval_reads(spark, sf_dir):
    return load_intervals(spark, events_bam(spark, sf_dir), "u1:86400-300000,u1:300000-600000,u3:2000000-", "50k").select("name", "contig", "start")


@query(" UNION ALL ".join(f"SELECT '{s}' AS split_size, count(*) AS reads, count(DISTINCT event_id) AS names FROM events" for s in _SPLITS))
def bam_split_invariance(spark, sf_dir):
    path = events_bam(spark, sf_dir)
    one = lambda s: load_bam(spark, path, s, decode="core").agg(F.lit(s).alias("split_size"), F.count("*").alias("reads"), F.count_distinct("name").alias("names"))
    a, b, c = map(one, _SPLITS)
    return a.union(b).union(c)


@query("SELECT 'u' || (user_id % 8) AS contig, count(*) AS reads, CAST(sum(1 + event_id % 50) AS BIGINT) AS bases FROM events GROUP BY 1")
def sam_text_reads(spark, sf_dir):
    reads = load_reads(spark, events_sam(spark, sf_dir))
    return reads.groupBy("contig").agg(F.count("*").alias("reads"), F.sum("seq_len").cast("bigint").alias("bases"))


@query(f"SELECT 'e' || event_id AS name FROM events WHERE event_type <> 'error' AND user_id % 8 = 2 AND {_SECONDS} < 500000 AND {_SECONDS} + 1 + event_id % 50 > 100000")
def sam_interval_reads(spark, sf_dir):
    return load_intervals(spark, events_sam(spark, sf_dir), "u2:100000-500000").select("name")


@query("SELECT count(*) AS reads, CAST(1 AS BIGINT) AS chained, CAST(0 AS BIGINT) AS unsorted FROM events")
def bam_splits_and_reads(spark, sf_dir):
    splits, reads = load_splits_and_reads(spark, events_bam(spark, sf_dir), "50k", decode="core")
    order = Window.orderBy("start")
    chain = splits.withColumn("ok", F.coalesce(F.lead("start").over(order) == F.col("end"), F.lit(True))).agg(F.bool_and("ok").cast("bigint").alias("chained"))
    late = reads.withColumn("before", F.lag(F.struct("ref_idx", "start")).over(Window.partitionBy("split").orderBy("block_pos", "offset"))).agg(F.count("*").alias("reads"), F.count_if(F.col("before") > F.struct("ref_idx", "start")).alias("unsorted"))
    return late.join(F.broadcast(chain), F.lit(True)).select("reads", "chained", "unsorted")


@query("SELECT count(*) AS reads, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn FROM events")
def check_bam_strict(spark, sf_dir):
    """The strict rules against the record table of the file: no false call at any position."""
    path = events_bam(spark, sf_dir)
    truth = record_positions(spark, index_records(spark, path, fresh_path(spark, "records")))
    return reports.check_bam(spark, path, truth)["summary"].select("reads", "fp", "fn")


@query(f"WITH {_LAID} SELECT (SELECT CAST(inflated AS BIGINT) FROM f) AS positions, count(*) AS reads, CAST(0 AS BIGINT) AS fn FROM p")
def check_bam_naive(spark, sf_dir):
    """The naive rules against the strict ones: they overlook no record.  What they wrongly take for one SQL can't say."""
    return reports.check_bam(spark, events_laid_out(spark, sf_dir))["summary"].select("positions", "reads", "fn")


@query()
def check_bam_confusion(spark, sf_dir):
    """The same with the false positives; tests hold every call against the plain rules."""
    return reports.check_bam(spark, events_laid_out(spark, sf_dir))["summary"]


@query()
def bam_flag_totals(spark, sf_dir):
    return reports.full_check(spark, events_bam(spark, sf_dir))["totals"]


@query()
def bam_failing_cdf(spark, sf_dir):
    return reports.full_check(spark, events_bam(spark, sf_dir))["by_failing"].select("n_failing", "positions", "positions_cdf")


@query(f"WITH {_LAID} SELECT blocks, CAST(0 AS BIGINT) AS mismatched, CAST(0 AS BIGINT) AS bytes_at_risk, blocks - (SELECT count(DISTINCT block_pos) FROM p) AS without_record, 'positions' AS verdict FROM f")
def check_blocks_summary(spark, sf_dir):
    """The strict rules against the naive ones.  The SQL has no mistake of the naive rules: on larger tables they make some."""
    summary = reports.check_blocks(spark, events_laid_out(spark, sf_dir))["summary"]
    return summary.select("blocks", "mismatched", "bytes_at_risk", "without_record", "verdict")


_SPLIT_OF = f"WITH {_LAID}, x AS (SELECT block_pos // {50 * _KIB} AS split, min(ROW(block_pos, \"offset\")) AS start, count(*) AS reads, arg_min(name, i) AS name FROM p GROUP BY 1)"


@query(
    f"{_SPLIT_OF}, y AS (SELECT *, lead(start, 1, ROW((SELECT CAST(file_size AS BIGINT) FROM f), CAST(0 AS BIGINT))) OVER (ORDER BY split) AS stop FROM x)"
    " SELECT CAST(split AS INTEGER) AS split, start[1] AS start_block, CAST(start[2] AS INTEGER) AS start_offset, stop[1] AS end_block, CAST(stop[2] AS INTEGER) AS end_offset, greatest(0, stop[1] - start[1] + CAST(trunc((stop[2] - start[2]) / 3.0) AS BIGINT)) AS length, reads FROM y"
)
def compute_splits(spark, sf_dir):
    found = reports.compute_splits(spark, events_laid_out(spark, sf_dir), "50k")
    return found.select("split", F.col("start.block_pos").alias("start_block"), F.col("start.offset").alias("start_offset"), F.col("end.block_pos").alias("end_block"), F.col("end.offset").alias("end_offset"), "length", "reads")


@query("SELECT count(*) AS reads, CAST(1 AS BIGINT) AS some_empty FROM events")
def split_sizes(spark, sf_dir):
    """Splits smaller than blocks: some hold no block's start, none of the records is lost."""
    sizes = reports.split_sizes(spark, events_bam(spark, sf_dir), "1k")
    return sizes.agg(F.sum("reads").alias("reads"), F.max((F.col("reads") == 0).cast("bigint")).alias("some_empty"))


@query("SELECT count(*) AS reads FROM events")
def asserted_calls(spark, sf_dir):
    """Every strict call against the record table; a difference would raise."""
    path = events_bam(spark, sf_dir)
    truth = record_positions(spark, index_records(spark, path, fresh_path(spark, "records")))
    rows = reports.against(reports.calls(spark, path), truth)
    return reports.asserted(rows, "expected", "strict").agg(F.count_if("strict").alias("reads"))


@query(f"WITH {_LAID}, x AS (SELECT b.start, min(p.\"offset\") AS first FROM b LEFT JOIN p ON p.block_pos = b.start GROUP BY 1) SELECT CAST(first AS INTEGER) AS \"offset\", count(*) AS blocks FROM x GROUP BY 1")
def first_offset_histogram(spark, sf_dir):
    return reports.check_blocks(spark, events_laid_out(spark, sf_dir))["histogram"]


@query(f"{_SPLIT_OF} SELECT count(*) AS strict_splits, count(*) AS other_splits, CAST(0 AS BIGINT) AS only_strict, CAST(0 AS BIGINT) AS only_other FROM x")
def compare_splits(spark, sf_dir):
    """The splits of the strict rules against those of the naive ones, for which the same holds."""
    return reports.compare_splits(spark, [events_laid_out(spark, sf_dir)], "50k")["files"].select("strict_splits", "other_splits", "only_strict", "only_other")


@query("SELECT 'strict' AS checker, count(*) AS reads, CAST(1 AS BIGINT) AS runs FROM events")
def count_reads(spark, sf_dir):
    return reports.count_reads(spark, events_bam(spark, sf_dir), "100k", ("strict",)).select("checker", "reads", "runs")


@query(f"{_SPLIT_OF} SELECT CAST(split AS INTEGER) AS split, name FROM x")
def first_reads(spark, sf_dir):
    return reports.first_reads(spark, events_laid_out(spark, sf_dir), "50k")


@query(f"WITH {_LAID} SELECT name, block_pos, CAST(\"offset\" AS INTEGER) AS \"offset\" FROM p")
def reads_and_positions(spark, sf_dir):
    return load_reads_and_positions(spark, events_laid_out(spark, sf_dir), "50k", decode="core").select("name", "pos.block_pos", "pos.offset")


@query(f"WITH {_LAID} SELECT start, CAST(n + 31 AS INTEGER) AS compressed_size, CAST(n AS INTEGER) AS uncompressed_size FROM b WHERE (start >= {70 * _KIB} AND start < {300 * _KIB}) OR (start >= {500 * _KIB} AND start < {600 * _KIB})")
def blocks_in_ranges(spark, sf_dir):
    """Only splits that meet the ranges are planned."""
    return blocks(spark, events_laid_out(spark, sf_dir), "20k", "70k-300k,500k+100k").drop("split")


@query(f"WITH {_LAID} SELECT block_pos, count(*) AS records, min(\"offset\") AS first FROM p WHERE block_pos >= {70 * _KIB} AND block_pos < {300 * _KIB} GROUP BY 1")
def records_in_ranges(spark, sf_dir):
    table = index_records(spark, events_laid_out(spark, sf_dir), fresh_path(spark, "records"))
    return record_positions(spark, table, [(70 * _KIB, 300 * _KIB)]).groupBy("block_pos").agg(F.count("*").alias("records"), F.min("offset").cast("bigint").alias("first"))


@query(f"WITH {_LAID} SELECT (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM b WHERE start >= {70 * _KIB} AND start < {300 * _KIB}) AS positions, count(*) AS reads FROM p WHERE block_pos >= {70 * _KIB} AND block_pos < {300 * _KIB}")
def check_bam_in_ranges(spark, sf_dir):
    return reports.check_bam(spark, events_laid_out(spark, sf_dir), ranges="70k-300k")["summary"].select("positions", "reads")


_SHOWN = "name || ' ' || n || 'b ' || CASE WHEN error THEN 'unmapped read (placed at u' || ref || ':' || (start + 1) || ')' ELSE 'aligned read @ u' || ref || ':' || (start + 1) END"


@query(
    f"WITH {_LAID}, q AS (SELECT *, lead(block_pos) OVER w AS next_block, lead(\"offset\") OVER w AS next_offset, lead({_SHOWN}) OVER w AS read FROM p WINDOW w AS (ORDER BY i))"
    " SELECT name AS after, next_block, CAST(next_offset AS INTEGER) AS next_offset, CASE WHEN next_block = block_pos THEN next_offset - \"offset\" - 1 ELSE next_block - block_pos + CAST(trunc((next_offset - \"offset\" - 1) / 3.0) AS BIGINT) END AS before, read FROM q WHERE i % 97 = 0 AND next_block IS NOT NULL"
)
def annotated_sites(spark, sf_dir):
    """The record after every 97th, looked up from the byte after that one's first."""
    path = events_laid_out(spark, sf_dir)
    numbered = scan.number(load_bam(spark, path, decode="core").select("block_pos", "offset", "name"), ["block_pos", "offset"])
    sites = numbered.filter("(number + 1) % 97 = 0").select("block_pos", (F.col("offset") + 1).alias("offset"), "name", F.lit(0).alias("flags"))
    found = reports.annotated(spark, path, sites).filter("next_pos is not null")
    return found.select(F.col("name").alias("after"), F.col("next_pos.block_pos").alias("next_block"), F.col("next_pos.offset").alias("next_offset"), F.col("before").cast("bigint").alias("before"), "read")


@query("SELECT CAST(0 AS BIGINT) AS differing, CAST(1 AS BIGINT) AS contiguous")
def bgzf_block_index(spark, sf_dir):
    """The written block table, read back, against the blocks that a search finds; every block ends where the next begins."""
    path = events_bam(spark, sf_dir)
    indexed = blocks_from_index(spark, index_blocks(spark, path, fresh_path(spark, "blocks")), "100k").drop("split")
    found = blocks(spark, path, "30k").drop("split")
    lead = F.lead("start").over(Window.orderBy("start"))
    joined = indexed.withColumn("next", lead).agg(F.bool_and(F.coalesce(F.col("next") == F.col("start") + F.col("compressed_size"), F.lit(True))).cast("bigint").alias("contiguous"))
    wrong = indexed.exceptAll(found).union(found.exceptAll(indexed)).agg(F.count("*").alias("differing"))
    return wrong.join(F.broadcast(joined), F.lit(True)).select("differing", "contiguous")


@query("SELECT count(*) AS reads, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_type <> 'error'")
def bai_whole_contigs(spark, sf_dir):
    """All contigs by interval: the index must lead to every mapped record once."""
    names = ",".join(f"u{i}" for i in range(8))
    reads = load_intervals(spark, events_bam(spark, sf_dir), names, "50k")
    return reads.agg(F.count("*").alias("reads"), F.sum(F.substring("name", 2, 20).cast("bigint")).alias("ids"))


@query(
    f"WITH {_LAID}, q AS (SELECT *, {_bin('start', '(start + CASE WHEN error THEN 1 ELSE n END)')} AS bin FROM p),"
    " c AS (SELECT *, CASE WHEN lag(stop_block) OVER w = block_pos THEN 0 ELSE 1 END AS fresh FROM q WINDOW w AS (PARTITION BY ref, bin ORDER BY i)),"
    " d AS (SELECT *, sum(fresh) OVER (PARTITION BY ref, bin ORDER BY i) AS chunk FROM c),"
    ' g AS (SELECT ref, bin, chunk, min(ROW(block_pos, "offset")) AS start, max(ROW(stop_block, stop_offset)) AS stop FROM d GROUP BY 1, 2, 3)'
    " SELECT CAST(ref AS INTEGER) AS ref, CAST(bin AS INTEGER) AS bin, start[1] AS start_block, CAST(start[2] AS INTEGER) AS start_offset, stop[1] AS end_block, CAST(stop[2] AS INTEGER) AS end_offset, greatest(0, stop[1] - start[1] + CAST(trunc((stop[2] - start[2]) / 3.0) AS BIGINT)) AS size FROM g"
)
def bai_chunks(spark, sf_dir):
    t = index_table(spark, events_laid_out(spark, sf_dir))
    return t.select("ref", "bin", F.col("start.block_pos").alias("start_block"), F.col("start.offset").alias("start_offset"), F.col("end.block_pos").alias("end_block"), F.col("end.offset").alias("end_offset"), "size")


@query("SELECT 'f' || n_nationkey AS file, n_nationkey * 1000 + 7 AS positions, n_nationkey * 3 AS reads, CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE n_nationkey END AS fp, CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE n_regionkey END AS fn FROM nation")
def text_reports_parsed(spark, sf_dir):
    """Text reports, one file for each nation, rendered, written, and parsed."""
    n, out = _t(spark, sf_dir, "nation"), fresh_path(spark, "reports")
    wrong = F.when(F.col("n_nationkey") % 2 != 0, 1).otherwise(0)
    rows = n.select(F.col("n_nationkey").alias("key"), (F.col("n_nationkey") * 1000 + 7).alias("positions"), F.lit(1 << 20).alias("compressed"), F.lit(2.5).alias("ratio"), (F.col("n_nationkey") * 3).alias("reads"), (wrong * F.col("n_nationkey")).alias("fp"), (wrong * F.col("n_regionkey")).alias("fn"))
    texts = reports.rendered_rows(rows)
    texts.select("key", "value").write.partitionBy("key").text(out)
    found = reports.parsed_reports(spark, out)
    return found.select(F.concat(F.lit("f"), F.col("key").cast("string")).alias("file"), "positions", "reads", "fp", "fn")


@query("SELECT CAST(n_nationkey AS INTEGER) AS idx, n_name AS path FROM nation WHERE n_nationkey >= 3 AND n_nationkey < 7 OR n_nationkey >= 20 AND n_nationkey < 22")
def path_list_in_ranges(spark, sf_dir):
    """A list of names with blank lines between, of which some numbers are wanted."""
    out = fresh_path(spark, "list")
    lines = _t(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select(F.explode(F.array(F.lit(""), F.concat(F.lit("  "), "n_name"))).alias("value"))
    lines.write.text(out)
    return path_list(spark, out, rg.parse_ranges("3-7,20+2", sizes=False)).select("idx", "path")


@query("SELECT 'e' || event_id AS name FROM (SELECT event_id, row_number() OVER (ORDER BY user_id % 8, CAST(floor(epoch(ts)) AS BIGINT), 'e' || event_id) - 1 AS n FROM events) WHERE n >= 100 AND n < 400")
def rewrite_records(spark, sf_dir):
    """Records 100 to 399 written anew, aligned to blocks, and read back."""
    out = fresh_path(spark, "rewritten.bam")
    rewrite(spark, events_bam(spark, sf_dir), out, [(100, 400)], block_aligned=True)
    return load_bam(spark, out, "10k", decode="core").select("name")


# The operators over relational tables


@query("SELECT l_orderkey, l_linenumber, (l_orderkey << 16) | l_linenumber AS packed, ((l_orderkey << 16) | l_linenumber) >> 16 AS block_pos, CAST(((l_orderkey << 16) | l_linenumber) & 65535 AS INTEGER) AS offset_in FROM lineitem")
def pack_unpack_pos(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", vp.pack(F.col("l_orderkey"), F.col("l_linenumber")).alias("packed"))
    return rows.select("*", vp.block_of(F.col("packed")).alias("block_pos"), vp.offset_of(F.col("packed")).alias("offset_in"))


@query("SELECT l_orderkey, l_linenumber, greatest(0, l_partkey - l_orderkey + CAST(trunc((l_linenumber - l_suppkey) / 3.0) AS BIGINT)) AS distance, l_orderkey || ':' || l_linenumber AS shown FROM lineitem")
def pos_distance(spark, sf_dir):
    c = F.col
    rows = _t(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", vp.distance(c("l_partkey"), c("l_linenumber"), c("l_orderkey"), c("l_suppkey")).alias("distance"), vp.shown(c("l_orderkey"), c("l_linenumber")).alias("shown"))


@query("SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM orders")
def prefix_sum(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    return scan.prefix_sum(rows, "cents", ["o_orderkey"])


@query("SELECT CAST(before // 1000000000 AS BIGINT) AS bucket, count(*) AS orders, CAST(sum(cents) AS BIGINT) AS cents FROM (SELECT CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM orders) GROUP BY 1")
def size_buckets(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    return scan.size_buckets(rows, "cents", ["o_orderkey"], 1_000_000_000).groupBy("bucket").agg(F.count("*").alias("orders"), F.sum("cents").alias("cents"))


@query("SELECT n, o_orderkey FROM (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS n, o_orderkey FROM orders) WHERE (n >= 10 AND n < 40) OR (n >= 100 AND n < 125)")
def window_zip_index(spark, sf_dir):
    rows = scan.number(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "n")
    return rows.filter(rg.within(F.col("n"), rg.parse_ranges("10-40,100+25", sizes=False))).select("n", "o_orderkey")


@query("SELECT event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_id, lead(event_id, 1, -1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id FROM events")
def lag_lead(spark, sf_dir):
    order = ["ts", "event_id"]
    return _t(spark, sf_dir, "events").select("event_id", "user_id", scan.previous("event_id", order, ["user_id"]).alias("prev_id"), scan.following("event_id", order, ["user_id"], -1).alias("next_id"))


@query("SELECT user_id, event_id AS first_id, event_type AS first_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def first_per_group(spark, sf_dir):
    return scan.first_of_each(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type"]).select("user_id", F.col("event_id").alias("first_id"), F.col("event_type").alias("first_type"))


@query("SELECT e.event_id, e.user_id, p.event_id AS purchase_id FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view') e LEFT JOIN LATERAL (SELECT event_id FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts >= e.ts ORDER BY p.ts, p.event_id LIMIT 1) p ON true")
def asof_next_purchase(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    views, buys = events.filter("event_type = 'view'"), events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    return joins.asof_forward(views, buys, "ts", ["user_id"], ["purchase_id"]).select("event_id", "user_id", "purchase_id")


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' ELSE 'left' END AS side FROM (SELECT DISTINCT l_suppkey * 7 AS k FROM lineitem) a FULL OUTER JOIN (SELECT c_custkey AS k FROM customer) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def merge_diff(spark, sf_dir):
    left = _t(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 7).alias("k")).distinct()
    return joins.merge_diff(left, _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), ["k"])


_LINES = "SELECT l_suppkey AS k, l_orderkey, l_linenumber, l_partkey AS lo, l_partkey + CAST(l_quantity AS BIGINT) AS hi FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber, lo, hi FROM ({_LINES}) x WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = x.k AND lo < s.s_suppkey * 7 + 40 AND hi > s.s_suppkey * 7)")
def interval_overlap_semi(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_linenumber", F.col("l_partkey").alias("lo"), (F.col("l_partkey") + F.col("l_quantity").cast("bigint")).alias("hi"))
    spans = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") * 7).alias("lo"), (F.col("s_suppkey") * 7 + 40).alias("hi"))
    return joins.interval_semi_join(lines, spans, "k", "lo", "hi", bin_size=64, small=0).select("l_orderkey", "l_linenumber", "lo", "hi")


@query(f"SELECT k, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM ({_LINES}) WHERE lo < hi)) GROUP BY k, island")
def range_coalesce(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("lo"), (F.col("l_partkey") + F.col("l_quantity").cast("bigint")).alias("hi"))
    return joins.coalesce_intervals(lines, ["k"], "lo", "hi").select("k", "lo", "hi")


@query("SELECT source, count(*) FILTER (e AND a) AS tp, count(*) FILTER (NOT e AND a) AS fp, count(*) FILTER (e AND NOT a) AS fn, count(*) FILTER (NOT e AND NOT a) AS tn FROM (SELECT d.source, l.doc_id IS NOT NULL AND coalesce(l.quality, 0) = 1 AS e, d.n_chars >= 500 AS a FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY source")
def membership_confusion(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") >= 500).alias("a"))
    good = _t(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").withColumn("__good", F.lit(True))
    return reports.confusion(docs.join(good, "doc_id", "left").withColumn("e", F.col("__good").isNotNull()), "e", "a", ["source"])


_MASK = "(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) + (CASE WHEN l_discount > 0.05 THEN 4 ELSE 0 END) + (CASE WHEN l_tax > 0.04 THEN 32 ELSE 0 END) + (CASE WHEN l_returnflag = 'R' THEN 32768 ELSE 0 END)"
_NAMES = f"concat_ws(',', CASE WHEN mask & 1 <> 0 THEN '{FLAGS[0]}' END, CASE WHEN mask & 4 <> 0 THEN '{FLAGS[2]}' END, CASE WHEN mask & 32 <> 0 THEN '{FLAGS[5]}' END, CASE WHEN mask & 32768 <> 0 THEN '{FLAGS[15]}' END)"


def _masked(spark, sf_dir):
    bit = lambda c, b: F.when(c, b).otherwise(0)
    mask = bit(F.col("l_quantity") > 25, 1) + bit(F.col("l_discount") > 0.05, 4) + bit(F.col("l_tax") > 0.04, 32) + bit(F.col("l_returnflag") == "R", 32768)
    return _t(spark, sf_dir, "lineitem").select(mask.alias("mask"), (F.col("l_linenumber") % 3).alias("reads_before"))


@query(f"SELECT mask, {_NAMES} AS failing, count(*) AS n FROM (SELECT {_MASK} AS mask FROM lineitem) GROUP BY 1, 2")
def flag_bitmask_hist(spark, sf_dir):
    return _masked(spark, sf_dir).groupBy("mask").agg(F.count("*").alias("n")).select("mask", fl.names(F.col("mask")).alias("failing"), "n")


@query(f"SELECT k AS n_failing, n AS positions, CAST(sum(n) OVER (ORDER BY k) AS BIGINT) AS positions_cdf FROM (SELECT CAST(bit_count(mask) + CASE WHEN b > 0 THEN 1 ELSE 0 END AS INTEGER) AS k, count(*) AS n FROM (SELECT {_MASK} AS mask, l_linenumber % 3 AS b FROM lineitem) GROUP BY 1)")
def fail_count_pdf_cdf(spark, sf_dir):
    by = _masked(spark, sf_dir).groupBy(fl.count_failing(F.col("mask"), F.col("reads_before")).alias("n_failing")).agg(F.count("*").alias("positions"))
    return scan.cumulative(by, "n_failing", ["positions"])


@query("SELECT flag, total FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS flag, count(*) FILTER (mask & {1 << i} <> 0) AS total FROM (SELECT {_MASK} AS mask FROM lineitem)" for i, n in enumerate(FLAGS)) + ")")
def flag_totals(spark, sf_dir):
    return fl.unpivoted(_masked(spark, sf_dir).agg(*fl.totals(F.col("mask"))), []).select("flag", "total")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity < 3 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20")
def close_calls_topn(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").filter("l_quantity < 3").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(20).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def _type6(p: float, value: str, rows: str) -> str:
    r = f"least(greatest((n + 1) * {p}, 1.0), n)"
    return f"(SELECT k, sum(greatest(0.0, 1 - abs(rk - {r})) * {value}) AS v FROM {rows} GROUP BY k)"


_RANKED = "(SELECT l_returnflag AS k, l_quantity * 10 + l_linenumber AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity * 10 + l_linenumber) AS rk, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)"
_AWAY = f"(SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY x) AS rk, count(*) OVER (PARTITION BY k) AS n FROM (SELECT l_returnflag AS k, abs(l_quantity * 10 + l_linenumber - m.v) AS x FROM lineitem JOIN {_type6(0.5, 'x', _RANKED)} m ON m.k = l_returnflag))"


@query(
    f"SELECT b.k, b.n, round(b.mean, 6) AS mean, round(b.sd, 6) AS sd, round(m.v, 6) AS median, round(d.v, 6) AS mad, round(p05.v, 6) AS p05, round(p90.v, 6) AS p90 FROM (SELECT l_returnflag AS k, count(*) AS n, avg(l_quantity * 10 + l_linenumber) AS mean, stddev_pop(l_quantity * 10 + l_linenumber) AS sd FROM lineitem GROUP BY 1) b"
    f" JOIN {_type6(0.5, 'x', _RANKED)} m ON m.k = b.k JOIN {_type6(0.5, 'x', _AWAY)} d ON d.k = b.k JOIN {_type6(0.05, 'x', _RANKED)} p05 ON p05.k = b.k JOIN {_type6(0.9, 'x', _RANKED)} p90 ON p90.k = b.k"
)
def describe_type6(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), (F.col("l_quantity") * 10 + F.col("l_linenumber")).alias("x"))
    d = describe(rows, "x", ["k"])
    return d.select("k", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "median", "mad", "p05", "p90")])


@query("SELECT p_partkey, i AS offset_in FROM part, LATERAL (SELECT unnest(range(0, p_size)) AS i)")
def explode_positions(spark, sf_dir):
    return _t(spark, sf_dir, "part").filter("p_size > 0").select("p_partkey", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("p_size").cast("bigint") - 1)).alias("offset_in"))


@query("(SELECT c_name AS name, 'left' AS side FROM customer WHERE c_acctbal > 0 EXCEPT SELECT c_name, 'left' FROM customer WHERE c_nationkey < 15) UNION ALL (SELECT c_name, 'right' FROM customer WHERE c_nationkey < 15 EXCEPT SELECT c_name, 'right' FROM customer WHERE c_acctbal > 0)")
def name_set_difference(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    a, b = c.filter("c_acctbal > 0").select(F.col("c_name").alias("name")), c.filter("c_nationkey < 15").select(F.col("c_name").alias("name"))
    return joins.set_difference(a, b)


@query("SELECT l_suppkey AS k FROM lineitem UNION SELECT s_suppkey FROM supplier ORDER BY k")
def distinct_union_sorted(spark, sf_dir):
    return joins.distinct_union(_t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k")), _t(spark, sf_dir, "supplier").select("s_suppkey"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS number FROM pages")
def regex_report_parse(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", r"/([0-9]+)", 1).try_cast("bigint").alias("number"))


@query("SELECT l_orderkey, l_linenumber, 'c' || (l_suppkey % 5) AS contig, l_partkey AS start, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey + l_suppkey ELSE 10000000 END AS \"end\" FROM lineitem")
def loci_parse(spark, sf_dir):
    """Interval strings, some with an open end, parsed and resolved against the contigs' lengths."""
    open_end = F.when(F.col("l_linenumber") % 2 == 0, (F.col("l_partkey") + F.col("l_suppkey")).cast("string")).otherwise("")
    text = F.concat(F.lit("c"), (F.col("l_suppkey") % 5).cast("string"), F.lit(":"), F.col("l_partkey").cast("string"), F.lit("-"), open_end)
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rg.loci(text).alias("locus")).select("l_orderkey", "l_linenumber", "locus.*")
    lengths = spark.createDataFrame([(i, f"c{i}", 10_000_000) for i in range(5)], "idx int, name string, length long")
    return joins.resolve_ends(rows, lengths)


@query("SELECT l_returnflag AS k, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS compressed, CAST(sum(l_partkey) AS BIGINT) AS uncompressed, round(sum(l_partkey) / sum(CAST(l_quantity AS BIGINT)), 6) AS ratio FROM lineitem GROUP BY 1")
def compression_ratio_by_group(spark, sf_dir):
    rows = reports.compression(_t(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("bigint"), F.col("l_partkey"), [F.col("l_returnflag").alias("k")])
    return rows.withColumn("ratio", F.round("ratio", 6))


@query("SELECT r.user_id, r.event_id, c.n_name AS contig, c.length FROM (SELECT event_id, user_id, CAST(user_id % 40 AS INTEGER) AS idx FROM events) r LEFT JOIN (SELECT n_nationkey AS idx, n_name, n_nationkey * 100 AS length FROM nation) c ON r.idx = c.idx")
def contig_lookup(spark, sf_dir):
    reads = _t(spark, sf_dir, "events").select("event_id", "user_id", (F.col("user_id") % 40).cast("int").alias("ref_idx"))
    names = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("name"), (F.col("n_nationkey") * 100).alias("length"))
    return joins.with_contigs(reads, names).select("user_id", "event_id", "contig", F.col("contig_length").alias("length"))


@query("SELECT count(*) AS mismatched, CAST(sum(coalesce(prev, 1)) AS BIGINT) AS at_risk FROM (SELECT *, lag(o_custkey) OVER (ORDER BY o_orderkey) AS prev FROM orders) WHERE (o_custkey % 7) IS DISTINCT FROM (CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 7 END)")
def null_safe_mismatch(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 7).alias("a"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 7).alias("b"))
    numbered = scan.number(rows, ["o_orderkey"])
    # the row before is the one with the number before: an equality join instead of a window over everything
    prev = numbered.select((F.col("number") + 1).alias("number"), F.col("o_custkey").alias("prev"))
    wrong = numbered.join(prev, "number", "left").filter(joins.null_safe_differ(F.col("a"), F.col("b")))
    return wrong.agg(F.count("*").alias("mismatched"), F.sum(F.coalesce("prev", F.lit(1))).alias("at_risk"))
