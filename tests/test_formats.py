import random
import shutil
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.functions import ranges
from readloom.operators.checker import BIT, FLAGS, NAIVE_FIRST_IGNORES, NAIVE_IGNORES, READS_TO_CHECK, Checker, NaiveChecker, record_flags, register_checker
from readloom.plans import encode_events, reports
from readloom.sources import bai, bam_codec, bgzf, load, save
from readloom.sources.files import RandomAccess
from readloom.streaming import arrivals

CONTIGS = [("c1", 100_000), ("c2", 5_000)]


def record(i, seq=20, cigar=None, flag=0, ref=0, pos=None, name=None):
    return bam_codec.encode_record(name or f"read{i}", flag, ref, 10 * i if pos is None else pos, i % 60, f"{seq}M" if cigar is None else cigar, "ACGT" * (seq // 4) + "ACGT"[: seq % 4], tags=bam_codec.encode_tag("NM", "i", i))


def write(path, records, payload=300, aligned=False, trailer=True, header=True):
    out = bgzf.BlockWriter(payload)
    if header:
        out.write(bam_codec.encode_header(CONTIGS))
        out.end_block()
    at = []
    for r in records:
        if aligned and len(out.open) + len(r) > payload:
            out.end_block()
        at.append(out.tell())
        out.write(r)
    out.end_block()
    path.write_bytes(out.take() + (bgzf.TRAILER if trailer else b""))
    # a record that begins where a block ends begins the next block
    size = {b.start: b for b in bgzf.block_metadata(RandomAccess(str(path)))}
    return [(p, o) if o < size[p].uncompressed_size else (p + size[p].compressed_size, 0) for p, o in at]


@pytest.fixture
def bam(tmp_path):
    path = tmp_path / "x.bam"
    return str(path), write(path, [record(i, seq=4 + i % 90) for i in range(300)])


def test_blocks(bam):
    path, _ = bam
    with RandomAccess(path) as file:
        metas = list(bgzf.block_metadata(file))
        starts = [m.start for m in metas]
        assert all(a.start + a.compressed_size == b.start for a, b in zip(metas, metas[1:]))
        for at in (0, 1, starts[3], starts[3] + 1, starts[-1]):
            assert bgzf.find_block_start(file, at) == min([s for s in starts if s >= at], default=file.size - 28)
        assert bgzf.find_block_start(file, starts[-1] + 1) == file.size - 28  # the empty block at the end
        assert bgzf.find_block_start(file, file.size - 27) == file.size
        data = bgzf.Inflated(file, 0)
        assert not data.ensure(10**9) and len(data.data) == sum(m.uncompressed_size for m in metas)
        cache = bgzf.BlockCache(file, most=2)
        for s in starts[:4]:
            assert cache.block(s)[1] == s + next(m.compressed_size for m in metas if m.start == s)
        assert list(cache.kept) == starts[2:4]
    with pytest.raises(bgzf.HeaderError) as e:
        bgzf.parse_header(b"\x1f\x8b\x08\x05" + bytes(20))
    assert (e.value.index, e.value.actual, e.value.expected) == (3, 5, 4)


def test_no_block_in_64k(tmp_path):
    path = tmp_path / "noise"
    path.write_bytes(bytes(200_000))
    with RandomAccess(str(path)) as file, pytest.raises(bgzf.NoBlockFound):
        bgzf.find_block_start(file, 5)


def plain_flags(data, at, lengths):
    """The rules for one record, step by step."""
    if len(data) - at < 36:
        return BIT["tooFewFixedBlockBytes"]
    size, ref, pos, w3, w4, seq, nref, npos, _ = struct.unpack_from("<iiiIIiiii", data, at)
    out = 0
    for idx, p, prefix in ((ref, pos, "Read"), (nref, npos, "NextRead")):
        if idx < -1:
            out |= BIT[f"negative{prefix}Idx"] | (BIT[f"negative{prefix}Pos"] if p < -1 else 0)
        elif idx >= len(lengths):
            out |= BIT[f"tooLarge{prefix}Idx"] | (BIT[f"negative{prefix}Pos"] if p < -1 else 0)
        elif p < -1:
            out |= BIT[f"negative{prefix}Pos"]
        elif idx >= 0 and p > lengths[idx]:
            out |= BIT[f"tooLarge{prefix}Pos"]
    name, ops, mapped = w3 & 255, w4 & 65535, not w4 >> 16 & 4
    wrap = lambda x: (x + 2**31) % 2**32 - 2**31
    half = wrap(seq + 1)
    if size < wrap(32 + name + 4 * ops + int(half / 2) + seq):
        out |= BIT["tooFewRemainingBytesImplied"]
    p = at + 36
    if name < 2:
        out |= BIT["noReadName" if name == 0 else "emptyReadName"]
    elif p + name > len(data):
        return out | BIT["tooFewBytesForReadName"]
    else:
        text = data[p : p + name]
        if text[-1]:
            out |= BIT["nonNullTerminatedReadName"]
        elif any(not (33 <= c <= 63 or 65 <= c <= 126) for c in text[:-1]):
            out |= BIT["nonASCIIReadName"]
        p += name
    for _ in range(ops):
        if p + 4 > len(data):
            return out | BIT["tooFewBytesForCigarOps"]
        if data[p] & 15 > 8:
            return out | BIT["invalidCigarOp"]
        p += 4
    if mapped:
        out |= (BIT["emptyMappedSeq"] if seq == 0 else 0) | (BIT["emptyMappedCigar"] if ops == 0 else 0)
    return out


class Whole:
    """A stream that is all there."""

    ended = True

    def __init__(self, data):
        self.data = bytearray(data)

    def ensure(self, n):
        return len(self.data) >= n


def test_flags_at_every_position_are_those_of_the_rules():
    r = random.Random(2)
    lengths = [n for _, n in CONTIGS]
    good = b"".join(record(i, seq=r.randint(0, 12), flag=r.choice([0, 4])) for i in range(30))
    noise = bytes(r.choice([0, 0, 0, 1, 2, 4, 15, 40, 65, 200, 255]) for _ in range(4000))
    for data in (good, noise, good[:1000] + noise[:500] + good[1000:]):
        got = record_flags(np.frombuffer(data, np.uint8), len(data), np.array(lengths))
        assert got.tolist() == [plain_flags(data, i, lengths) for i in range(len(data))]
        one = Checker(Whole(data), lengths)
        assert [one.one(i) for i in range(len(data))] == got.tolist()
        assert Checker(Whole(data), lengths)._flags(10, 700).tolist() == got[10:700].tolist()


def test_checkers_find_all_records_and_only_those(bam):
    path, at = bam
    with RandomAccess(path) as file:
        header = bam_codec.read_header(file)
        assert header.contigs == tuple(CONTIGS)
        data = bgzf.Inflated(file, header.end[0])
        check = Checker(data, header.lengths)
        data.ensure(10**9)
        ok, flags, before = check.calls(0, len(data.data))
        block, offset = data.positions(np.flatnonzero(ok))
        assert list(zip(block.tolist(), offset.tolist())) == at
        assert before[np.flatnonzero(ok)].max() == 10 and before[np.flatnonzero(ok)[-1]] == 1
        assert [ok[i] for i in range(200)] == [check.call(i)[0] for i in range(200)]
        assert all(check.next_start(i) == np.flatnonzero(ok)[np.flatnonzero(ok) >= i][0] for i in range(0, 2000, 37))
        assert check.next_start(int(np.flatnonzero(ok)[-1]) + 1) is None
        assert [check.one(i) for i in range(3000)] == record_flags(np.frombuffer(bytes(data.data), np.uint8), 3000, np.array(header.lengths)).tolist()


def test_planted_starts_fool_the_naive_rules(tmp_path, spark):
    """Records whose tags hold bytes that the naive rules take for a record that leads to the next one."""
    path = tmp_path / "planted.bam"
    records = []
    for i in range(40):
        plant = bam_codec.FIXED.pack(0, 0, 200_000, 1, 0, 0, 1, 0, 0, -1, -1, 0) + struct.pack("<I", 15) + b"\0"
        plant = struct.pack("<i", len(plant) - 4) + plant[4:]
        body = bam_codec.encode_record(f"read{i}", 0, 0, 10 * i, 9, "8M", "ACGTACGT", tags=b"XXB" + b"c" + struct.pack("<I", len(plant)) + plant)
        records.append(body)
    at = write(path, records, payload=500)
    out = reports.check_bam(spark, str(path))
    s = out["summary"].first()
    assert s.reads == 40 and s.fn == 0 and s.fp == 40
    site = out["sites"].orderBy("block_pos", "offset").first()
    assert site.failing == "tooLargeReadPos,emptyReadName,invalidCigarOp" and site.read.startswith("read1 8b aligned read @ c1:11")
    assert [(r.failing, r["count"]) for r in out["histogram"].collect()] == [("tooLargeReadPos,emptyReadName,invalidCigarOp", 40)]
    truth = spark.createDataFrame(at, "block_pos long, offset int")
    assert reports.check_bam(spark, str(path), truth)["summary"].select("reads", "fp", "fn").first() == (40, 0, 0)
    text = reports.rendered(out["summary"])
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.txt").write_text(text)
    assert reports.parsed_reports(spark, str(tmp_path / "r")).select("positions", "reads", "fp", "fn").first() == (s.positions, 40, 40, 0)
    blocks = reports.check_blocks(spark, str(path))
    b = blocks["summary"].first()
    assert b.mismatched == blocks["mismatches"].count() and (b.mismatched == 0) == (b.bytes_at_risk == 0)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "a.txt").write_text(reports.rendered_blocks(blocks["summary"]))
    parsed = reports.parsed_block_reports(spark, str(tmp_path / "b")).first()
    assert (parsed.blocks, parsed.mismatched, parsed.bytes_at_risk) == (b.blocks, b.mismatched, b.bytes_at_risk)


def loaded(spark, path, split, **options):
    df = load.load_reads_and_positions(spark, path, split, **options)
    return sorted((r.pos.block_pos, r.pos.offset) for r in df.collect())


def test_every_split_size_gives_every_record_once(spark, bam):
    path, at = bam
    for split in ("64", "777", "2k", "5000", "1m"):
        assert loaded(spark, path, split, decode="none") == at
    sizes = load.load_bam(spark, path, "2k", decode="none").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in sizes} == {s: n for s in range(99) if (n := sum(p // 2048 == s for p, _ in at))}


def test_odd_files(spark, tmp_path):
    long = tmp_path / "long.bam"
    at = write(long, [record(0, seq=8), record(1, seq=150_000, cigar="150000M", pos=0), record(2, seq=90_000), record(3, seq=8)], payload=65280)
    assert [loaded(spark, str(long), s, decode="core") for s in ("1k", "20k", "1m")] == [at] * 3
    aligned = tmp_path / "aligned.bam"
    at = write(aligned, [record(i, seq=30) for i in range(100)], aligned=True)
    assert loaded(spark, str(aligned), "700", decode="none") == at
    only = tmp_path / "header_only.bam"
    write(only, [])
    assert [loaded(spark, str(only), s) for s in ("16", "1m")] == [[], []]
    cut = tmp_path / "cut.bam"
    whole = [record(i, seq=50) for i in range(20)]
    at = write(cut, [*whole, record(20)[:30]], trailer=False)
    assert loaded(spark, str(cut), "1m", decode="none", mode="PERMISSIVE") == at[:20]
    with pytest.raises(Exception, match="TruncatedRecord|ends within the record"):
        loaded(spark, str(cut), "1m", decode="none")
    out = save.index_records(spark, str(cut), str(tmp_path / "cut.records"))
    assert open(out).read().splitlines() == [f"{a},{b}" for a, b in at[:20]]


def test_what_cannot_be_loaded(spark, tmp_path, bam):
    with pytest.raises(ValueError, match="Expected 'bam' extension"):
        load.load_bam(spark, "x.sam")
    with pytest.raises(ValueError, match="Can't load reads from path"):
        load.load_reads(spark, "x.txt")
    with pytest.raises(load.UnsupportedFormatError):
        load.load_reads(spark, "x.cram")
    bad = tmp_path / "bad.bam"
    bad.write_bytes(bgzf.deflate(b"SAM\1" + bytes(20)))
    with RandomAccess(str(bad)) as file, pytest.raises(ValueError):
        bam_codec.read_header(file)
    with pytest.raises(ValueError):
        bai.index_path("x.sam")


def test_written_records_come_back(spark, tmp_path):
    rows = [(f"r{i}", 16 if i % 3 else 4, i % 2 if i % 7 else -1, 50 * i % 4000 if i % 7 else -1, i % 60, "*" if not i % 3 else "3S10M2D5M", "ACGTN" * 4 if i % 3 else "ACG", "IIII#" * 4 if i % 3 else None, {"NM": str(i), "XS": f"t{i}"}) for i in range(200)]
    df = spark.createDataFrame(rows, "name string, flag int, ref_idx int, start long, mapq int, cigar string, seq string, qual string, tags map<string,string>").repartition(4)
    for aligned in (False, True):
        path = str(tmp_path / f"w{aligned}.bam")
        save.write_bam(df, path, CONTIGS, block_aligned=aligned, payload=900)
        got = load.load_bam(spark, path, "1500")
        back = sorted((r.name, r.flag, r.ref_idx, r.start, r.mapq, r.cigar, r.seq, None if r.qual == "*" else r.qual, r.tags) for r in got.collect())
        assert [tuple(b) for b in back] == sorted(rows)
        ends = {r.name: (r.start, r.end, r.contig) for r in got.collect()}
        assert ends["r1"] == (50, 67, "c2")
        first = got.filter("offset = 0").count()
        assert (first > 3) or not aligned
        for intervals in ("c1:100-700", "c1:0-50,c2:3000-", "c2", "c1:99000-"):
            lengths = dict(CONTIGS)
            wanted = ranges.parse_intervals(intervals, lengths)
            want = sorted(r.name for r in got.collect() if not r.flag & 4 and any(r.start < hi and r.end > lo for lo, hi in wanted.get(r.contig, [])))
            assert sorted(r.name for r in load.load_intervals(spark, path, intervals, "1k").collect()) == want
            assert len(load.interval_chunks(path, intervals)) > 0 or not want
        assert load.index_addresses(spark, path).count() > 2
        assert load.contigs(spark, path).collect() == [(0, "c1", 100_000), (1, "c2", 5_000)]
    out = str(tmp_path / "some.bam")
    save.rewrite(spark, str(tmp_path / "wFalse.bam"), out, [(5, 17), (30, 31)])
    order = [r.name for r in load.load_bam(spark, str(tmp_path / "wFalse.bam")).orderBy("block_pos", "offset").collect()]
    assert [r.name for r in load.load_bam(spark, out).orderBy("block_pos", "offset").collect()] == order[5:17] + order[30:31]
    assert load.load_folder(spark, str(tmp_path), decode="none").select("file").distinct().count() == 3
    assert load.file_tree(spark, str(tmp_path)).count() == 3


def test_text_twin(spark, tmp_path):
    lines = ["@HD\tVN:1.6", "@SQ\tSN:c1\tLN:100000", "@SQ\tSN:c2\tLN:5000", "a\t0\tc1\t11\t60\t5M3D2M\t=\t40\t0\tACGTACG\tIIIIIII\tNM:i:3\tXX:Z:a:b", "b\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*"]
    path = tmp_path / "x.sam"
    path.write_text("\n".join(lines) + "\n")
    a, b = load.load_reads(spark, str(path)).orderBy("name").collect()
    assert (a.start, a.end, a.contig, a.mate_contig, a.mate_start, a.seq_len, a.tags) == (10, 20, "c1", "c1", 39, 7, {"NM": "3", "XX": "a:b"})
    assert (b.contig, b.start, b.seq_len, b.tags) == (None, -1, 0, {})
    assert [r.name for r in load.load_intervals(spark, str(path), "c1:19-30,c2").collect()] == ["a"]
    assert load.load_intervals(spark, str(path), "c1:20-30").count() == 0
    assert load.contigs(spark, str(path)).orderBy("idx").collect() == [(0, "c1", 100_000), (1, "c2", 5_000)]
    split = load.load_reads(spark, str(path), "60")
    assert split.rdd.getNumPartitions() == -(-path.stat().st_size // 60) and sorted(r.name for r in split.collect()) == ["a", "b"]
    (tmp_path / "bad.sam").write_text("one\ttwo\n")
    with pytest.raises(Exception, match="not a record"):
        load.load_reads(spark, str(tmp_path / "bad.sam")).collect()


def test_tables_and_lists(spark, tmp_path, bam):
    path, at = bam
    table = save.index_blocks(spark, path)
    indexed = load.blocks_from_index(spark, table, "1k")
    found = load.blocks(spark, path, "900")
    assert sorted(map(tuple, indexed.drop("split").collect())) == sorted(map(tuple, found.drop("split").collect()))
    total, want = 0, []
    for b in indexed.orderBy("start").collect():
        want.append(total // 1024)
        total += b.compressed_size
    assert [b.split for b in indexed.orderBy("start").collect()] == want
    some = load.blocks(spark, path, "900", "0-400,1k+100")
    assert {r.start for r in some.collect()} == {r.start for r in found.collect() if r.start < 400 or 1024 <= r.start < 1124}
    records = save.index_records(spark, path)
    assert load.record_positions(spark, records).count() == len(at)
    assert load.record_positions(spark, records, [(0, 1000)]).count() == sum(p < 1000 for p, _ in at)
    (tmp_path / "bad.blocks").write_text("1,2,x\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        load.blocks_from_index(spark, str(tmp_path / "bad.blocks")).collect()
    (tmp_path / "list").write_text(" a.bam \n\nb.bam\nc.bam\n")
    assert load.path_list(spark, str(tmp_path / "list"), [(1, 3)]).collect() == [(1, "b.bam"), (2, "c.bam")]


def test_reports(spark, bam):
    path, at = bam
    splits = reports.compute_splits(spark, path, "2k").orderBy("split").collect()
    assert sum(s.reads for s in splits) == len(at) and splits[0].start == at[0]
    assert all(a.end == b.start for a, b in zip(splits, splits[1:]))
    assert reports.count_reads(spark, path, "2k", runs=2).select("reads", "runs").distinct().collect() == [(300, 2)]
    assert reports.compare_first_reads(spark, path, "2k").count() == 0
    twin = path.replace(".bam", "2.bam")
    shutil.copy(path, twin)
    compared = reports.compare_splits(spark, [path, twin, path], "2k")
    assert [(r.path, r.strict_splits, r.only_strict + r.only_other) for r in compared["files"].orderBy("path").collect()] == sorted((p, len(splits), 0) for p in (path, twin))
    assert compared["differences"].count() == 0 and compared["ratios"].first().n == 2
    full = reports.full_check(spark, path)
    cdf = full["by_failing"].orderBy("n_failing").collect()
    assert cdf[-1].positions_cdf == sum(r.positions for r in cdf)
    assert {r.flag for r in full["totals"].collect()} == set(FLAGS)
    assert full["critical"].count() + full["close"].count() == (full["histogram"].agg(F.sum("count")).first()[0] or 0)
    blocks = reports.check_blocks(spark, path)
    assert blocks["summary"].first().mismatched == 0 and blocks["offsets"].first().n > 10


def test_full_check_is_that_of_the_plain_rules(spark, bam):
    path, at = bam
    full = reports.full_check(spark, path)
    with RandomAccess(path) as file:
        data = bgzf.Inflated(file, 0)
        while data.ensure(len(data.data) + 1):
            pass
    lengths = load.read_header(path).lengths
    one = Checker(Whole(bytes(data.data)), lengths)
    starts = set(at)
    totals, by, near = dict.fromkeys(FLAGS, 0), {}, {}
    for i in range(len(data.data)):
        mask, before = plain_flags(bytes(data.data), i, lengths), 0
        if data.position(i) in starts:
            continue
        if not mask:  # a chain of records that breaks later: the flags are those of the record that fails
            ok, mask, before = one.call(i)
            assert not ok
        for k, name in enumerate(FLAGS):
            totals[name] += mask >> k & 1
        if mask == BIT["tooFewFixedBlockBytes"] and not before:
            continue
        n = mask.bit_count() + (before > 0)
        by[n] = by.get(n, 0) + 1
        if n <= 2:
            near[n, mask] = near.get((n, mask), 0) + 1
    assert {r.flag: r.total for r in full["totals"].collect()} == totals
    cdf = full["by_failing"].orderBy("n_failing").collect()
    assert [(r.n_failing, r.positions) for r in cdf] == sorted(by.items())
    assert [r.positions_cdf for r in cdf] == [sum(v for k, v in by.items() if k <= n) for n in sorted(by)]
    assert full["critical"].count() == sum(v for (n, _), v in near.items() if n == 1) and full["close"].count() == sum(v for (n, _), v in near.items() if n == 2)
    assert sorted(r["count"] for r in full["histogram"].collect()) == sorted(near.values())


def test_naive_calls_are_those_of_the_plain_rules(spark):
    """At every position of the events' file, where the naive rules make mistakes."""
    path = encode_events.events_laid_out(spark, "/root/testdata/sf0.001")
    lengths = load.read_header(path).lengths
    with RandomAccess(path) as file:
        stream = bgzf.Inflated(file, 0)
        while stream.ensure(len(stream.data) + 1):
            pass
    data = bytes(stream.data)
    masks = Checker(Whole(data), lengths)  # rule by rule as above

    def called(at, first, rest):
        for n in range(READS_TO_CHECK):
            if n and at >= len(data):
                return at == len(data)
            if masks.one(at) & ~(first if not n else rest):
                return False
            at += 4 + max(int.from_bytes(data[at : at + 4], "little", signed=True), 32)
        return True

    strict = {i for i in range(len(data)) if called(i, 0, 0)}
    naive = {i for i in range(len(data)) if called(i, NAIVE_FIRST_IGNORES, NAIVE_IGNORES)}
    got = reports.check_bam(spark, path)["summary"].first()
    assert (got.positions, got.reads, got.fp, got.fn) == (len(data), len(strict), len(naive - strict), len(strict - naive)) and got.fp > 0


@pytest.fixture
def fooled(tmp_path):
    """A file of unmapped records, of 60 and 66 bytes in turn, in blocks of 127.  From the mate fields of a record of 60, at
    its byte 24, the naive rules take a record of length -1 that leads to the next one: they are wrong about the blocks that
    begin at one of the bytes 1 to 24 of such a record.  Gives the path, the blocks, the first of them the header's, and the numbers of the wrong ones."""
    path, n = tmp_path / "fooled.bam", 120  # the last block holds the start of a record, too
    write(path, [bam_codec.encode_record(f"e{i:07}", 4, 0, i, 0, "*", "ACGTNACGT" if i % 2 else "ACGTN", tags=bam_codec.encode_tag("VC", "i", i)) for i in range(n)], payload=127)
    with RandomAccess(str(path)) as file:
        metas = list(bgzf.block_metadata(file))
    wrong = [i for i in range(1, len(metas)) if 1 <= (i - 1) * 127 % 126 <= 24]
    assert len(metas) == 61 and len(wrong) == 24
    return str(path), metas, wrong


def test_block_report_says_where_the_naive_rules_are_fooled(spark, fooled):
    path, metas, wrong = fooled
    b = reports.check_blocks(spark, path)["summary"].first()
    assert (b.blocks, b.mismatched, b.bytes_at_risk) == (len(metas), len(wrong), sum(metas[i - 1].compressed_size for i in wrong))


def test_split_report_says_where_the_naive_rules_are_fooled(spark, fooled):
    """Splits smaller than blocks: each block with records is the first of a split of its own."""
    path, metas, wrong = fooled
    compared = reports.compare_splits(spark, [path], "64")
    f = compared["files"].first()
    assert (f.strict_splits, f.other_splits, f.only_strict, f.only_other) == (len(metas) - 1, len(metas) - 1, len(wrong), len(wrong))
    at = {metas[i].start: (i - 1) * 127 % 126 for i in wrong}  # the naive start is 24 bytes into a record, the strict one is the next record
    assert {(r.side, *r.start) for r in compared["differences"].collect()} == {x for b, o in at.items() for x in (("left", b, 60 - o), ("right", b, 24 - o))}


def test_places_choose_chunks_of_the_index(spark, tmp_path):
    rows = [(f"r{i}", 4 if i % 50 == 0 else 0, i % 3, i * 900, 9, "*" if i % 50 == 0 else "20M", "ACGT" * 5, {"VC": "1"}) for i in range(3000)]
    df = spark.createDataFrame(rows, "name string, flag int, ref_idx int, start long, mapq int, cigar string, seq string, tags map<string,string>")
    path = str(tmp_path / "x.bam")
    save.write_bam(df, path, [(f"c{i}", 1 << 29) for i in range(3)], payload=2000, level=0)
    for contig, lo, hi in (("c1", 500_000, 600_000), ("c2", 0, 1 << 29), ("c1", 900, 901), ("none", 0, 9), ("c0", 5, 5)):
        reads = load.load_placed(spark, path, contig, lo, hi, "4k", decode="core")
        assert sorted(r.name for r in reads.collect()) == sorted(r[0] for r in rows if f"c{r[2]}" == contig and lo <= r[3] < hi)
    assert load.load_placed(spark, path, "c1", 500_000, 600_000, "4k").rdd.getNumPartitions() < load.load_bam(spark, path, "4k").rdd.getNumPartitions() / 4
    parts = str(tmp_path / "many")
    save.write_bam(df, parts, [(f"c{i}", 1 << 29) for i in range(3)], parts=3, folder=True)
    names = sorted(f.name for f in (tmp_path / "many").iterdir() if not f.name.startswith("."))
    assert names == sorted(f"part-{i:05d}.bam{e}" for i in range(3) for e in ("", ".bai"))
    every = load.load_folder(spark, parts, "4k", decode="core")
    assert sorted(r.name for r in every.collect()) == sorted(r[0] for r in rows)
    inside = load.load_folder(spark, parts, "4k", decode="core", intervals="c1:500000-600000")
    assert sorted(r.name for r in inside.collect()) == sorted(r[0] for r in rows if r[2] == 1 and not r[1] and r[3] < 600000 and r[3] + 20 > 500000)
    few = load.load_intervals(spark, path, "c1:500000-600000", decode="core")
    assert few.columns == load.load_bam(spark, path, decode="core").columns
    assert sorted(r.name for r in few.collect()) == sorted(r[0] for r in rows if r[2] == 1 and not r[1] and r[3] < 600000 and r[3] + 20 > 500000)


def test_summary_rows_and_limits(spark, bam, tmp_path):
    path, at = bam
    rows = reports.summary_rows(spark, [path])
    assert rows.columns == list(reports.TSV_COLUMNS) and rows.first().reads == len(at)
    reports.write_tsv(rows, str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "t")).first().reads == str(len(at))
    some = spark.createDataFrame([("a",), ("b",), ("c",)], "x string")
    assert reports.limited(some, 3, "{n} lines:") == "3 lines:\n\ta\n\tb\n\tc\n"
    assert reports.limited(some, 2, "{n} lines:", "{most} of {n}:") == "2 of 3:\n\ta\n\tb\n\t\u2026\n"
    timed = reports.time_load(spark, path, "2k").collect()
    assert timed[0].splits == timed[1].splits > 1


def test_own_checker(spark, bam):
    path, at = bam
    register_checker("own", NaiveChecker)
    assert reports.check_bam(spark, path, other="own")["summary"].first().reads == len(at)
    assert loaded(spark, path, "2k", decode="none", checker="readloom.operators.checker:NaiveChecker") == at
    with pytest.raises(Exception, match="no checker"):
        loaded(spark, path, "2k", checker="nothing")


def test_block_tables_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.blocks").write_text("0,10,30\n10,20,60\n")
    q = arrivals.ratios(arrivals.block_tables(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("ratios").start()
    q.processAllAvailable()
    (tmp_path / "in" / "b.blocks").write_text("0,10,20\n")
    q.processAllAvailable()
    assert {(r.file, r.blocks, r.ratio) for r in spark.table("ratios").collect()} == {("a.blocks", 2, 3.0), ("b.blocks", 1, 2.0)}
    q.stop()
