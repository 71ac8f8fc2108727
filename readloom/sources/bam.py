"""Data sources for alignment files: ``bam`` (read and write) and ``bgzf_blocks``.

A read plans byte ranges from the file's size alone.  Each task finds the first block in its range, then the first
record by the checker, and reads the records whose block begins in the range, however far their bytes go: every record
belongs to one task, for any split size.  With ``intervals``, tasks get groups of the companion index's chunks instead.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from readloom.functions.ranges import intersects, parse_bytes, parse_intervals, parse_ranges
from readloom.operators.checker import MAX_READ_SIZE, READS_TO_CHECK, checker
from readloom.sources import bai, bam_codec
from readloom.sources.bgzf import BLOCKS_TO_CHECK, MAX_PAYLOAD, TRAILER, BlockWriter, Inflated, block_metadata, find_block_start
from readloom.sources.files import RandomAccess, filesystem, size_of, write_bytes

SPLIT_SIZE = 32 << 20
BATCH = 4096


def paths_of(path: str) -> list[str]:
    """``path`` itself, or the alignment files in it if it is a folder."""
    from pyarrow import fs

    system, name = filesystem(path)
    if system.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    found = system.get_file_info(fs.FileSelector(name))
    return sorted(path.rstrip("/") + "/" + f.base_name for f in found if f.extension == "bam")


@dataclass
class ByteRange(InputPartition):
    path: str
    split: int
    start: int
    end: int


@dataclass
class ChunkGroup(InputPartition):
    path: str
    split: int
    chunks: list


class BamReader(DataSourceReader):
    """Options: ``path``, ``split_size``, ``decode`` (none, core or full), ``checker``, ``intervals`` and ``ratio``,
    ``place`` (JSON: a range of starts for each contig; all records of the index's chunks for them are read), ``mode``,
    and the bounds of the searches."""

    def __init__(self, options: dict[str, str]):
        o = {k.lower(): v for k, v in options.items()}
        if not o.get("path"):
            raise ValueError("a path is needed")
        self.path = o["path"]
        self.split_size = parse_bytes(o.get("split_size", SPLIT_SIZE))
        self.level = o.get("decode", "full")
        self.blocks_to_check = int(o.get("blocks_to_check", BLOCKS_TO_CHECK))
        self.reads_to_check = int(o.get("reads_to_check", READS_TO_CHECK))
        self.max_read_size = int(o.get("max_read_size", MAX_READ_SIZE))
        self.checker = o.get("checker", "strict")
        self.intervals = o.get("intervals")
        self.place = json.loads(o["place"]) if o.get("place") else None
        self.ratio = float(o.get("ratio", 3.0))
        self.strict = o.get("mode", "FAILFAST").upper() == "FAILFAST"
        checker(self.checker)
        if self.level not in bam_codec.SCHEMAS:
            raise ValueError(f"no decode level {self.level!r}")

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in paths_of(self.path):
            if self.intervals is not None:
                with RandomAccess(path) as file:
                    header = bam_codec.read_header(file)
                wanted = parse_intervals(self.intervals, dict(header.contigs))
                number = {name: i for i, (name, _) in enumerate(header.contigs)}
                chunks = bai.interval_chunks(bai.read_index(path), {number[c]: r for c, r in wanted.items()})
                out += [ChunkGroup(path, len(out) + i, [tuple(c) for c in g]) for i, g in enumerate(bai.cost_groups(chunks, self.split_size, self.ratio))]
            elif self.place is not None:
                with RandomAccess(path) as file:
                    header = bam_codec.read_header(file)
                ranges = {i: [tuple(self.place[name])] for i, (name, _) in enumerate(header.contigs) if name in self.place}
                chunks = bai.interval_chunks(bai.read_index(path), ranges)
                out += [ChunkGroup(path, len(out) + i, [tuple(c) for c in g]) for i, g in enumerate(bai.cost_groups(chunks, self.split_size, self.ratio))]
            else:
                n = math.ceil(size_of(path) / self.split_size)
                out += [ByteRange(path, len(out) + i, i * self.split_size, (i + 1) * self.split_size) for i in range(n)]
        return out

    def read(self, part: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # nothing was planned
            return
        with RandomAccess(part.path) as file:
            header = bam_codec.read_header(file)
            if isinstance(part, ChunkGroup):
                wanted = None if self.intervals is None else parse_intervals(self.intervals, dict(header.contigs))
                for start, end in part.chunks:
                    data = Inflated(file, start[0])
                    yield from self.rows(part, header, data, start[1], tuple(end), wanted)
                return
            found = self.first(file, header, part.start, part.end)
            if found:
                yield from self.rows(part, header, *found, (part.end, 0), None)

    def first(self, file: RandomAccess, header: bam_codec.Header, start: int, end: int) -> tuple[Inflated, int] | None:
        """The stream and the offset of the first record that may belong to [start, end)."""
        block = find_block_start(file, start, self.blocks_to_check) if start else 0
        if block <= header.end[0]:
            return (Inflated(file, header.end[0]), header.end[1]) if header.end[0] < end else None
        if block >= min(end, file.size):
            return None
        data = Inflated(file, block)
        at = checker(self.checker)(data, header.lengths, self.reads_to_check, self.max_read_size).next_start(0)
        if at is None:
            return None
        return data, at

    def rows(self, part, header: bam_codec.Header, data: Inflated, at: int, end: tuple[int, int], wanted: dict | None) -> Iterator[pa.RecordBatch]:
        going = True
        while going:
            offsets: list[int] = []
            going = False
            for offset in bam_codec.record_offsets(data, at, end[0] + (end[1] > 0), self.strict):
                if data.position(offset) >= end:
                    break
                if len(offsets) == BATCH:
                    going, at = True, offset
                    break
                offsets.append(offset)
            if offsets:
                yield self.batch(part, header, data, offsets, wanted)
            if going:
                data.discard(at)
                at = 0

    def batch(self, part, header, data: Inflated, offsets: list[int], wanted: dict | None) -> pa.RecordBatch:
        columns = bam_codec.decode(data, offsets, header.contigs, self.level if wanted is None or self.level == "full" else "ends")
        if wanted is not None:
            keep = [not f & bam_codec.UNMAPPED and any(s < hi and e > lo for lo, hi in wanted.get(c, ())) for c, s, e, f in zip(columns["contig"], columns["start"].tolist(), columns["end"], columns["flag"].tolist())]
        schema = arrow_schema(self.level)
        names = [f.name for f in schema if f.name not in ("split", "file")]
        arrays = [pa.array([part.split] * len(offsets), pa.int32()), pa.array([part.path] * len(offsets), pa.string())] + [pa.array(columns[n], schema.field(n).type) for n in names]
        out = pa.RecordBatch.from_arrays(arrays, schema=schema)
        return out if wanted is None else out.filter(pa.array(keep))


def first_of_split(path: str, start: int, end: int, checker_name: str = "strict") -> tuple[int, int] | None:
    """The position of the first record whose block begins in [start, end), if there is one."""
    reader = BamReader({"path": path, "checker": checker_name})
    with RandomAccess(path) as file:
        header = bam_codec.read_header(file)
        found = reader.first(file, header, start, end)
        if found is None or not found[0].ensure(found[1] + 1):
            return None
        at = found[0].position(found[1])
        return at if at < (end, 0) else None


def schema_of(level: str) -> str:
    return "split int, file string, " + bam_codec.SCHEMAS[level]


def arrow_schema(level: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in schema_of(level).split(", "))])


@dataclass
class Fragment(WriterCommitMessage):
    part: int
    path: str
    size: int
    index: bai.IndexBuilder


class BamWriter(DataSourceArrowWriter):
    """Writes rows, in their order, as one file: each task a fragment of whole blocks, joined at the commit, on the driver.

    With ``folder`` each task writes a whole file with its own index into the folder, and the commit only gives them their
    names, ``part-00000.bam`` and on: nothing passes through the driver, and ``load_folder`` reads them as one table.

    Columns: name, flag, ref_idx, start, mapq, cigar, seq, and if there qual (text), mate_ref_idx, mate_start, tlen,
    tags (map; values are written as text, or as numbers if they look like integers).
    Options: ``contigs`` (JSON list of [name, length]), ``block_aligned`` (a record never begins within a block that
    another began), ``index`` (write the companion index; rows must be sorted), ``payload`` (bytes of a block), ``level``
    (of compression; 0 stores), ``folder``.
    """

    def __init__(self, options: dict[str, str]):
        o = {k.lower(): v for k, v in options.items()}
        self.path, self.contigs = o["path"], [tuple(c) for c in json.loads(o["contigs"])]
        self.aligned, self.index = o.get("block_aligned", "false") == "true", o.get("index", "true") == "true"
        self.payload, self.level = int(o.get("payload", MAX_PAYLOAD)), int(o.get("level", 6))
        self.folder = o.get("folder", "false") == "true"
        self.parts = f"{self.path}/_parts-{uuid.uuid4().hex}" if self.folder else f"{self.path}.parts-{uuid.uuid4().hex}"

    def head(self) -> bytes:
        head = BlockWriter(self.payload, self.level)
        head.write(bam_codec.encode_header(list(self.contigs)))
        head.end_block()
        return head.take()

    def write(self, batches: Iterator[pa.RecordBatch]) -> Fragment:
        from pyspark import TaskContext

        system, base = filesystem(self.parts)
        system.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        out, index, size = BlockWriter(self.payload, self.level), bai.IndexBuilder(), 0
        head = self.head() if self.folder else b""
        with system.open_output_stream(f"{base}/{name}") as file:
            file.write(head)
            for batch in batches:
                for row in batch.to_pylist():
                    record = self.encode(row)
                    if self.aligned and len(out.open) + len(record) > self.payload:
                        out.end_block()
                    begin = out.tell()
                    out.write(record)
                    stop = out.tell()
                    span = bam_codec.reference_length(bam_codec.parse_cigar(row["cigar"] or "*")) or 1
                    index.add(row["ref_idx"], row["start"], row["start"] + span, begin[0] << 16 | begin[1], stop[0] << 16 | stop[1])
                chunk = out.take()
                file.write(chunk)
                size += len(chunk)
            out.end_block()
            chunk = out.take()
            file.write(chunk)
            size += len(chunk)
            file.write(TRAILER if self.folder else b"")
        if self.folder and self.index and size:
            whole = bai.IndexBuilder()
            whole.shifted(len(head), index)
            write_bytes(f"{self.parts}/{name}.bai", whole.encode(len(self.contigs)))
            index = bai.IndexBuilder()  # nothing to send
        return Fragment(TaskContext.get().partitionId(), f"{self.parts}/{name}", size, index)

    def encode(self, row: dict) -> bytes:
        qual = row.get("qual")
        tags = b"".join(bam_codec.encode_tag(k, *(("i", int(v)) if v.lstrip("-").isdigit() and len(v) < 10 else ("Z", v))) for k, v in (row.get("tags") or []))
        return bam_codec.encode_record(
            row["name"], row["flag"], row["ref_idx"], row["start"], row["mapq"], row["cigar"] or "*", "" if row["seq"] in (None, "*") else row["seq"],
            bytes(ord(c) - 33 for c in qual) if qual not in (None, "*") else None, _or(row.get("mate_ref_idx"), -1), _or(row.get("mate_start"), -1), _or(row.get("tlen"), 0), tags,
        )

    def commit(self, messages: list[Fragment | None]) -> None:
        found = sorted((m for m in messages if m and m.size), key=lambda m: m.part)
        system, name = filesystem(self.path)
        if self.folder:
            system.create_dir(name, recursive=True)
            for i, m in enumerate(found):
                for end in ("", ".bai") if self.index else ("",):
                    system.move(filesystem(m.path + end)[1], f"{name}/part-{i:05d}.bam{end}")
            return self.abort(messages)
        index, at = bai.IndexBuilder(), 0
        with system.open_output_stream(name) as out:
            raw = self.head()
            out.write(raw)
            at += len(raw)
            for m in found:
                with RandomAccess(m.path) as file:
                    for lo in range(0, file.size, 8 << 20):
                        out.write(file.read(lo, 8 << 20))
                index.shifted(at, m.index)
                at += m.size
            out.write(TRAILER)
        if self.index:
            write_bytes(self.path + ".bai", index.encode(len(self.contigs)))
        self.abort(messages)

    def abort(self, messages: list[Fragment | None]) -> None:
        from pyarrow import fs

        for where in {m.path.rpartition("/")[0] for m in messages if m}:
            system, base = filesystem(where)
            if system.get_file_info(base).type == fs.FileType.Directory:
                system.delete_dir(base)


def _or(value, default):
    return default if value is None else value


class BamSource(DataSource):
    """``spark.read.format("bam")``; options: see BamReader and BamWriter.

    It takes no filters from Spark: in Spark 4.1 those pushed into a Python source stay with the DataFrame, and the next
    query over it, with other filters, gets the first one's rows.  ``place`` and ``intervals`` say what to read.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return schema_of(self.options.get("decode", "full"))

    def reader(self, schema: StructType) -> BamReader:
        return BamReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> BamWriter:
        return BamWriter(dict(self.options))


class BlocksReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        o = {k.lower(): v for k, v in options.items()}
        self.path, self.split_size = o["path"], parse_bytes(o.get("split_size", SPLIT_SIZE))
        self.ranges = parse_ranges(o["ranges"]) if o.get("ranges") else None
        self.blocks_to_check = int(o.get("blocks_to_check", BLOCKS_TO_CHECK))

    def partitions(self) -> list[InputPartition]:
        size = size_of(self.path)
        parts = [ByteRange(self.path, i, i * self.split_size, (i + 1) * self.split_size) for i in range(math.ceil(size / self.split_size))]
        return [p for p in parts if intersects(self.ranges, p.start, p.end)]

    def read(self, part: ByteRange | None) -> Iterator[tuple]:
        if part is None:
            return
        with RandomAccess(part.path) as file:
            start = find_block_start(file, part.start, self.blocks_to_check) if part.start else 0
            for b in block_metadata(file, start, part.end):
                if intersects(self.ranges, b.start, b.start + 1):
                    yield (part.split, *b)


class BlocksSource(DataSource):
    """``spark.read.format("bgzf_blocks")``: split, start, compressed_size, uncompressed_size of a file's blocks.

    Options: ``split_size``, ``ranges`` (of block starts; splits that don't meet them aren't read)."""

    @classmethod
    def name(cls) -> str:
        return "bgzf_blocks"

    def schema(self) -> str:
        return "split int, start long, compressed_size int, uncompressed_size int"

    def reader(self, schema: StructType) -> BlocksReader:
        return BlocksReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)
    spark.dataSource.register(BlocksSource)
