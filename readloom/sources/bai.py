"""The companion index of a sorted alignment file: reading, building, and looking up intervals."""

from __future__ import annotations

import struct
from typing import NamedTuple

from readloom.functions.pos import plain_distance
from readloom.sources.bam_codec import reg2bin, reg2bins
from readloom.sources.files import RandomAccess, extension

MAGIC = b"BAI\1"
META_BIN = 37450
WINDOW = 14  # bits of a linear window

Pos = tuple[int, int]


class Chunk(NamedTuple):
    start: Pos
    end: Pos


class Metadata(NamedTuple):
    unmapped_begin: Pos
    unmapped_end: Pos
    n_mapped: int
    n_unmapped: int


class Reference(NamedTuple):
    bins: dict[int, list[Chunk]]
    linear: list[Pos]
    metadata: Metadata | None


def unpack(v: int) -> Pos:
    return v >> 16, v & 0xFFFF


def index_path(path: str) -> str:
    if extension(path) == "bai":
        return path
    if extension(path) == "bam":
        return path + ".bai"
    raise ValueError(f"{path} is neither an alignment file nor an index")


def read_index(path: str) -> list[Reference]:
    with RandomAccess(index_path(path)) as file:
        data = file.read(0, file.size)
    if data[:4] != MAGIC:
        raise OSError(f"{index_path(path)} is no index")
    at = 4

    def take(kind: str):
        nonlocal at
        values = struct.unpack_from("<" + kind, data, at)
        at += struct.calcsize("<" + kind)
        return values

    out = []
    for _ in range(take("i")[0]):
        bins, meta = {}, None
        for _ in range(take("i")[0]):
            number, n = take("Ii")
            chunks = [take("QQ") for _ in range(n)]
            if number == META_BIN:
                if n != 2 or meta:
                    raise OSError(f"a reference of {path} has {n} entries of metadata")
                meta = Metadata(unpack(chunks[0][0]), unpack(chunks[0][1]), *chunks[1])
            else:
                bins[number] = [Chunk(unpack(a), unpack(b)) for a, b in chunks]
        linear = [unpack(v) for v in take(f"{take('i')[0]}Q")]
        out.append(Reference(bins, linear, meta))
    return out


class IndexBuilder:
    """Gathers (bin, chunk) entries of records in file order; positions are packed."""

    def __init__(self) -> None:
        self.bins: dict[int, dict[int, list[list[int]]]] = {}
        self.linear: dict[int, dict[int, int]] = {}

    def add(self, ref: int, start: int, end: int, begin: int, stop: int) -> None:
        if ref < 0:
            return
        chunks = self.bins.setdefault(ref, {}).setdefault(reg2bin(start, end), [])
        if chunks and chunks[-1][1] >> 16 == begin >> 16:
            chunks[-1][1] = stop
        else:
            chunks.append([begin, stop])
        windows = self.linear.setdefault(ref, {})
        for w in range(start >> WINDOW, (max(end, start + 1) - 1 >> WINDOW) + 1):
            windows.setdefault(w, begin)

    def shifted(self, by: int, other: IndexBuilder) -> None:
        """Adds the entries of a later fragment that begins ``by`` bytes into the file."""
        by <<= 16
        for ref, bins in other.bins.items():
            for number, chunks in bins.items():
                self.bins.setdefault(ref, {}).setdefault(number, []).extend([a + by, b + by] for a, b in chunks)
        for ref, windows in other.linear.items():
            mine = self.linear.setdefault(ref, {})
            for w, v in windows.items():
                mine.setdefault(w, v + by)

    def encode(self, n_refs: int) -> bytes:
        out = [MAGIC, struct.pack("<i", n_refs)]
        for ref in range(n_refs):
            bins, windows = self.bins.get(ref, {}), self.linear.get(ref, {})
            out.append(struct.pack("<i", len(bins)))
            for number, chunks in sorted(bins.items()):
                out.append(struct.pack("<Ii", number, len(chunks)))
                out += [struct.pack("<QQ", *c) for c in chunks]
            n, last, entries = max(windows, default=-1) + 1, 0, []
            for w in range(n):
                last = windows.get(w, last)
                entries.append(last)
            out.append(struct.pack(f"<i{n}Q", n, *entries))
        return b"".join(out)


def merged(chunks: list[Chunk]) -> list[Chunk]:
    """Chunks in order, those that touch or overlap, or share a block, joined."""
    out: list[Chunk] = []
    for c in sorted(chunks):
        if out and c.start <= out[-1].end:
            out[-1] = Chunk(out[-1].start, max(out[-1].end, c.end))
        else:
            out.append(c)
    return out


def interval_chunks(index: list[Reference], intervals: dict[int, list[tuple[int, int]]]) -> list[Chunk]:
    """The chunks that may hold records overlapping the intervals (by reference number), merged."""
    found: list[Chunk] = []
    for ref, ranges in intervals.items():
        bins, linear, _ = index[ref]
        for lo, hi in ranges:
            least = linear[min(lo >> WINDOW, len(linear) - 1)] if linear else (0, 0)
            for number in reg2bins(lo, hi):
                found += [c for c in bins.get(number, []) if c.end > least]
    return merged(found)


def cost_groups(chunks: list[Chunk], most: int, ratio: float) -> list[list[Chunk]]:
    """Chunks in order, grouped greedily so that a group's estimated bytes stay within ``most``; a chunk beyond that is
    a group of its own."""
    groups: list[list[Chunk]] = []
    total = most + 1
    for c in chunks:
        cost = plain_distance(c.start, c.end, ratio)
        if total + cost > most or cost > most:
            groups.append([])
            total = 0
        groups[-1].append(c)
        total += cost
    return groups
