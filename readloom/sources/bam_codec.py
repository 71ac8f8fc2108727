"""Headers and records of binary alignment files, after the public format specification."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from readloom.sources.bgzf import Inflated
from readloom.sources.files import RandomAccess

# Fixed values of the format.
BAM_MAGIC = b"BAM\1"
FIXED = struct.Struct("<iiiBBHHHiiii")
FIXED_BYTES = 36
CIGAR_OPS = "MIDNSHP=X"
CONSUMES_REFERENCE = frozenset("MDN=X")
BASES = "=ACMGRSVTWYHKDBN"
_bases_of_hex = str.maketrans("0123456789abcdef", BASES)
_shown_quality = bytes((q + 33) & 0xFF for q in range(256))

UNMAPPED = 4


class TruncatedRecord(EOFError):
    def __init__(self, pos: tuple[int, int]):
        super().__init__(f"the file ends within the record at {pos[0]}:{pos[1]}")
        self.pos = pos


class Header(NamedTuple):
    """Contig names and lengths by index, the virtual position after the header, its inflated size, and its text."""

    contigs: tuple[tuple[str, int], ...]
    end: tuple[int, int]
    size: int
    text: str

    @property
    def lengths(self) -> list[int]:
        return [n for _, n in self.contigs]


def read_header(file: RandomAccess) -> Header:
    data = Inflated(file, 0)

    def take(at: int, n: int) -> bytes:
        if not data.ensure(at + n):
            raise EOFError(f"{file.path} ends within its header")
        return bytes(data.data[at : at + n])

    if take(0, 4) != BAM_MAGIC:
        raise ValueError(f"{file.path} doesn't begin as an alignment file")
    (n_text,) = struct.unpack("<i", take(4, 4))
    text = take(8, n_text).rstrip(b"\0").decode("utf-8", "replace")
    (n,) = struct.unpack("<i", take(8 + n_text, 4))
    at, contigs = 12 + n_text, []
    for _ in range(n):
        (k,) = struct.unpack("<i", take(at, 4))
        name = take(at + 4, k)[:-1].decode("ascii", "replace")
        (length,) = struct.unpack("<i", take(at + 4 + k, 4))
        contigs.append((name, length))
        at += 8 + k
    data.ensure(at + 1)
    return Header(tuple(contigs), data.position(at), at, text)


def encode_header(contigs: list[tuple[str, int]], text: str | None = None) -> bytes:
    if text is None:
        text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{name}\tLN:{n}\n" for name, n in contigs)
    raw = text.encode()
    out = [BAM_MAGIC, struct.pack("<i", len(raw)), raw, struct.pack("<i", len(contigs))]
    for name, n in contigs:
        out += [struct.pack("<i", len(name) + 1), name.encode(), b"\0", struct.pack("<i", n)]
    return b"".join(out)


def reg2bin(start: int, end: int) -> int:
    """The smallest bin that holds [start, end)."""
    end = max(end, start + 1) - 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return first + (start >> shift)
    return 0


def reg2bins(start: int, end: int) -> list[int]:
    """All bins that may hold something overlapping [start, end)."""
    end = max(end, start + 1) - 1
    out = [0]
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out += range(first + (start >> shift), first + (end >> shift) + 1)
    return out


def parse_cigar(cigar: str) -> list[tuple[int, str]]:
    out, n = [], ""
    for c in "" if cigar in ("", "*") else cigar:
        if c.isdigit():
            n += c
        else:
            out.append((int(n), c))
            n = ""
    return out


def reference_length(ops: list[tuple[int, str]]) -> int:
    return sum(n for n, op in ops if op in CONSUMES_REFERENCE)


def encode_record(name: str, flag: int, ref: int, pos: int, mapq: int, cigar: str, seq: str, qual: bytes | None = None, mate_ref: int = -1, mate_pos: int = -1, tlen: int = 0, tags: bytes = b"") -> bytes:
    """One record with its length; ``pos`` counts from 0, ``qual`` is raw (missing: 0xff)."""
    ops = parse_cigar(cigar)
    nibbles = [BASES.index(c) for c in seq]
    packed = bytes((a << 4) | b for a, b in zip(nibbles[::2], [*nibbles[1::2], 0][: (len(nibbles) + 1) // 2]))
    raw = name.encode("ascii") + b"\0"
    span = reference_length(ops) or 1
    body = b"".join([raw, struct.pack(f"<{len(ops)}I", *[n << 4 | CIGAR_OPS.index(op) for n, op in ops]), packed, qual if qual is not None else b"\xff" * len(seq), tags])
    bin_ = reg2bin(pos, pos + span) if pos >= 0 else 4680
    return FIXED.pack(FIXED_BYTES - 4 + len(body), ref, pos, len(raw), mapq, bin_, len(ops), flag, len(seq), mate_ref, mate_pos, tlen) + body


def encode_tag(name: str, kind: str, value) -> bytes:
    """A tag of kind i (32-bit), f, A or Z."""
    head = name.encode() + kind.encode()
    if kind == "Z":
        return head + str(value).encode() + b"\0"
    return head + (str(value).encode() if kind == "A" else struct.pack("<" + kind, value))


_TAG = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def decode_tags(data: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode("ascii", "replace"), chr(data[at + 2])
        at += 3
        if kind in _TAG:
            (value,) = struct.unpack_from("<" + _TAG[kind], data, at)
            at += struct.calcsize(_TAG[kind])
        elif kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind in "ZH":
            stop = data.index(0, at)
            value, at = data[at:stop].decode("ascii", "replace"), stop + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<I", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{_TAG[sub]}", data, at + 5)
            value, at = sub + "".join(f",{v}" for v in values), at + 5 + n * struct.calcsize(_TAG[sub])
        else:
            raise ValueError(f"unknown kind {kind!r} of tag {name}")
        out[name] = str(value)
    return out


def record_offsets(data: Inflated, start: int, end_block: int, strict: bool = True) -> Iterator[int]:
    """Offsets in ``data`` of the records from ``start`` on whose block begins before ``end_block``, each with all its
    bytes read.  A record cut short raises TruncatedRecord, or ends the records if not ``strict``."""
    at = start
    while data.ensure(at + 1):
        if data.position(at)[0] >= end_block:
            return
        whole = data.ensure(at + 4)
        if whole:
            (n,) = struct.unpack_from("<i", data.data, at)
            whole = n >= 32 and data.ensure(at + 4 + n)
        if not whole:
            if strict:
                raise TruncatedRecord(data.position(at))
            return
        yield at
        at += 4 + n


#: Columns by how much of a record is decoded.
SCHEMAS = {
    "none": "block_pos long, offset int, record_bytes int",
    "core": "block_pos long, offset int, record_bytes int, ref_idx int, contig string, start long, mapq int, bin int, flag int, n_cigar int, seq_len int, mate_ref_idx int, mate_contig string, mate_start long, tlen int, name string",
}
SCHEMAS["full"] = SCHEMAS["core"] + ", end long, cigar string, seq string, qual string, tags map<string,string>"


def decode(data: Inflated, offsets: list[int], contigs: tuple[tuple[str, int], ...], level: str) -> dict[str, list | np.ndarray]:
    """The columns of SCHEMAS[level] for the records at ``offsets``; fixed fields by one gather over all records.

    Level ``ends``: those of ``core`` and ``end``.
    """
    at = np.array(offsets, np.int64)
    block, offset = data.positions(at)
    raw = np.frombuffer(bytes(data.data), np.uint8)
    fixed = raw[at[:, None] + np.arange(FIXED_BYTES)].view("<i4").reshape(-1, 9) if len(at) else np.zeros((0, 9), np.int32)
    out: dict[str, list | np.ndarray] = {"block_pos": block, "offset": offset, "record_bytes": fixed[:, 0].copy()}
    if level == "none":
        return out
    word3, word4 = fixed[:, 3].view(np.uint32), fixed[:, 4].view(np.uint32)
    name_of = lambda idx: [contigs[i][0] if 0 <= i < len(contigs) else None for i in idx.tolist()]
    n_name, n_cigar = (word3 & 0xFF).astype(np.int64), (word4 & 0xFFFF).astype(np.int64)
    out |= {
        "ref_idx": fixed[:, 1].copy(), "contig": name_of(fixed[:, 1]), "start": fixed[:, 2].astype(np.int64), "mapq": (word3 >> 8 & 0xFF).astype(np.int32), "bin": (word3 >> 16).astype(np.int32),
        "flag": (word4 >> 16).astype(np.int32), "n_cigar": n_cigar.astype(np.int32), "seq_len": fixed[:, 5].copy(), "mate_ref_idx": fixed[:, 6].copy(), "mate_contig": name_of(fixed[:, 6]), "mate_start": fixed[:, 7].astype(np.int64), "tlen": fixed[:, 8].copy(),
    }
    names_at = (at + FIXED_BYTES).tolist()
    bytes_ = bytes(data.data)
    out["name"] = [bytes_[a : a + max(0, n - 1)].decode("ascii", "replace") for a, n in zip(names_at, n_name.tolist())]
    if level == "ends":
        single = n_cigar == 1  # most records have one operation, which is read for all of them at once
        ends = out["start"] + 1
        first = at + FIXED_BYTES + n_name
        v = raw[first[single][:, None] + np.arange(4)].copy().view("<u4").ravel() if single.any() else np.zeros(0, np.uint32)
        takes = np.isin(v & 15, [CIGAR_OPS.index(op) for op in CONSUMES_REFERENCE])
        ends[single] = out["start"][single] + np.where(takes, np.maximum(v >> 4, 1), 1).astype(np.int64)
        for i in np.flatnonzero(n_cigar > 1).tolist():
            ops = [(v >> 4, CIGAR_OPS[v & 15]) for v in struct.unpack_from(f"<{n_cigar[i]}I", bytes_, int(first[i]))]
            ends[i] = out["start"][i] + (reference_length(ops) or 1)
        out["end"] = ends.tolist()
    if level == "full":
        ends, cigars, seqs, quals, tags = [], [], [], [], []
        for a, k, c, s, total, start in zip(at.tolist(), n_name.tolist(), n_cigar.tolist(), fixed[:, 5].tolist(), fixed[:, 0].tolist(), fixed[:, 2].tolist()):
            p = a + FIXED_BYTES + k
            ops = [(v >> 4, CIGAR_OPS[v & 15]) for v in struct.unpack_from(f"<{c}I", bytes_, p)]
            p += 4 * c
            packed = bytes_[p : p + (s + 1) // 2]
            p += len(packed)
            quality = bytes_[p : p + s]
            cigars.append("".join(f"{n}{op}" for n, op in ops) or "*")
            ends.append(start + (reference_length(ops) or 1))
            seqs.append(packed.hex().translate(_bases_of_hex)[:s] or "*")
            quals.append("*" if not s or quality[0] == 0xFF else quality.translate(_shown_quality).decode("latin-1"))
            tags.append(list(decode_tags(bytes_[p + s : a + 4 + total]).items()))
        out |= {"end": ends, "cigar": cigars, "seq": seqs, "qual": quals, "tags": tags}
    return out
