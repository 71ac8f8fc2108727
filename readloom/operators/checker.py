"""Does a record start here?  The strict rules at one position or at all positions of a buffer, and a naive rule set.

A position is checked by decoding a record there: references and positions in range, a readable NUL-ended name, known
cigar operations, and a length that the fields account for.  A chain of records, each starting where the one before
ends, must pass; the end of the file right after a record counts.  Each failing rule is one bit.
"""

from __future__ import annotations

import importlib
import struct
from collections.abc import Callable

import numpy as np

from readloom.sources.bam_codec import FIXED_BYTES, UNMAPPED
from readloom.sources.bgzf import Inflated

#: Fixed names of the flags, in order of their bits.
FLAGS = (
    "tooFewFixedBlockBytes",
    "negativeReadIdx",
    "tooLargeReadIdx",
    "negativeReadPos",
    "tooLargeReadPos",
    "negativeNextReadIdx",
    "tooLargeNextReadIdx",
    "negativeNextReadPos",
    "tooLargeNextReadPos",
    "tooFewBytesForReadName",
    "nonNullTerminatedReadName",
    "nonASCIIReadName",
    "noReadName",
    "emptyReadName",
    "tooFewBytesForCigarOps",
    "invalidCigarOp",
    "emptyMappedCigar",
    "emptyMappedSeq",
    "tooFewRemainingBytesImplied",
)
BIT = {name: 1 << i for i, name in enumerate(FLAGS)}
READS_TO_CHECK = 10
MAX_READ_SIZE = 100_000_000
NEAR = 4096  # bytes beyond a view's positions; few records' names and cigars are longer
CUT = BIT["tooFewFixedBlockBytes"] | BIT["tooFewBytesForReadName"] | BIT["tooFewBytesForCigarOps"]

_allowed = np.zeros(256, bool)
_allowed[ord("!") : ord("?") + 1] = True
_allowed[ord("A") : ord("~") + 1] = True
_allowed_bytes = bytes(np.flatnonzero(_allowed).tolist())
_fixed = struct.Struct("<iiiIIiii").unpack_from


def _wrap(x: int) -> int:
    """As a signed 32-bit integer."""
    return (x + (1 << 31)) % (1 << 32) - (1 << 31)


#: What the naive rules don't look at; of a chain's first record they don't look at the cigar either.
NAIVE_IGNORES = BIT["tooLargeReadPos"] | BIT["tooLargeNextReadPos"] | BIT["nonASCIIReadName"] | BIT["emptyReadName"] | BIT["emptyMappedCigar"] | BIT["emptyMappedSeq"]
NAIVE_FIRST_IGNORES = NAIVE_IGNORES | BIT["invalidCigarOp"] | BIT["tooFewBytesForCigarOps"]


def record_flags(data: np.ndarray, n: int, lengths: np.ndarray) -> np.ndarray:
    """The flags of the single record at each of the first ``n`` positions of ``data`` (uint8).

    Where ``data`` isn't all there is, flags in CUT only say that the record goes on beyond it.
    """
    total = len(data)
    out = np.zeros(n, np.int32)
    short = np.arange(n) + FIXED_BYTES > total
    out[short] = BIT["tooFewFixedBlockBytes"]
    m = int((~short).sum())
    if not m:
        return out
    wide = data.astype(np.uint32)
    word = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
    field = lambda k: word[4 * k : 4 * k + m].view(np.int32)
    mask = np.zeros(m, np.int32)
    count = len(lengths)
    padded = np.append(lengths.astype(np.int64), 0)

    def reference(idx: np.ndarray, pos: np.ndarray, prefix: str) -> None:
        low, high, below = idx < -1, idx >= count, pos < -1
        mask[low] |= BIT[f"negative{prefix}Idx"]
        mask[high] |= BIT[f"tooLarge{prefix}Idx"]
        mask[below] |= BIT[f"negative{prefix}Pos"]
        known = (idx >= 0) & ~high & ~below
        mask[known & (pos > padded[np.where(known, idx, count)])] |= BIT[f"tooLarge{prefix}Pos"]

    reference(field(1), field(2), "Read")
    reference(field(6), field(7), "NextRead")
    remaining, seq = field(0), field(5)
    name = (field(3) & 0xFF).astype(np.int32)
    ops = (field(4) & 0xFFFF).astype(np.int32)
    unmapped = (field(4).view(np.uint32) >> 16) & UNMAPPED != 0
    with np.errstate(over="ignore"):  # 32-bit arithmetic that wraps, with division towards zero
        half = seq + np.int32(1)
        half = half // 2 + ((half < 0) & (half % 2 != 0))
        implied = np.int32(32) + name + np.int32(4) * ops + half.astype(np.int32) + seq
    mask[remaining < implied] |= BIT["tooFewRemainingBytesImplied"]

    start = np.arange(m, dtype=np.int64) + FIXED_BYTES
    mask[name == 0] |= BIT["noReadName"]
    mask[name == 1] |= BIT["emptyReadName"]
    named = name >= 2
    end = start + np.where(named, name, 0)
    cut = end > total
    mask[cut] |= BIT["tooFewBytesForReadName"]
    whole = named & ~cut
    last = data[np.where(whole, end - 1, 0)]
    open_ = whole & (last != 0)
    mask[open_] |= BIT["nonNullTerminatedReadName"]
    bad = np.concatenate([[0], np.cumsum(~_allowed[data])])
    inner = bad[np.where(whole, end - 1, 0)] - bad[np.where(whole, start, 0)]
    mask[whole & ~open_ & (inner > 0)] |= BIT["nonASCIIReadName"]

    # the first unknown operation at a stride of four bytes, from every byte on
    far = np.int64(1) << 40
    next_bad = np.full(total + 8, far, np.int64)
    at = np.where((data & 0xF) > 8, np.arange(total), far)
    for r in range(4):
        lane = at[r::4]
        next_bad[r:total:4] = np.minimum.accumulate(lane[::-1])[::-1]
    first = next_bad[np.minimum(end, total + 7)]
    stop = end + 4 * ops.astype(np.int64)
    first = np.where(first + 4 <= total, first, far)  # an operation whose bytes end beyond is cut, not unknown
    unknown = ~cut & (first < stop)
    mask[unknown] |= BIT["invalidCigarOp"]
    lacking = ~cut & ~unknown & (stop > total)
    mask[lacking] |= BIT["tooFewBytesForCigarOps"]
    valid = ~cut & ~unknown & ~lacking & ~unmapped
    mask[valid & (seq == 0)] |= BIT["emptyMappedSeq"]
    mask[valid & (ops == 0)] |= BIT["emptyMappedCigar"]
    out[:m] = mask
    return out


class Checker:
    """The strict rules over a stream of inflated bytes."""

    def __init__(self, data: Inflated, lengths: list[int], reads_to_check: int = READS_TO_CHECK, max_read_size: int = MAX_READ_SIZE):
        self.data, self.lengths = data, np.array(lengths, np.int64)
        self.reads, self.max_read_size = reads_to_check, max_read_size
        self.known: dict[int, int] = {}

    first_ignores = ignores = 0

    def one(self, at: int) -> int:
        """The flags of the record at one offset; reads on no further than the rules must look."""
        if at not in self.known:
            self.known[at] = self._one(at)
        return self.known[at]

    def _one(self, at: int) -> int:
        have = self.data.ensure
        if not have(at + FIXED_BYTES):
            return BIT["tooFewFixedBlockBytes"]
        size, ref, pos, word3, word4, seq, next_ref, next_pos = _fixed(self.data.data, at)
        out = self._place(ref, pos, "Read") | self._place(next_ref, next_pos, "NextRead")
        name, ops = word3 & 0xFF, word4 & 0xFFFF
        half = _wrap(seq + 1)
        half = half // 2 if half >= 0 else -(-half // 2)
        if size < _wrap(32 + name + 4 * ops + half + seq):
            out |= BIT["tooFewRemainingBytesImplied"]
        at += FIXED_BYTES
        if name < 2:
            out |= BIT["emptyReadName" if name else "noReadName"]
        elif not have(at + name):
            return out | BIT["tooFewBytesForReadName"]
        else:
            text = self.data.data[at : at + name]
            at += name
            if text[-1]:
                out |= BIT["nonNullTerminatedReadName"]
            elif text[:-1].translate(None, _allowed_bytes):
                out |= BIT["nonASCIIReadName"]
        for _ in range(ops):
            if not have(at + 4):
                return out | BIT["tooFewBytesForCigarOps"]
            if self.data.data[at] & 0xF > 8:
                return out | BIT["invalidCigarOp"]
            at += 4
        if not word4 >> 16 & UNMAPPED:
            out |= BIT["emptyMappedSeq"] * (seq == 0) | BIT["emptyMappedCigar"] * (ops == 0)
        return out

    def _place(self, idx: int, pos: int, prefix: str) -> int:
        count = len(self.lengths)
        out = BIT[f"negative{prefix}Idx"] if idx < -1 else BIT[f"tooLarge{prefix}Idx"] if idx >= count else 0
        if pos < -1:
            return out | BIT[f"negative{prefix}Pos"]
        return out | BIT[f"tooLarge{prefix}Pos"] if 0 <= idx < count and pos > self.lengths[idx] else out

    def _flags(self, start: int, stop: int) -> np.ndarray:
        """The flags of the record at every offset of [start, stop).  The view ends a little beyond; the few positions
        whose record goes on from there are looked at one by one."""
        self.data.ensure(stop + NEAR)
        view = np.frombuffer(bytes(self.data.data[start : stop + NEAR]), np.uint8)
        flags = record_flags(view, min(stop, len(self.data.data)) - start, self.lengths)
        if self.data.ensure(stop + NEAR + 1):
            for i in np.flatnonzero(flags & CUT).tolist():
                flags[i] = self.one(start + i)
        return flags

    def _next(self, at: int) -> int:
        n = int.from_bytes(self.data.data[at : at + 4], "little", signed=True)
        return at + 4 + max(n, 32)

    def call(self, at: int) -> tuple[bool, int, int]:
        """(a record starts here, flags of the record that fails or 0, records before it or parsed)"""
        parsed, first = 0, at
        while parsed < self.reads:
            if parsed and not self.data.ensure(at + 1):
                # all of the last record must be there for the file to end right after it
                return (True, 0, parsed) if at == len(self.data.data) else (False, BIT["tooFewFixedBlockBytes"], parsed)
            flags = self.one(at) & ~(self.first_ignores if at == first else self.ignores)
            if flags:
                return False, flags, parsed
            parsed += 1
            at = self._next(at)
        return True, 0, parsed

    def calls(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``call`` at every offset of [start, stop): records are followed only where the first one passes."""
        flags = self._flags(start, stop)
        self.known.update((start + i, 0) for i in np.flatnonzero(flags == 0).tolist())
        flags &= ~self.first_ignores
        ok = flags == 0
        before = np.zeros(stop - start, np.int32)
        for i in np.flatnonzero(ok).tolist():
            ok[i], flags[i], before[i] = self.call(start + i)
        return ok, flags, before

    def next_start(self, at: int) -> int | None:
        """The first offset from ``at`` on, at most max_read_size bytes away, where a record starts."""
        end, step = at + self.max_read_size, 1 << 14
        while at < end and self.data.ensure(at + 1):
            self.data.ensure(at + step)
            upto = min(at + step, end, len(self.data.data))
            for i in np.flatnonzero(self._flags(at, upto) & ~self.first_ignores == 0).tolist():
                if self.call(at + i)[0]:
                    return at + i
            at = upto
        return None


class NaiveChecker(Checker):
    """Weaker rules, to compare with: they overlook what NAIVE_IGNORES lists."""

    first_ignores, ignores = NAIVE_FIRST_IGNORES, NAIVE_IGNORES


_registered: dict[str, Callable[..., Checker]] = {"strict": Checker, "naive": NaiveChecker}


def register_checker(name: str, make: Callable[..., Checker]) -> None:
    """Makes ``make(data, lengths, reads_to_check, max_read_size)`` available to the reports of this process by name.

    Data sources are planned and read in other processes; they take a checker of one's own as ``module:attribute``.
    """
    _registered[name] = make


def checker(name: str) -> Callable[..., Checker]:
    if name in _registered:
        return _registered[name]
    module, colon, attribute = name.partition(":")
    if not colon:
        raise ValueError(f"no checker {name!r}; there are {', '.join(sorted(_registered))}")
    return getattr(importlib.import_module(module), attribute)
