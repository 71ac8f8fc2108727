"""Byte sizes, byte and index ranges, and genomic intervals: parsers, and predicates over columns."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def parse_bytes(text: str | int) -> int:
    """``16m``, ``32MB``, ``100k`` or a plain number; units are binary."""
    if isinstance(text, int):
        return text
    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([kmgt]?)i?b?\s*", text, re.I)
    if not m:
        raise ValueError(f"not a byte size: {text!r}")
    return int(float(m[1]) * _UNITS[m[2].lower()])


def format_bytes(n: int, suffix: str = "") -> str:
    """Three significant figures and a binary unit: 25.6K, 583K, 1.50M."""
    units = ["", "K", "M", "G", "T"]
    x, i = float(n), 0
    while x >= 1024 and i < len(units) - 1:
        x, i = x / 1024, i + 1
    return (str(n) if not i else f"{x:.{max(0, 3 - len(str(int(x))))}f}{units[i]}") + suffix


def parse_ranges(text: str, sizes: bool = True) -> list[tuple[int, int]]:
    """``a-b``, ``a+length`` and ``a``, comma-separated, as half-open ranges, joined and in order.

    All parts that can't be read are reported at once.
    """
    number = parse_bytes if sizes else int
    out, bad = [], []
    for part in filter(None, (p.strip() for p in text.split(","))):
        try:
            if "-" in part:
                lo, hi = map(number, part.split("-", 1))
            elif "+" in part:
                lo, n = map(number, part.split("+", 1))
                hi = lo + n
            else:
                lo = number(part)
                hi = lo + 1
            if hi < lo:
                raise ValueError
            out.append((lo, hi))
        except ValueError:
            bad.append(part)
    if bad:
        raise ValueError("not ranges: " + ", ".join(bad))
    return coalesce(out)


def coalesce(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open ranges as disjoint ones in order; touching ranges become one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(r for r in ranges if r[0] < r[1]):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def intersects(ranges: list[tuple[int, int]] | None, lo: int, hi: int) -> bool:
    """Whether [lo, hi) meets any of ``ranges``; None stands for everything."""
    return ranges is None or any(a < hi and b > lo for a, b in ranges)


def within(column: Column, ranges: list[tuple[int, int]] | None) -> Column:
    """Whether a value lies in any of the half-open ranges; None keeps all."""
    if ranges is None:
        return F.lit(True)
    return reduce(lambda a, b: a | b, ((column >= lo) & (column < hi) for lo, hi in ranges), F.lit(False))


def parse_intervals(text: str | Iterable[str], lengths: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """``contig:start-end``, ``contig:start-`` or ``contig``, half-open from 0, as disjoint ranges for each contig.

    Open ends are the contig's length; a contig that isn't known is an error.
    """
    found: dict[str, list[tuple[int, int]]] = {}
    for part in filter(None, (p.strip() for p in (text.split(",") if isinstance(text, str) else text))):
        m = re.fullmatch(r"(.+?)(?::([0-9]+)-([0-9]*))?", part)
        contig = m[1]
        if contig not in lengths:
            raise ValueError(f"no contig {contig!r}")
        lo, hi = int(m[2] or 0), int(m[3]) if m[3] else lengths[contig]
        found.setdefault(contig, []).append((lo, hi))
    return {c: coalesce(r) for c, r in found.items()}


def loci(column: Column) -> Column:
    """A struct (contig, start, end) from ``contig:start-end``; ``end`` is null if it is open."""
    pattern = r"^(.+?):([0-9]+)-([0-9]*)$"
    part = lambda i: F.regexp_extract(column, pattern, i)
    return F.struct(part(1).alias("contig"), part(2).try_cast("bigint").alias("start"), part(3).try_cast("bigint").alias("end"))


def overlaps(contig: Column, start: Column, end: Column, flag: Column, intervals: dict[str, list[tuple[int, int]]]) -> Column:
    """Whether a mapped read's [start, end) meets an interval; a read that isn't mapped never does."""
    one = lambda c, lo, hi: (contig == c) & (start < hi) & (end > lo)
    some = reduce(lambda a, b: a | b, (one(c, lo, hi) for c, rs in intervals.items() for lo, hi in rs), F.lit(False))
    return (flag.bitwiseAND(F.lit(4)) == 0) & some
