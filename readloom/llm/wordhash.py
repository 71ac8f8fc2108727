"""Hashes of words and of word n-grams, for whole batches of texts at once.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text.  All hashes are 64-bit, the same in
every process; what must be exact is compared again as words or on whole sets by the operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
PIECE = 4 << 20
_BASE = 0x9E3779B97F4A7C15
_powers, _inverses = [np.ones(1, U)], [np.ones(1, U)]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers, another for each seed."""
    x = x + U((seed * 0xA0761D6478BD642F + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> np.ndarray:
    """1, b, b^2, ... up to the n-th, modulo 2^64."""
    if len(_powers[0]) <= n:
        p = np.full(2 * n + 64, U(_BASE))
        p[0] = 1
        _powers[0] = np.cumprod(p, dtype=U)
    return _powers[0]


def inverses(n: int) -> np.ndarray:
    """1, 1/b, 1/b^2, ... up to the n-th, modulo 2^64."""
    if len(_inverses[0]) <= n:
        p = np.full(2 * n + 64, U(pow(_BASE, -1, 1 << 64)))
        p[0] = 1
        _inverses[0] = np.cumprod(p, dtype=U)
    return _inverses[0]


def blocks(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts): runs of about ``most`` characters, or one longer text alone."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        if i > start and n + len(t) > most:
            yield start, texts[start:i]
            start, n = i, 0
        n += len(t)
    if start < len(texts):
        yield start, texts[start:]


def _words(raw: np.ndarray, lo: int, hi: int, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words in raw[lo:hi], which no word crosses the ends of."""
    at = np.flatnonzero(~_SPACE[raw[lo:hi]])
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    at += lo
    opens = np.ones(len(at), bool)
    opens[1:] = np.diff(at) > 1
    where = np.flatnonzero(opens)
    length = np.diff(np.append(where, len(at)))
    k = np.repeat(where + length, length) - np.arange(len(at))
    value = (_LOWER if lower else _SAME)[raw[at]].astype(U) + U(1)
    start = at[where]
    return start, start + length, mix(np.add.reduceat(value * powers(int(length.max()))[k], where) ^ (length.astype(U) << U(48)))


class Words:
    """The words of some texts: ``hash`` of each, where it lies in ``buffer`` (``start``, ``end``), and ``first``:
    the number of each text's first word, and at last the number of words."""

    def __init__(self, texts: list[str], lower: bool):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.buffer = b"\n".join(parts)
        raw = np.frombuffer(self.buffer, np.uint8)
        found, at = [], 0
        while at < len(raw):  # a piece at a time: the arrays over bytes stay small however long a text is
            stop = at + PIECE
            while stop < len(raw) and not _SPACE[raw[stop]]:
                more = np.flatnonzero(_SPACE[raw[stop : stop + PIECE]])
                stop = stop + int(more[0]) if len(more) else stop + PIECE
            found.append(_words(raw, at, min(stop, len(raw)), lower))
            at = stop
        self.start, self.end, self.hash = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U))
        begin = np.cumsum([0] + [len(p) + 1 for p in parts])
        self.first = np.searchsorted(self.start, begin)

    def grams(self, n: int) -> np.ndarray:
        """The hash of the n words from each word on, also beyond its text's end; n - 1 fewer than words."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, U)
        if n < 4:
            x = np.full(m, U(n))
            for i in range(n):
                x = (x ^ self.hash[i : i + m]) * U(0xD6E8FEB86659FD93)
                x ^= x >> U(32)
            return x
        # sum of hash * b^place over the n words, as a difference of two sums from the first word on, divided by b^place
        sums = np.concatenate([np.zeros(1, U), np.cumsum(self.hash * powers(len(self.hash))[: len(self.hash)], dtype=U)])
        return mix((sums[n:] - sums[:m]) * inverses(m)[:m], n)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every text's distinct n-word shingles, in order; all words as one if they are fewer."""
        counts = np.diff(self.first)
        full = np.maximum(counts - n + 1, 0)
        doc = np.repeat(np.arange(len(counts)), full)
        offset = np.cumsum(full) - full
        at = np.repeat(self.first[:-1] - offset, full) + np.arange(len(doc))
        h = self.grams(n)[at]
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            whole = np.array([self._whole(i) for i in short.tolist()], U)
            doc, h = np.concatenate([doc, short]), np.concatenate([h, whole])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (np.diff(doc) != 0) | (h[1:] != h[:-1])
        return doc[new], h[new]

    def _whole(self, i: int) -> int:
        words = self.hash[self.first[i] : self.first[i + 1]]
        x = np.full(1, U(len(words)))
        for w in words:
            x = (x ^ w) * U(0xD6E8FEB86659FD93)
            x ^= x >> U(32)
        return int(x[0])


def shingle_set(text: str, n: int, lower: bool = True) -> np.ndarray:
    """The sorted distinct shingle hashes of one text."""
    return Words([text], lower).shingles(n)[1]
