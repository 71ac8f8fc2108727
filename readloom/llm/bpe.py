"""Operator 5: byte-level BPE encoding and decoding by a two-tier lookup.

Tier 1, a minimal perfect hash over the vocabulary, resolves pre-tokens that are tokens themselves: a hash of the
bytes gives the one place where the token can be, and one comparison settles it.  Tier 2 merges the bytes of the other
pre-tokens: a heap of mergeable neighbours over a linked list of byte runs, least rank first, leftmost among equals.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import arrow_map, table
from readloom.llm.pretokens import PieceEncoder


class MinimalPerfectHash:
    """Maps n distinct byte strings to 0..n-1 one to one, and any other string to some number in that range or -1.

    Level by level, the strings left are hashed into a bit table of twice their number; those alone in their cell are
    placed, the others go to the next level.  A string's number is the count of set bits before its own.
    """

    def __init__(self, keys: list[bytes]):
        if len(set(keys)) != len(keys):
            raise ValueError("keys repeat")
        left = self.digests(keys)
        self.levels: list[tuple[int, np.ndarray]] = []
        base = 0
        while len(left):
            size = 2 * len(left) + 1
            cell = self.cell(left, len(self.levels), size)
            alone = np.bincount(cell, minlength=size) == 1
            rank = np.where(alone, base + np.cumsum(alone) - 1, -1).astype(np.int64)
            self.levels.append((size, rank))
            base += int(alone.sum())
            left = left[~alone[cell]]
            if len(self.levels) > 60:
                raise ValueError("two keys have the same digest")

    @staticmethod
    def digests(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    @staticmethod
    def cell(digest: np.ndarray, level: int, size: int) -> np.ndarray:
        x = digest ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def lookup(self, keys: list[bytes]) -> np.ndarray:
        digest = self.digests(keys)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (size, rank) in enumerate(self.levels):
            found = rank[self.cell(digest[todo], level, size)]
            out[todo] = found
            todo = todo[found < 0]
            if not len(todo):
                break
        return out


class ByteBPE:
    """Encodes and decodes with the ranks of a vocabulary: token bytes -> id, where a lower id merges first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.hash = MinimalPerfectHash(list(ranks))
        place = self.hash.lookup(list(ranks))
        self.token_at: list[bytes] = [b""] * len(ranks)
        self.id_at = [0] * len(ranks)
        for p, (token, i) in zip(place.tolist(), ranks.items()):
            self.token_at[p], self.id_at[p] = token, i
        self.pieces = PieceEncoder(pattern, self._resolve)
        # ids -> bytes: all tokens in one buffer, with where each begins and how long it is
        top = max(ranks.values(), default=-1) + 1
        self.lengths = np.zeros(top, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        self.starts = np.cumsum(self.lengths) - self.lengths
        buffer = bytearray(int(self.lengths.sum()))
        for token, i in ranks.items():
            buffer[self.starts[i] : self.starts[i] + len(token)] = token
        self.buffer = np.frombuffer(bytes(buffer), np.uint8)

    @classmethod
    def from_rank_file(cls, raw: bytes, pattern: str) -> ByteBPE:
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a pre-token that is no token.  Raises KeyError if a byte has no token."""
        n, get = len(piece), self.ranks.get
        if n > 1 << 20:
            return self._merge(piece, n, get, 40)
        return self._merge(piece, n, get, 20)

    def _merge(self, piece: bytes, n: int, get, bits: int) -> list[int]:
        mask = (1 << bits) - 1
        end = list(range(1, n + 1))  # the run that begins at i ends before end[i]; the next run begins there
        prev = list(range(-1, n))  # where the run before the one at i begins
        live = [-1] * n  # the heap entry that holds for the run at i and the next one
        heap = []
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                live[i] = r << bits | i
                heap.append(live[i])
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & mask
            if live[i] != entry:
                continue
            k = end[i]
            e = end[i] = end[k]
            live[k] = -1
            live[i] = -1
            if e < n:
                prev[e] = i
                r = get(piece[i : end[e]])
                if r is not None:
                    live[i] = x = r << bits | i
                    heappush(heap, x)
            j = prev[i]
            if j >= 0:
                r = get(piece[j:e])
                if r is None:
                    live[j] = -1
                else:
                    live[j] = x = r << bits | j
                    heappush(heap, x)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _resolve(self, pieces: list[str]) -> list[bytes]:
        """The ids of each pre-token as little-endian unsigned 32-bit integers."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        token_at, id_at = self.token_at, self.id_at
        out = []
        for p, at in zip(raw, self.hash.lookup(raw).tolist()):
            if at >= 0 and token_at[at] == p:
                out.append(id_at[at].to_bytes(4, "little"))
            else:
                out.append(b"".join([i.to_bytes(4, "little") for i in self.merge(p)]))
        return out

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        return self.pieces.encode(text)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids in the form of ``encode`` stand for."""
        ids = np.frombuffer(ids, "<u4")
        length = self.lengths[ids]
        total = int(length.sum())
        if not total:
            return b""
        at = np.repeat(self.starts[ids] - (np.cumsum(length) - length), length)
        at += np.arange(total)
        return self.buffer[at].tobytes()


_models: dict[bytes, ByteBPE] = {}


def model(raw: bytes, pattern: str) -> ByteBPE:
    """One model for each worker and vocabulary."""
    key = hashlib.sha256(raw + pattern.encode()).digest()
    if key not in _models:
        _models[key] = ByteBPE.from_rank_file(raw, pattern)
    return _models[key]


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, ids (binary, 32-bit) and decoded (string).

    One row for each row of ``docs``, repeated ones too; a null text is empty and has no ids; other columns are not
    read.  The ids are decoded again from their own bytes.  No row depends on another: nothing is shuffled.
    """
    with open(rank_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(shared.value, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for lo in range(0, len(texts), 256):
                ids = bpe.pieces.encode_all([t or "" for t in texts[lo : lo + 256]])
                decoded = [bpe.decode(x) for x in ids]
                out = {"doc_id": keys[lo : lo + 256], "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_sha256": list(map(sha, ids)), "decoded_sha256": list(map(sha, decoded))}
                if keep_ids:
                    out |= {"ids": pa.array(ids, pa.binary()), "decoded": pa.array([x.decode("utf-8", "replace") for x in decoded], pa.string())}
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep_ids
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).transform(arrow_map, run, schema)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``documents``."""
    import public_tokenizers as public

    return encode_documents(table(spark, sf_dir, "documents"), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN, keep_ids=False)
