"""Operator 2: substring deduplication by repeated-phrase automata.

A window is ``WINDOW`` consecutive words.  A word goes if a window over it also starts in a document with a smaller id.

1. Every window names one of its word n-grams, the one with the least hash, as its anchor: equal windows name equal
   anchors.  Only about one n-gram in four is ever an anchor; those found in two documents are counted out.
2. Windows with such an anchor are hashed; a hash in two documents makes a recurring window, owned by the first one.
3. The owner's runs of recurring windows are the confirmed passages.  Each goes to the shards of documents in which one
   of its windows was seen.
4. Each shard compiles its passages into one Aho-Corasick automaton over word numbers and streams all its documents
   through it.  The automaton's patterns are the passages' blocks of seven words, one of which lies in any 13 words;
   from each hit the match is extended word by word over passage and document, and a match of at least a window counts.

So hashes only choose what is looked for: a word is removed only where it equals, in its window, the words of an
earlier document.  The exception are texts that equal an earlier one's by length and SHA-256: all their windows are the
earlier one's, so that they are decided by that alone and take no part in 1 to 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import arrow_map, table, written
from readloom.llm.wordhash import Words, blocks

WINDOW, ANCHOR = 13, 7
SHARD_BYTES = 24 << 20  # text of a shard, about
PARTITION_BYTES = 192 << 20  # of a partition, about, which has several shards one after the other
BROADCAST = 2_000_000  # anchors, or ids of copies (8 bytes each), that may be broadcast; beyond, they are joined by shuffling


class Windows:
    """The windows of some texts: ``doc`` and ``at`` (first word) of each, and the hashes of it and of its anchor."""

    def __init__(self, texts: list[str], n: int, k: int, hashes: bool = True):
        self.words = w = Words(texts, lower=False)
        full = np.maximum(np.diff(w.first) - n + 1, 0)
        self.doc = np.repeat(np.arange(len(texts)), full)
        self.at = np.repeat(w.first[:-1] - (np.cumsum(full) - full), full) + np.arange(len(self.doc))
        self.hash = w.grams(n)[self.at].view(np.int64) if hashes else None
        least, have, want = w.grams(k), 1, n - k + 1
        while have < want:  # the least of the next 2, 4, ... n-grams
            step = min(have, want - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        self.anchor = least[self.at].view(np.int64)

    def slices(self, n_docs: int) -> list[tuple[int, int]]:
        edge = np.searchsorted(self.doc, np.arange(n_docs + 1)).tolist()
        return list(zip(edge[:-1], edge[1:]))


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _anchors(docs: DataFrame, n: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for start, texts in blocks(batch.column(1).to_pylist()):
                w = Windows(texts, n, k, hashes=False)
                new = np.ones(len(w.at), bool)
                new[1:] = (w.anchor[1:] != w.anchor[:-1]) | (np.diff(w.doc) != 0)
                yield pa.RecordBatch.from_pydict({"h": w.anchor[new], "doc": ids[start + w.doc[new]]})

    return docs.transform(arrow_map, run, "h long, doc long")


def _candidates(docs: DataFrame, n: int, k: int) -> DataFrame:
    """doc, windows (hashes), segments (their words, joined): of (doc_id, text, hs) with hs the anchors that recur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, anchors = batch.column(0).to_pylist(), batch.column(2)
            for start, texts in blocks(_unpacked(batch.column(1))):
                w = Windows(texts, n, k)
                doc, hashes, segments = [], [], []
                buffer, begin, end = w.words.buffer, w.words.start, w.words.end
                for i, (a, b) in enumerate(w.slices(len(texts))):
                    mask = np.isin(w.anchor[a:b], anchors[start + i].values.to_numpy())
                    if mask.any():
                        doc.append(ids[start + i])
                        hashes.append(np.unique(w.hash[a:b][mask]))
                        segments.append([b" ".join(buffer[begin[w.at[a + x]] : end[w.at[a + y - 1] + n - 1]].split()) for x, y in runs(mask)])
                yield pa.RecordBatch.from_pydict({"doc": pa.array(doc, pa.int64()), "windows": pa.array(hashes, pa.list_(pa.int64())), "segments": pa.array(segments, pa.list_(pa.binary()))})

    return docs.transform(arrow_map, run, "doc long, windows array<long>, segments array<binary>")


def _passages(wanted: DataFrame, n: int) -> DataFrame:
    """shard, id, payload: the passages of an owner that a shard needs, one in a line; from (shard, doc, windows, segments)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for windows, segments in zip(batch.column(2), batch.column(3).to_pylist()):
                windows, found = windows.values.to_numpy(), []
                w = Words([s.decode("utf-8", "surrogatepass") for s in segments], lower=False)
                full = np.maximum(np.diff(w.first) - n + 1, 0)
                at = np.repeat(w.first[:-1] - (np.cumsum(full) - full), full) + np.arange(full.sum())
                h = w.grams(n)[at].view(np.int64)
                mask = np.zeros(len(h), bool)
                mask[np.unique(h, return_index=True)[1]] = True  # each window once, where it is first
                mask &= np.isin(h, windows)
                # a run must not go from one segment to the next
                split = np.flatnonzero(np.diff(at) != 1) + 1
                for lo, hi in zip([0, *split.tolist()], [*split.tolist(), len(h)]):
                    for x, y in runs(mask[lo:hi]):
                        found.append(b" ".join(w.buffer[w.start[at[lo + x]] : w.end[at[lo + y - 1] + n - 1]].split()))
                out.append(b"\n".join(found))
            yield pa.RecordBatch.from_pydict({"shard": batch.column(0), "kind": pa.array([0] * len(out), pa.int32()), "id": batch.column(1), "payload": pa.array(out, pa.binary())})

    return wanted.transform(arrow_map, run, "shard int, kind int, id long, payload binary")


class PassageAutomaton:
    """An Aho-Corasick automaton over the words of passages, each with the id of the document that owns it.

    A word is written as a code of a fixed width, every place of it with an alphabet of its own: no node has more than
    ``BASE`` children (their number, not that of the words, is what a step costs), and matches begin with words.
    """

    BASE = 32

    def __init__(self, passages: list[tuple[int, list[bytes]]], n: int):
        import ahocorasick

        self.n, self.block = n, (n + 1) // 2
        self.owner = [o for o, _ in passages]
        self.words = [words for _, words in passages]
        vocabulary = set().union(*self.words) if passages else set()
        self.width = 1
        while self.BASE**self.width < len(vocabulary):
            self.width += 1
        digits = [[chr(0x100 + self.BASE * place + d) for d in range(self.BASE)] for place in range(self.width)]
        self.code = {w: "".join([digits[place][i // self.BASE**place % self.BASE] for place in range(self.width)]) for i, w in enumerate(vocabulary)}
        self.unknown = "\0" * self.width
        code, block = self.code, self.block
        places: dict[str, list[tuple[int, int]]] = {}
        for p, words in enumerate(self.words):
            for off in range(0, len(words) - block + 1, block):
                places.setdefault("".join([code[w] for w in words[off : off + block]]), []).append((p, off))
        self.automaton = None
        if places:
            self.automaton = ahocorasick.Automaton()
            for key, where in places.items():
                self.automaton.add_word(key, where)
            self.automaton.make_automaton()

    def covered(self, doc_id: int, words: list[bytes]) -> np.ndarray | None:
        """For each word whether a window over it is an earlier document's; None if none is."""
        if self.automaton is None or len(words) < self.n:
            return None
        code, unknown, block = self.code, self.unknown, self.block
        text = "".join([code.get(w, unknown) for w in words])
        hit, done = None, {}
        for last, where in self.automaton.iter(text):
            last //= self.width
            first = last - block + 1
            for p, off in where:
                line = (p, first - off)  # passage and document run in step along it
                if done.get(line, -1) > last or self.owner[p] >= doc_id:
                    continue
                passage = self.words[p]
                a, x = first, off
                while a and x and words[a - 1] == passage[x - 1]:
                    a, x = a - 1, x - 1
                b, y = last + 1, off + block
                while b < len(words) and y < len(passage) and words[b] == passage[y]:
                    b, y = b + 1, y + 1
                done[line] = b
                if b - a >= self.n:
                    if hit is None:
                        hit = np.zeros(len(words), bool)
                    hit[a:b] = True
        return hit


def _pack(docs: DataFrame, columns: str, schema: str) -> DataFrame:
    """The last column, a text, as compressed bytes: it is shuffled in that form."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = pa.array([c.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], z], names=batch.schema.names)

    return docs.selectExpr(*columns.split(", ")).transform(arrow_map, run, schema)


def _unpacked(column: pa.Array) -> list[str]:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return [d.decompress(z).decode("utf-8", "surrogatepass") for z in column.to_pylist()]


def _located(rows: DataFrame, n: int, keep_text: bool) -> DataFrame:
    """The last step, over rows (shard, kind, id, payload) in order of shard and kind: 0 passages, 1 copies, 2 documents."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        shard, passages, copies, machine = None, [], set(), None
        for batch in batches:
            out: list[tuple] = []
            for s, kind, i, payload in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if s != shard:
                    shard, passages, copies, machine = s, [], set(), None
                if kind == 0:
                    passages += [(i, line.split()) for line in payload.split(b"\n")]
                elif kind == 1:
                    copies.add(i)
                else:
                    if machine is None:
                        machine, passages = PassageAutomaton(passages, n), []
                    words = d.decompress(payload).split()
                    gone = None
                    if i in copies:
                        gone = np.ones(len(words), bool) if len(words) >= n else None
                    elif i is not None:
                        gone = machine.covered(i, words)
                    kept = words if gone is None else [words[k] for k in np.flatnonzero(~gone).tolist()]
                    joined = b" ".join(kept)
                    out.append((i, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), *([joined.decode("utf-8", "surrogatepass")] if keep_text else [])))
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_pydict({names[c]: pa.array([o[c] for o in out], kinds[c]) for c in range(4 + keep_text)})

    return rows.transform(arrow_map, run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WINDOW, k: int = ANCHOR, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with ``keep_text``, kept_text; one row for each row of ``docs``.

    A null text has no words.  A document of fewer than ``n`` words has no window and keeps all.  Rows with the same
    doc_id never remove each other's words; a row whose doc_id is null neither removes nor loses any.  Other columns
    are not read; an empty table gives no rows.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spark = docs.sparkSession
    known = docs.filter("doc_id is not null")
    # texts that equal an earlier document's
    digest = written(known.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").alias("bytes")), "digests")
    once = digest.groupBy("doc_id").agg(F.count("*").alias("rows"), F.first("sha").alias("sha"), F.first("bytes").alias("bytes"))
    first = digest.groupBy("sha", "bytes").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    first = written(first, "texts")  # so that the join can deal a text of very many documents over tasks
    copies = written(once.filter("rows = 1").join(first, ["sha", "bytes"]).filter("first < doc_id").select(F.col("doc_id").alias("doc")), "copies")
    total = digest.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(tasks, total // SHARD_BYTES)
    parts = max(tasks, total // PARTITION_BYTES)

    few = copies.count() <= BROADCAST
    new = known.join(F.broadcast(copies), F.col("doc_id") == F.col("doc"), "left_anti") if few else known
    anchors = written(_anchors(new, n, k), "anchors")  # read twice: once to find those that recur, once where they are
    common = written(anchors.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("h"), "common")
    small = common.count() <= BROADCAST
    held = anchors.join(F.broadcast(common) if small else common, "h")
    held = (held if few else held.join(copies, "doc", "left_anti")).groupBy("doc").agg(F.collect_set("h").alias("hs"))  # of one document at most its own anchors
    held = written(held, "held")
    asked = known.join(F.broadcast(held.select("doc")), F.col("doc_id") == F.col("doc"), "left_semi") if held.count() <= BROADCAST else known
    packed = _pack(asked, "doc_id, text", "doc long, z binary")
    found = written(_candidates(packed.join(held, "doc").select("doc", "z", "hs"), n, k), "windows")

    windows = found.select(F.explode("windows").alias("w"), "doc")
    owners = windows.groupBy("w").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("w", "first")
    owners = written(owners, "owners")  # so that the join can deal a window of very many documents over tasks
    shard = F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("int")
    seen = windows.join(owners, "w").filter("doc > first").select(shard.alias("shard"), F.col("first").alias("doc"), "w").distinct()
    wanted = seen.groupBy("shard", "doc").agg(F.collect_list("w").alias("ws"))
    passages = written(_passages(wanted.join(found, "doc").select("shard", "doc", "ws", "segments"), n), "passages")

    marks = copies.select(shard.alias("shard"), F.lit(1).alias("kind"), F.col("doc").alias("id"), F.lit(None).cast("binary").alias("payload"))
    stream = _pack(docs, "doc_id, text", "doc long, z binary").select(shard.alias("shard"), F.lit(2).alias("kind"), F.col("doc").alias("id"), F.col("z").alias("payload"))
    rows = passages.unionByName(marks).unionByName(stream).repartition(parts, "shard").sortWithinPartitions("shard", "kind")
    return _located(rows, n, keep_text)


def op2_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``documents``: windows of 13 words."""
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)
