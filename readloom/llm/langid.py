"""Operator 3: language identification as the inference of a mixture.

Training counts the letter trigrams of every language; a text is then taken as a mixture of languages, each of its
words drawn from one of them.  Expectation-maximisation estimates the proportions from the words' trigram likelihoods,
and the set of languages is the one whose likelihood, less a penalty for each language more, is best.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import arrow_map, table

CELLS = 1 << 17  # trigrams are hashed into so many cells
TRAIN_DOCS = 4000  # documents of a language to learn from, about; all if there are fewer
MOST_LANGS = 256  # languages of a model, which is broadcast with half a megabyte for each; more raise ValueError
UNIT = 16  # letters of a word at most; longer ones count as several
BLOCK = 1 << 20  # characters that are worked on at once
ROUNDS, AGAIN = 6, 4  # of expectation-maximisation, with all languages and with each smaller set
LEAST = 0.02  # a set is tried only if its last language has this proportion

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point its lower-case letter's code point, 0 for what is no letter."""
    if not _letters:
        out = np.zeros(sys.maxunicode + 1, np.uint32)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low[0])
        _letters.append(out)
    return _letters[0]


def blocks(texts: list[str], most: int = BLOCK) -> Iterator[list[str]]:
    """Runs of texts with about ``most`` characters, or a longer one alone."""
    run, n = [], 0
    for t in texts:
        if run and n + len(t) > most:
            yield run
            run, n = [], 0
        run.append(t)
        n += len(t)
    if run:
        yield run


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell of each letter's trigram, first letter of each word, first word of each text and the end)."""
    raw = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    c = letters()[np.minimum(raw, sys.maxunicode)]
    at = np.flatnonzero(c)
    x = c.astype(np.uint64)
    h = x[at - 1] * np.uint64(0x9E3779B97F4A7C15) + x[at] * np.uint64(0xC2B2AE3D27D4EB4F) + x[at + 1] * np.uint64(0x165667B19E3779F9)
    cell = ((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(47)).astype(np.int64)
    opens = np.ones(len(at), bool)
    opens[1:] = np.diff(at) > 1
    start = np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0)) if len(at) else at
    opens |= (np.arange(len(at)) - start) % UNIT == 0
    word = np.flatnonzero(opens)
    first = np.cumsum([1] + [len(t) + 1 for t in texts])  # where each text begins
    return cell, word, np.searchsorted(at[word], first)


class Mixture:
    """What was learned: ``langs`` and the log probability of each cell in each language."""

    def __init__(self, langs: list[str], counts: np.ndarray, alpha: float = 0.1):
        self.langs = langs
        total = counts.sum(1, keepdims=True)
        self.logp = np.log((counts + alpha) / (total + alpha * CELLS)).astype(np.float32).T.copy()

    def predict(self, texts: list[str]) -> list[tuple[str, float, dict[str, float]]]:
        """(language, its proportion, all proportions) for each text; ``und`` and 0 for one without letters."""
        out: list = []
        for run in blocks(texts):
            out += self._predict(run)
        return out

    def _likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood of each word in each language, first word of each text and the end)"""
        if len(texts) == 1 and len(texts[0]) > BLOCK:  # a long text, block by block
            parts = [self._likelihoods([texts[0][i : i + BLOCK]])[0] for i in range(0, len(texts[0]), BLOCK)]
            return np.concatenate(parts), np.array([0, sum(map(len, parts))])
        cell, word, first = features(texts)
        if not len(word):
            return np.zeros((0, len(self.langs))), first
        return np.add.reduceat(self.logp[cell], word, axis=0).astype(np.float64), first

    def _predict(self, texts: list[str]) -> list[tuple[str, float, dict[str, float]]]:
        n, k = len(texts), len(self.langs)
        out: list = [("und", 0.0, {})] * n
        if not k:
            return out
        ll, first = self._likelihoods(texts)
        counts = np.diff(first)
        has = np.flatnonzero(counts)
        if not len(has):
            return out
        sizes, starts = counts[has], first[:-1][has]
        top = ll.max(1, keepdims=True)
        p = np.exp(ll - top)
        base = np.add.reduceat(top[:, 0], starts)

        def em(pi: np.ndarray, rows: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
            """Proportions and log likelihood of the texts ``rows`` (numbers within ``has``)."""
            if len(rows) == len(has):
                q, m, s = p, sizes, starts
            else:
                m = sizes[rows]
                s = np.cumsum(m) - m
                q = p[np.repeat(starts[rows] - s, m) + np.arange(m.sum())]
            for _ in range(rounds):
                r = q * np.repeat(pi, m, axis=0)
                r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
                pi = np.add.reduceat(r, s, axis=0) / m[:, None]
            seen = np.maximum((q * np.repeat(pi, m, axis=0)).sum(1), 1e-300)
            return pi, np.add.reduceat(np.log(seen), s) + base[rows]

        everything = np.arange(len(has))
        pi, _ = em(np.full((len(has), k), 1 / k), everything, ROUNDS)
        order = np.argsort(-pi, axis=1, kind="stable")
        penalty = 0.5 * np.log(np.maximum(sizes, 2)) + 2.0
        # one language: no mixture to fit
        best = np.zeros((len(has), k))
        best[everything, order[:, 0]] = 1.0
        score = np.add.reduceat(ll, starts, axis=0)[everything, order[:, 0]]
        for size in range(2, k + 1):
            rows = np.flatnonzero(pi[everything, order[:, size - 1]] >= LEAST)
            if not len(rows):
                break
            start = np.zeros((len(rows), k))
            pick = order[rows, :size]
            start[np.arange(len(rows))[:, None], pick] = pi[rows[:, None], pick]
            start /= start.sum(1, keepdims=True)
            fit, value = em(start, rows, AGAIN)
            value = value - (size - 1) * penalty[rows]
            better = value > score[rows]
            best[rows[better]], score[rows[better]] = fit[better], value[better]
        for i, row in zip(has.tolist(), best):
            j = int(row.argmax())
            out[i] = (self.langs[j], float(min(1.0, row[j])), {self.langs[m]: float(row[m]) for m in np.flatnonzero(row > 0)})
        return out


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = TRAIN_DOCS, key: str = "doc_id") -> Mixture:
    """Learns from the rows of ``labelled`` with a text and a language, about ``per_language`` of each language.

    Which rows: those with the smallest hashes of text and ``key`` (where that is a column), by a threshold for each
    language, so that copies of one text are neither all taken nor all left.  The counts are summed on the executors;
    the driver gets one table of ``CELLS`` counts for each language.
    """
    own = [F.col(key)] if key in labelled.columns else []
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(text), *own).alias("h")).filter("text is not null and lang is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"there are more than {MOST_LANGS} languages in {lang}")
    langs = sorted(sizes)
    if not langs:
        return Mixture([], np.zeros((0, CELLS)))
    share = F.lit(1.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, per_language / n))).otherwise(share)
    picked = rows.filter(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).select("text", "lang")
    number = {name: i for i, name in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(langs), CELLS), np.int64)
        for batch in batches:
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in set(names):
                for run in blocks([t[i : i + BLOCK] for t, x in zip(texts, names) if x == name for i in range(0, len(t), BLOCK)]):
                    table[number[name]] += np.bincount(features(run)[0], minlength=CELLS)
        at = np.flatnonzero(table)
        if len(at):
            yield pa.RecordBatch.from_pydict({"at": at, "n": table.ravel()[at]})

    counts = np.zeros(len(langs) * CELLS)
    for r in picked.transform(arrow_map, count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow().to_batches():
        counts[r.column(0).to_numpy()] = r.column(1).to_numpy()
    return Mixture(langs, counts.reshape(len(langs), CELLS))


def held_out(key: str = "doc_id"):
    """True for the documents that nothing is learned from; those without an id are among them."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def identify(docs: DataFrame, model: Mixture, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and mixture (map of language to proportion), one row for each row of ``docs``.

    A null text, one without letters, and any text if nothing was learned, is ``und`` with score 0.  Equal proportions
    go to the first language by name.  Other columns are not read; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS floats for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "lang_pred": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64()), "mixture": pa.array([list(f[2].items()) for f in found], pa.map_(pa.string(), pa.float64()))})

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).transform(arrow_map, run, "doc_id long, lang_pred string, score double, mixture map<string,double>")


def accepted(docs: DataFrame, model: Mixture, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is known, all columns as they are: those with ``und`` go."""
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.predict([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([f[0] != "und" for f in found], pa.bool_()))

    return docs.transform(arrow_map, run, docs.schema)


def learned(docs: DataFrame) -> Mixture:
    """The model of the contract: from the documents whose crc32(doc_id as text) mod 5 isn't 0."""
    return train(docs.filter(~held_out()))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learned(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "mixture")
