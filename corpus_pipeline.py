"""The corpus pipeline: from documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns what it keeps with the
columns of ``documents``; the last one returns the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readloom.llm import bpe, decontaminate, langid, near_dedup, pii
from readloom.llm.common import table, written

#: Mixture inference, automata over texts and byte merges have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents and drops those without a language: null texts and texts without letters."""
    return langid.accepted(docs, langid.learned(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each near-duplicate component (five-word shingles, similarity 0.8 or more)."""
    return near_dedup.one_of_each(docs, n_words=5, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which benchmark passages make up a twentieth or more."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets in the place of personal data; keeps every document."""
    return pii.redact_pii(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), and the digests of the ids and of what they decode to."""
    import public_tokenizers as public

    return bpe.encode_documents(docs, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
