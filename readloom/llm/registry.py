"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readloom.llm import bpe, decontaminate, fingerprint, html_text, langid, near_dedup, oracles, phrases, pii, sharding, token_store


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_store": token_store.op1_token_store,
        "op2_phrase_dedup": phrases.op2_phrase_dedup,
        "op3_language_id": langid.op3_language_id,
        "op4_splitter_shards": sharding.op4_splitter_shards,
        "op5_byte_bpe": bpe.op5_byte_bpe,
        "op6_main_text": html_text.op6_main_text,
        "op7_syncmers": fingerprint.op7_syncmers,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_pii": pii.op9_pii,
        "op10_near_dedup": near_dedup.op10_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_phrase_dedup": oracles.PHRASES, "op6_main_text": oracles.PAGES, "op8_decontaminate": oracles.CONTAMINATION, "op10_near_dedup": oracles.NEAR}
