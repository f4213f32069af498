"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, fingerprint, jaccard_join, langid, license_scan, mixing, token_counts, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_ngram_join": jaccard_join.op3_ngram_join,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_chat_format": chat.op6_chat_format,
        "op7_mixing": mixing.op7_mixing,
        "op8_language_id": langid.op8_language_id,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_fingerprint": fingerprint.op10_fingerprint,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.oracle(), "op4_decontaminate": decontaminate.oracle(), "op6_chat_format": chat.ORACLE, "op7_mixing": mixing.oracle()}
