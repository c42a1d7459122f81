"""Registered queries of the corpus operators and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gistra.llm import bpe, counts, decontaminate, html, quality, secrets, sharding, simhash, spotsigs, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_simhash": simhash.op2_simhash,
        "op3_quality": quality.op3_quality,
        "op4_fingerprints": spotsigs.op4_fingerprints,
        "op5_token_counts": counts.op5_token_counts,
        "op6_html": html.op6_html,
        "op7_sharding": sharding.op7_sharding,
        "op8_secret_scans": secrets.op8_secret_scans,
        "op9_url_filters": urls.op9_url_filters,
        "op10_decontamination": decontaminate.op10_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_secret_scans": secrets.OP8_SQL,
        "op9_url_filters": urls.OP9_SQL,
    }
