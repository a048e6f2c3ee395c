"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, licenses, mixing, packing, quality, rangecoder, simhash, substring, suffixtree, tiff


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_output": rangecoder.query,
        "op2_license_scan": licenses.query,
        "op3_chat_format": chat.query,
        "op4_suffix_tree": suffixtree.query,
        "op5_tiff_media": tiff.query,
        "op6_simhash_dedup": simhash.query,
        "op7_substring_dedup": substring.query,
        "op8_best_fit_packing": packing.query,
        "op9_quality_rules": quality.query,
        "op10_source_mixing": mixing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": licenses.sql(),
        "op3_chat_format": chat.SQL,
    }
