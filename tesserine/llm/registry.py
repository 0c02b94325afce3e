"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_format, jaccard_join, line_dedup, media_tiff, packing, quality_rules, sql, substring_dedup, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_packing": packing.op4_packing,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_media_tiff": media_tiff.op7_media_tiff,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op9_chat_format": chat_format.op9_chat_format,
}

ORACLES: dict[str, str] = {
    "op3_suffix_dedup": sql.SUFFIX_DEDUP,
    "op5_quality_rules": quality_rules.sql(),
    "op8_jaccard_join": sql.JACCARD_JOIN,
    "op9_chat_format": chat_format.SQL,
    "op10_substring_dedup": sql.SUBSTRING_DEDUP,
}
