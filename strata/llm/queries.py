"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.llm import bpe, chat, exact_dedup, jaccard, license_scan, line_dedup, mixing, quality_classifier, quality_rules, secret_scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": quality_classifier.op1,
    "op2_exact_dedup": exact_dedup.op2,
    "op3_secret_scan": secret_scan.op3,
    "op4_bpe": bpe.op4,
    "op5_line_dedup": line_dedup.op5,
    "op6_mixing": mixing.op6,
    "op7_jaccard_join": jaccard.op7,
    "op8_chat_format": chat.op8,
    "op9_license_scan": license_scan.op9,
    "op10_quality_rules": quality_rules.op10,
}

SQL: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
}
