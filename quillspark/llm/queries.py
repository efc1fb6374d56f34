"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat_format, decontaminate, license_scan, line_dedup, ngram_lm, phrase_dedup, quality_rules, ranked_search, simhash, turn_repair, url_filter, weak_labels
from .common import documents


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir))


QUERIES = {
    "op1_quality_rules": quality_rules.op1,
    "op2_license_scans": license_scan.op2,
    "op3_quality_classifier": weak_labels.op3,
    "op4_benchmark_decontamination": decontaminate.op4,
    "op5_byte_bpe": op5,
    "op6_substring_dedup": phrase_dedup.op6,
    "op7_simhash_near_dedup": simhash.op7,
    "op8_line_dedup": line_dedup.op8,
    "op9_lm_scoring": ngram_lm.op9,
    "op10_chat_formatting": chat_format.op10,
    "op11_url_filters": url_filter.op11,
    "op12_ranked_search": ranked_search.op12,
    "op13_turn_repair": turn_repair.op13,
}
ORACLE = {
    "op4_benchmark_decontamination": decontaminate.SQL,
    "op6_substring_dedup": phrase_dedup.SQL,
    "op10_chat_formatting": chat_format.SQL,
    "op11_url_filters": url_filter.SQL,
    "op12_ranked_search": ranked_search.SQL,
    "op13_turn_repair": turn_repair.SQL,
}
