"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import chat, decontaminate, html, licences, lm, near_dup, pieces, quality, repair, repeats, runs, secrets, sharding
from tidewright.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_chat_format": lambda spark, sf: chat.query(table(spark, sf, "conversations")),
        "op2_sharding": lambda spark, sf: sharding.shard_documents(table(spark, sf, "documents")),
        "op3_secret_scan": lambda spark, sf: secrets.secret_digests(table(spark, sf, "documents")),
        "op4_license_scan": lambda spark, sf: licences.find_licences(table(spark, sf, "documents"), licences.known_digests(spark)),
        "op5_quality_rules": lambda spark, sf: quality.judge_documents(table(spark, sf, "documents"), table(spark, sf, "labels")),
        "op6_decontamination": lambda spark, sf: decontaminate.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark")),
        "op7_lm_scoring": lambda spark, sf: lm.score_documents(table(spark, sf, "documents")),
        "op8_sentencepiece": lambda spark, sf: pieces.encoded_digests(table(spark, sf, "documents")),
        "op9_html_extraction": lambda spark, sf: html.extract_pages(table(spark, sf, "pages")),
        "op10_near_dup": lambda spark, sf: near_dup.near_duplicates(table(spark, sf, "documents")),
        "op11_periodic_runs": lambda spark, sf: runs.find_runs(table(spark, sf, "documents")),
        "op12_repeated_passages": lambda spark, sf: repeats.repeat_digests(table(spark, sf, "documents")),
        "op13_structure_repair": lambda spark, sf: repair.repair_digests(table(spark, sf, "conversations")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat.oracle_sql(),
        "op2_sharding": sharding.oracle_sql(),
        "op4_license_scan": licences.oracle_sql(),
        "op11_periodic_runs": runs.oracle_sql(),
        "op12_repeated_passages": repeats.oracle_sql(),
        "op13_structure_repair": repair.oracle_sql(),
    }
