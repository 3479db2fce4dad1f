"""The registered queries of the corpus operators and the SQL they must agree with, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import cnn, sql
from wardline.llm.align import aligned_digest
from wardline.llm.dart import near_duplicates
from wardline.llm.decontam import contaminated
from wardline.llm.extract import fitted, main_text
from wardline.llm.gam import scored, train
from wardline.llm.interaction import interactions
from wardline.llm.lengths import length_histogram, suffix_sums
from wardline.llm.packing import pack
from wardline.llm.rlz import substring_digest
from wardline.llm.rules import quality_verdicts
from wardline.llm.suffix import repeated_bytes_digest
from wardline.llm.warc import round_trip


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return scored(docs, train(docs, _table(spark, folder, "labels")))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_digest(_table(spark, folder, "documents"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_table(spark, folder, "documents"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(_table(spark, folder, "pages"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_verdicts(_table(spark, folder, "documents"))


def op7_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"))


def op8_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    return main_text(pages, fitted(pages))


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_bytes_digest(_table(spark, folder, "documents"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_sums(length_histogram(_table(spark, folder, "documents")))


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return aligned_digest(_table(spark, folder, "documents"))


def op12_filter_interaction(spark: SparkSession, folder: str) -> DataFrame:
    return interactions(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return cnn.scored(docs, cnn.train(docs, _table(spark, folder, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_substring_dedup, op3_packing, op4_decontamination, op5_warc, op6_quality_rules, op7_minhash, op8_html_extraction, op9_suffix_dedup,
        op10_token_counts, op11_token_alignment, op12_filter_interaction, op13_toxicity,
    )
}

ORACLE_SQL: dict[str, str] = {"op5_warc": sql.WARC, "op6_quality_rules": sql.QUALITY_RULES, "op12_filter_interaction": sql.FILTER_INTERACTION}
