"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, conversations, decontaminate, html, lm, materialise, ngramjoin, packing, pii, quality, rules, sharding, urls
from .session import shared_path, table
from .sql import DECONTAMINATION_SQL, NGRAM_JOIN_SQL, RULES_SQL, SHARDING_SQL

Query = Callable[[SparkSession, str], DataFrame]


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = rules.ledger(table(spark, sf_dir, "documents"))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~rules.passes("base")).alias("base_failed"), rules.passes().alias("kept"), "failures")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.filter_urls(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", "verdict", "block_score")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise.materialise(table(spark, sf_dir, "documents"), shared_path(spark, "sequences"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repairs(conversations.damage(conversations.plain(table(spark, sf_dir, "conversations"))))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {"op1_lm_scoring": op1_lm_scoring, "op3_ngram_jaccard_join": op3_ngram_jaccard_join, "op2_quality_classifier": op2_quality_classifier, "op4_quality_rules": op4_quality_rules, "op5_url_filters": op5_url_filters, "op6_benchmark_decontamination": op6_benchmark_decontamination, "op7_token_binary": op7_token_binary, "op8_sharding": op8_sharding, "op9_packing": op9_packing, "op10_html_extraction": op10_html_extraction, "op11_tokenizer_alignment": op11_tokenizer_alignment, "op12_conversation_repair": op12_conversation_repair, "op13_pii": op13_pii}
ORACLES: dict[str, str] = {"op3_ngram_jaccard_join": NGRAM_JOIN_SQL, "op4_quality_rules": RULES_SQL, "op6_benchmark_decontamination": DECONTAMINATION_SQL, "op8_sharding": SHARDING_SQL}
