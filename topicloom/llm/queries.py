"""The queries opN_<name> over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from topicloom.llm.common import table


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from topicloom.llm.packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.licences import licence_scan

    return licence_scan(table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.vector_graph import embedding_groups

    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.suffixes import Settings, suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"), Settings(length=400, passage=280, words=50))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.html_extract import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.katz import katz_scores

    return katz_scores(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.simhash import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.quotes import linked_conversations

    return linked_conversations(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_embedding_near_dedup, op3_suffix_array_dedup, op4_html_extraction, op5_benchmark_decontamination, op6_lm_scoring, op7_simhash_near_dedup, op8_toxicity, op9_best_fit_packing, op10_quotation_linking)}


def oracle_sql() -> dict[str, str]:
    return {}
