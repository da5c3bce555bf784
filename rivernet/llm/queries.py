"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, collocation, fingerprint, grid_search, mixing, near_dedup, ngram_join, packing, pii, suffix_dedup, token_count, toxicity, url_filter
from .common import table


def op1_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op5_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op6_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op7_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_induced_sorting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op11_quotient_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


def op12_grouped_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op13_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_classifier_chain, op2_simhash, op3_anisotropic_search, op4_disclosure, op5_url_vocabulary, op6_chosen_path, op7_binary_packing, op8_induced_sorting, op9_source_mixing, op10_token_counts, op11_quotient_collocations, op12_grouped_prefix, op13_treap_search)}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_url_vocabulary": url_filter.oracle_sql(), "op6_chosen_path": near_dedup.oracle_sql(), "op8_induced_sorting": suffix_dedup.oracle_sql(), "op9_source_mixing": mixing.oracle_sql(),
        "op11_quotient_collocations": collocation.oracle_sql(), "op12_grouped_prefix": ngram_join.oracle_sql(), "op13_treap_search": grid_search.oracle_sql(),
    }
