"""Registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm import backoff, chosen, filters, knn, langid, licenses, mixing, oracles, packing, preference, quality, ranked, simhash, suffix
from wattline.llm.common import importable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return knn.nearest(vectors.where("vec_id % 50 = 0"), vectors, k=5)


def op6_backoff_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.backoff_scores(_table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = preference.conversations_of(_table(spark, sf_dir, "conversations"))
    out = preference.format_pairs(preference.swapped_replies(conversations), "conv_id", "partner_id")
    spans = [
        F.array_join(F.transform(c, lambda s: F.concat(s["a"].cast("string"), F.lit("-"), s["b"].cast("string"))), ",").alias(c)
        for c in ("chosen_spans", "rejected_spans")
    ]
    return out.select("conv_id", "partner_id", "n_prompt_turns", "prompt", "chosen", "rejected", *spans)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_quality_rules,
        op3_suffix_dedup,
        op4_language_id,
        op5_nearest_neighbours,
        op6_backoff_scoring,
        op7_best_fit_packing,
        op8_simhash,
        op9_source_mixing,
        op10_preference_format,
        op11_filter_audit,
        op12_ranked_search,
        op13_minhash_join,
    )
}
ORACLES: dict[str, str] = {
    "op1_license_scan": oracles.LICENSE_SCAN,
    "op5_nearest_neighbours": oracles.NEAREST,
    "op10_preference_format": oracles.PREFERENCE,
    "op11_filter_audit": oracles.FILTER_AUDIT,
    "op12_ranked_search": oracles.RANKED_SEARCH,
}
