"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketloom.llm import (
    dual_tree,
    exact_dedup,
    jaccard,
    licenses,
    mixing,
    packing,
    periodic,
    pii,
    quality_classifier,
    rules,
    sharding,
    toxicity,
    url_filter,
)
from marketloom.llm.common import table
from marketloom.session import tune


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(tune(spark), sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return quality_classifier.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(tune(spark), sf_dir, "pages"), url_filter.rule_table(spark))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(tune(spark), sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_components(table(tune(spark), sf_dir, "documents"), words=3, num=9, den=10)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents")
    return pii.find_pii(docs, pii.train(docs))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(tune(spark), sf_dir, "documents"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(tune(spark), sf_dir, "documents"), cached=350_000)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(tune(spark), sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.planted(table(tune(spark), sf_dir, "documents"))
    return periodic.run_digests(periodic.find_runs(docs))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.ranked_search(table(tune(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(tune(spark), sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix, op2_quality, op3_url_filter, op4_quality_rules, op5_ngram_jaccard,
        op6_pii, op7_shard, op8_pack, op9_exact_dedup, op10_toxicity, op11_runs, op12_search, op13_licenses,
    )
}

ORACLES = {
    "op3_url_filter": url_filter.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op12_search": dual_tree.ORACLE,
    "op13_licenses": licenses.ORACLE,
}
