"""Registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    ball_tree, checks, decontamination, divergence, encoding, licenses, packing, permutation_index, pii, prefix_trie, secret_scan, setsketch,
    token_counts, toxicity, url_filter,
)
from .common import read, texts


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return permutation_index.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents"))


def op3_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(texts(docs), read(spark, sf_dir, "labels")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.lengths(read(spark, sf_dir, "documents"), encoding.vocabulary())
    return token_counts.suffix_sums(lengths)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(read(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(read(spark, sf_dir, "documents"))


def op10_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(read(spark, sf_dir, "documents"), size=2, percent=80)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.ordered(read(spark, sf_dir, "conversations"))))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op13_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ball_tree.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_permutation_index": op1_permutation_index,
    "op2_secret_scan": op2_secret_scan,
    "op3_redirect_equivalence": op3_redirect_equivalence,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_license_scan": op7_license_scan,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_pii": op9_pii,
    "op10_setsketch_near_dedup": op10_setsketch_near_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_source_divergence": op12_source_divergence,
    "op13_ball_tree_topk": op13_ball_tree_topk,
}

# the others hold models, a tokenizer, an approximate index or a packing; their tests compare with brute force
ORACLES: dict[str, str] = {
    "op3_redirect_equivalence": checks.url_verdicts(),
    "op7_license_scan": checks.license_scan(),
    "op10_setsketch_near_dedup": checks.near_duplicates(size=2, percent=80),
    "op11_prefix_trie": checks.prefix_trie(),
    "op12_source_divergence": checks.source_divergence(),
    "op13_ball_tree_topk": checks.top_products(k=5),
}
