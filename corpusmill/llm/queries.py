"""The queries of this subpackage, one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, divergence, exact, licenses, mixing, neardup, negatives, packing, quality, rans, sharding, substrings, toxicity
from .common import documents


def op1_factorization_machine_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(documents(spark, sf_dir))


def op6_sampled_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op7_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.token_files(documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup_table(documents(spark, sf_dir))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_norm_bucketed_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(embeddings(spark, sf_dir))


def op12_learned_partition_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(embeddings(spark, sf_dir))


def op13_radix_trie_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


QUERIES = {
    "op1_factorization_machine_toxicity": op1_factorization_machine_toxicity,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_temperature_mixing": op4_temperature_mixing,
    "op5_quality_rules": op5_quality_rules,
    "op6_sampled_splitter_shards": op6_sampled_splitter_shards,
    "op7_rans_token_files": op7_rans_token_files,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_norm_bucketed_negatives": op11_norm_bucketed_negatives,
    "op12_learned_partition_neighbours": op12_learned_partition_neighbours,
    "op13_radix_trie_divergence": op13_radix_trie_divergence,
}

ORACLE_SQL = {
    "op3_license_scan": licenses.ORACLE_SQL,
    "op5_quality_rules": quality.ORACLE_SQL,
    "op9_exact_dedup": exact.ORACLE_SQL,
    "op13_radix_trie_divergence": divergence.ORACLE_SQL,
}
