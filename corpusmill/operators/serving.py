"""Serving-side operators: tenant gates, caches, drift guards, impact of rewrites, artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CACHE_SCORE, CACHE_SURE, CACHE_TTL_S, CACHE_VERIFY, DRIFT_GUARDS


def materialise(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Payloads of ranked chunks in rank order; chunks of another batch and missing ones drop out, of duplicates the last stays."""
    last = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("ingested_at")))
    one = chunks.withColumn("_n", last).where("_n = 1").drop("_n")
    owner = F.coalesce(one["batch_id"], one["metadata_batch_id"])
    return ranked.join(one.withColumn("owner", owner).drop("batch_id", "metadata_batch_id"), "chunk_id").where(F.col("owner") == F.col("batch_id")).drop("owner")


def drift_least(kind: Column) -> Column:
    """The similarity that a rewrite of a type needs; null for types that always stay."""
    return F.create_map(*(F.lit(x) for p in DRIFT_GUARDS.items() for x in p))[kind]


def drift_guard(rewrites: DataFrame, similarity: str = "similarity") -> DataFrame:
    """Rewrites close enough to the query for their type; other types always stay."""
    return rewrites.where(F.coalesce(F.col(similarity) >= drift_least(F.col("type")), F.lit(True)))


def semantic_cache(matches: DataFrame, values: DataFrame, now: Column) -> DataFrame:
    """Cached values of the best matches: close enough, verified unless nearly the same, and not too old."""
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "cache_id"))
    top = matches.withColumn("_n", best).where((F.col("_n") == 1) & (F.col("score") >= CACHE_SCORE)).drop("_n")
    sure = top.where((F.col("score") >= CACHE_SURE) | (F.col("verify_score") >= CACHE_VERIFY))
    return sure.join(values, "cache_id").where(F.unix_timestamp(now) - F.unix_timestamp("created_at") < CACHE_TTL_S)


def rewrite_impact(hits: DataFrame, alpha: float) -> DataFrame:
    """The rewrite that adds most to a query's results: dense scores weigh ``alpha``, sparse the rest; ties by text."""
    part = F.col("score") * F.col("weight") * F.when(F.col("channel") == "dense", alpha).otherwise(1 - alpha)
    total = hits.groupBy("query_id", "rewrite").agg(F.sum(part).alias("impact"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("impact", 9)), "rewrite"))
    return total.withColumn("_n", best).where("_n = 1").drop("_n")


def origins(hits: DataFrame) -> DataFrame:
    """Sorted channels of each candidate."""
    return hits.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_set("channel")).alias("origins"))


def prompt_context(ranked: DataFrame) -> DataFrame:
    """The passages of each query as one prompt text, best first."""
    passage = F.concat(F.lit("[DOC_ID: "), F.col("chunk_id").cast("string"), F.lit("]\n"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", passage.alias("p"))))
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["p"]), "\n\n").alias("context"))


def valid_scripts(lines: DataFrame, least: int = 6) -> DataFrame:
    """Lines of scripts that have ``least`` usable ones."""
    n = F.count(F.lit(1)).over(Window.partitionBy("topic"))
    return lines.where(F.col("host").isNotNull() & (F.trim("text") != "")).withColumn("_n", n).where(F.col("_n") >= least).drop("_n")


def ledger_diff(ledger: DataFrame, active: DataFrame) -> DataFrame:
    """(file_id, action) that bring a processed-file ledger up to the active files."""
    new = active.join(ledger, ["batch_id", "file_id"], "left_anti").select("batch_id", "file_id", F.lit("INGEST").alias("action"))
    gone = ledger.join(active, ["batch_id", "file_id"], "left_anti").select("batch_id", "file_id", F.lit("DELETE").alias("action"))
    return new.unionByName(gone)
