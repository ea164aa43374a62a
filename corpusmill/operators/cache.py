"""The semantic cache: nearest cached question under equal filters, verified, in two tiers, and what goes into it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CACHE_SCORE, CACHE_SURE
from ..functions.embed import embedded
from . import dense, serving

RESPONSE, CONTEXT = "chat_response", "chat_context"
FILTERS = ("complexity", "tutor_mode")  # what a cached response must share with the question, besides the batch
ENTRY = "cache_id string, batch_id string, cache_type string, query string, complexity string, tutor_mode string, embedding array<float>, created_at timestamp"

Embed = Callable[..., DataFrame]
Score = Callable[[DataFrame, str, str], DataFrame]  # (pairs, question column, cached question column) -> rerank_score


def _key(kind: str, filters: tuple[str, ...]) -> Column:
    """Equal for rows that agree in batch, kind and filters; null where the batch is."""
    parts = [F.col("batch_id").cast("string"), F.lit(kind), *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in filters)]
    return F.when(F.col("batch_id").isNotNull(), F.to_json(F.array(*parts)))


def lookup(
    asked: DataFrame, entries: DataFrame, values: DataFrame, now: Column, verify: Score, kind: str, filters: tuple[str, ...] = (), embed: Embed = embedded
) -> DataFrame:
    """(query_id, score, values' columns) of the questions (query_id, batch_id, text, filters) that the cache answers.

    Only the nearest entry of the same batch, ``kind`` and filters counts, ties by cache_id: close enough, verified
    against the cached question unless nearly the same, and not too old. ``values`` has cache_id, created_at and what is
    kept. Only pairs of a question and its nearest entry are ever verified.
    """
    held = entries.where(F.col("cache_type") == kind).select(_key(kind, filters).alias("batch_id"), F.col("cache_id").alias("chunk_id"), "embedding")
    questions = embed(asked.select("query_id", _key(kind, filters).alias("batch_id"), "text"), "text", "query_vector")
    near = dense.nearest(held, questions, CACHE_SCORE).select("query_id", F.col("chunk_id").alias("cache_id"), "score")
    pairs = near.join(asked.select("query_id", "text"), "query_id").join(entries.select("cache_id", F.col("query").alias("cached")), "cache_id")
    sure = (F.col("score") >= CACHE_SURE) | (F.coalesce("cached", F.lit("")) == "")
    columns = ["query_id", "cache_id", "score"]
    verified = verify(pairs.where(~sure), "text", "cached").select(*columns, F.col("rerank_score").alias("verify_score"))
    matches = pairs.where(sure).select(*columns, F.lit(1.0).alias("verify_score")).unionByName(verified)
    return serving.semantic_cache(matches, values, now).drop("verify_score", "cache_id", "created_at")


def entries_of(answered: DataFrame, kind: str, now: Column, embed: Embed = embedded) -> DataFrame:
    """``ENTRY`` rows for (query_id, batch_id, text, complexity, tutor_mode); a question's entry has the same id whenever it is made again."""
    name = F.sha2(F.to_json(F.array(F.lit(kind), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("batch_id", "text", *FILTERS)))), 256)
    rows = embed(answered.select(name.alias("cache_id"), "batch_id", "text", *FILTERS).dropDuplicates(["cache_id"]), "text", "embedding")
    return rows.select("cache_id", "batch_id", F.lit(kind).alias("cache_type"), F.col("text").alias("query"), *FILTERS, "embedding", now.cast("timestamp").alias("created_at"))
