"""Keeping an index up to date: points, deletions, checks, readiness, and the chain from documents to an index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EMBED_DIM
from ..functions.embed import embedded
from . import bm25, chunking, graph


def chunked(documents: DataFrame) -> DataFrame:
    """The chunks of (doc_id, text, source) documents that are worth a vector; a document's source is its batch."""
    return chunking.pack(chunking.sections(chunking.line_blocks(documents))).where("embedding_eligible")


def points(chunks: DataFrame, embed: Callable[..., DataFrame] = embedded) -> DataFrame:
    """(batch_id, document_id, chunk_id, section_title, text, embedding): what a vector store holds of each chunk."""
    return embed_unique(chunks.select("batch_id", "document_id", "chunk_id", "section_title", "text"), "text", embed)


def ingest(documents: DataFrame, embed: Callable[..., DataFrame] = embedded) -> tuple[DataFrame, bm25.Bm25Index, DataFrame]:
    """(points, lexical index, thematic edges) of documents: chunks, vectors, and both indexes of their batches."""
    held = points(chunked(documents), embed)
    return held, bm25.build(held), graph.thematic_edges(held)


def embed_unique(rows: DataFrame, column: str, embed: Callable[..., DataFrame] = embedded) -> DataFrame:
    """``rows`` with an ``embedding``: each different text, trimmed, is embedded once."""
    key = F.trim(F.coalesce(F.col(column), F.lit("")))
    once = embed(rows.select(key.alias("_text")).distinct(), "_text").withColumnRenamed("embedding", "_vector")
    return rows.withColumn("_text", key).join(once, "_text").withColumnRenamed("_vector", "embedding").drop("_text")


def upsert_points(old: DataFrame, new: DataFrame) -> DataFrame:
    """The points after an ingest: those of a chunk_id that comes again are replaced, so a repeated ingest changes nothing."""
    return old.join(new.select("batch_id", "chunk_id").distinct(), ["batch_id", "chunk_id"], "left_anti").unionByName(new)


def delete_document(held: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points that are left, those of them whose batch must be indexed anew) after (batch_id, document_id) were deleted."""
    keys = ["batch_id", "document_id"]
    left = held.join(documents.select(*keys), keys, "left_anti")
    return left, left.join(documents.select("batch_id").distinct(), "batch_id", "left_semi")


def cleared(rows: DataFrame) -> DataFrame:
    """An empty table of the same columns."""
    return rows.limit(0)


def wrong_dimensions(vectors: DataFrame, dim: int = EMBED_DIM) -> DataFrame:
    """Rows whose vector is missing or has another size."""
    return vectors.where(F.col("embedding").isNull() | (F.size("embedding") != dim))


def upkeep_actions(batches: DataFrame, held: DataFrame) -> DataFrame:
    """(batch_id, action): "ready" with both indexes, "rebuild" with chunks alone, "purge" without any chunk.

    ``batches`` has batch_id, has_lexical and has_graph.
    """
    some = held.select("batch_id").distinct().withColumn("_held", F.lit(True))
    action = F.when(F.col("has_lexical") & F.col("has_graph"), "ready").when(F.col("_held"), "rebuild").otherwise("purge")
    return batches.join(some, "batch_id", "left").select("batch_id", action.alias("action"))


def index_bytes(rows: DataFrame, *columns: str) -> DataFrame:
    """(batch_id, bytes): half as much again as the index of a batch has as JSON."""
    size = F.length(F.to_json(F.struct(*(columns or [c for c in rows.columns if c != "batch_id"]))))
    return rows.groupBy("batch_id").agg((F.sum(size) * 1.5).cast("long").alias("bytes"))


def orphans(rows: DataFrame, batches: DataFrame) -> DataFrame:
    """Rows of batches that no longer exist."""
    return rows.join(batches, "batch_id", "left_anti")


def write_results(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Rows as JSON lines, and their summary as one JSON file beside them."""
    rows.write.mode("overwrite").json(f"{path}/results")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


