"""Exact vector search within a batch, as blocked matrix products inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DENSE_TOP_K, MIN_DENSE_SCORE
from .meeting import copied, dealt, firsts, groups, in_order, matrix, meet, parts_of, widened

GROUP_ROWS = 16_384  # vectors of a batch that a task holds at a time, about
BUCKET, BLOCK = 2_048, 128  # vectors and questions that are multiplied at once
_SLACK = 1e-8  # more than rounding can move a cosine


def usable(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is there and has finite components only."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col(column).isNotNull()).where(finite)


def kernel(keys: list[str], keep: int, block: int = BLOCK, bucket: int = BUCKET):
    """The ``keep`` best vectors of a group for each of its questions, with the best so far as their bound.

    Scores are cosines, 0 where a vector has no length; vectors of another size than the question's are passed over.
    Groups come sorted by chunk_id, which decides ties of scores rounded to nine digits. Where questions have a
    ``least`` score, lower ones don't count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for held, asks in groups(batches, keys, block):
            if held is not seen:
                seen, x = held, matrix(held["embedding"]).astype(float)
                x_size, x_norm = (np.diff(np.asarray(held["embedding"].combine_chunks().offsets)), np.sqrt(in_order(x, x)))
            q, x_wide = widened(matrix(asks["query_vector"]).astype(float), x)
            q_size, q_norm = np.diff(np.asarray(asks["query_vector"].combine_chunks().offsets)), np.sqrt(in_order(q, q))
            least = asks["least"].to_numpy() - _SLACK
            owner, at, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            for k in range(0, len(x), bucket):
                b = slice(k, k + bucket)
                length = q_norm[:, None] * x_norm[b]
                s = np.divide(q @ x_wide[b].T, length, out=np.zeros((len(q), len(x_norm[b]))), where=length > 0)
                s[q_size[:, None] != x_size[b]] = -np.inf
                if s.shape[1] > keep:
                    least = np.maximum(least, np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep] - _SLACK)
                r, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                if not len(r):
                    continue
                c += k
                length = q_norm[r] * x_norm[c]
                exact = np.divide(in_order(q[r], x_wide[c]), length, out=np.zeros(len(r)), where=length > 0)
                owner, at, score = np.concatenate((owner, r)), np.concatenate((at, c)), np.concatenate((score, exact))
                take = firsts(owner, np.round(score, 9), at, keep)
                owner, at, score = owner[take], at[take], score[take]
            if len(owner):
                found = [asks["query_id"].take(pa.array(owner)), held["batch_id"].take(pa.array(at)), held["chunk_id"].take(pa.array(at))]
                yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in found), pa.array(score)], ["query_id", "batch_id", "chunk_id", "score"])

    return run


def schema_of(vectors: DataFrame, queries: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in [*vectors.schema, *queries.select("query_id").schema]}
    return f"query_id {kinds['query_id']}, batch_id {kinds['batch_id']}, chunk_id {kinds['chunk_id']}, score double"


def best(found: DataFrame, top_k: int, least: float) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= top_k) & (F.col("score") >= least))


def search(vectors: DataFrame, queries: DataFrame, top_k: int = DENSE_TOP_K, least: float = MIN_DENSE_SCORE) -> DataFrame:
    """(query_id, batch_id, chunk_id, score, rank) from (batch_id, chunk_id, embedding) and (query_id, batch_id, query_vector).

    Exact: every vector of the query's batch is compared, in groups of ``GROUP_ROWS`` that hand on ``top_k`` rows of each
    question at most; the threshold applies after the cut. Vectors that are null, hold a null or non-finite component or
    have another size than the question's are never hits, nor is what has no batch.
    """
    held = usable(vectors.select("batch_id", "chunk_id", "embedding"), "embedding")
    asks = usable(queries.select("query_id", "batch_id", "query_vector"), "query_vector").withColumn("least", F.lit(float(least)))
    parts = parts_of(vectors, ["batch_id"], GROUP_ROWS)
    keys = ["batch_id", "part"]
    found = meet(
        dealt(held, parts, ["batch_id"], "chunk_id"), copied(asks, parts, ["batch_id"]), keys, ["chunk_id"], kernel(keys, top_k), schema_of(vectors, queries)
    )
    return best(found, top_k, least)


def nearest(vectors: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """The single best match of each query with a score of ``least`` or more, as a semantic cache looks it up."""
    return search(vectors, queries, 1, least).drop("rank")
