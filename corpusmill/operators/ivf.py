"""An inverted file over vectors: cells around centroids, searched nearest first, with an exact check of the rest.

Centroids come from a bounded sample. Each cell of a batch knows the largest angle between its centroid and one of its
vectors, so a cosine in the cell is at most that of the angle to the centroid less the cell's own. A search ranks the
nearest cells first; an exact one then looks into every cell whose bound reaches the last of the best found so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DENSE_TOP_K, MIN_DENSE_SCORE
from . import dense
from .lineage import cut
from .meeting import copied, dealt, matrix, meet, parts_of

SAMPLE, ROUNDS = 16_384, 12  # rows that centroids are fitted on at most, and rounds of the fit
CELL_ROWS, MOST_CELLS = 512, 1_024
PROBES = 8


class IvfIndex(NamedTuple):
    rows: DataFrame  # batch_id, chunk_id, embedding, cell
    centroids: DataFrame  # cell, centroid; MOST_CELLS rows at most
    cells: DataFrame  # batch_id, cell, parts, angle


def unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, length, out=np.zeros(x.shape), where=length > 0)


def centroids(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Directions of ``cells`` clusters of unit vectors; a cluster that loses all rows keeps its direction."""
    found = x[np.linspace(0, len(x) - 1, cells).astype(int)] if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(rounds):
        own = (x @ found.T).argmax(axis=1) if len(x) else np.empty(0, int)
        sums = np.zeros_like(found)
        np.add.at(sums, own, x)
        found = np.where((sums**2).sum(axis=1, keepdims=True) > 0, unit(sums), found)
    return found


def _fit(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            found = centroids(unit(matrix(pa.Table.from_batches(held)["embedding"]).astype(float)), cells)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array(found.tolist(), pa.list_(pa.float64()))], ["cell", "centroid"])

    return run


def _cosines(column: pa.Array, c: np.ndarray) -> np.ndarray:
    x = unit(matrix(column).astype(float))
    wide = max(x.shape[1], c.shape[1])
    return np.clip(np.pad(x, ((0, 0), (0, wide - x.shape[1]))) @ np.pad(c, ((0, 0), (0, wide - c.shape[1]))).T, -1, 1)


def _placed(c: np.ndarray):
    """(cell, angle) of the nearest centroid behind the columns of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _cosines(batch.column(batch.schema.get_field_index("embedding")), c)
            cell = s.argmax(axis=1)
            angle = np.arccos(s[np.arange(len(s)), cell])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], [*batch.schema.names, "cell", "angle"])

    return run


def _routed(c: np.ndarray):
    """The cells of each question, nearest first, and the angles to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle = np.arccos(_cosines(batch.column(batch.schema.get_field_index("query_vector")), c))
            order = np.argsort(angle, axis=1, kind="stable")
            ends = pa.array(np.arange(len(order) + 1, dtype=np.int32) * len(c))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.ravel())) for v in (order.astype(np.int32), np.take_along_axis(angle, order, axis=1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*batch.schema.names, "cells", "angles"])

    return run


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _model(centres: DataFrame) -> np.ndarray:
    rows = centres.orderBy("cell").collect()  # MOST_CELLS at most
    return np.array([r.centroid for r in rows]) if rows else np.zeros((1, 1))


def build(vectors: DataFrame, cells: int | None = None) -> IvfIndex:
    """The index of (batch_id, chunk_id, embedding); rows without a usable vector are left out.

    Without ``cells``, there is one for ``CELL_ROWS`` rows, ``MOST_CELLS`` at most. Every row is indexed; the centroids
    alone come from the ``SAMPLE`` rows of the least hashes of their ids.
    """
    held = dense.usable(vectors.select("batch_id", "chunk_id", "embedding"), "embedding").where("batch_id IS NOT NULL")
    if cells is None:
        cells = max(1, min(MOST_CELLS, held.count() // CELL_ROWS))
    sample = held.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).select("embedding").coalesce(1)
    centres = cut(sample.mapInArrow(_fit(cells), "cell int, centroid array<double>"))
    rows = cut(held.mapInArrow(_placed(_model(centres)), f"{_ddl(held)}, cell int, angle double"))
    reach = rows.groupBy("batch_id", "cell").agg(F.max("angle").alias("angle"))
    return IvfIndex(rows.drop("angle"), centres, cut(parts_of(rows, ["batch_id", "cell"], dense.GROUP_ROWS).join(reach, ["batch_id", "cell"])))


def write(index: IvfIndex, path: str) -> None:
    """The index as tables; vectors lie by cell, so that a search of few cells reads few files."""
    index.rows.repartition("cell").sortWithinPartitions("batch_id", "chunk_id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    for name in ("centroids", "cells"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str) -> IvfIndex:
    return IvfIndex(*(spark.read.parquet(f"{path}/{name}") for name in IvfIndex._fields))


def search(
    index: IvfIndex, queries: DataFrame, top_k: int = DENSE_TOP_K, least: float = MIN_DENSE_SCORE, probes: int = PROBES, exact: bool = True
) -> DataFrame:
    """``dense.search`` over the index: (query_id, batch_id, chunk_id, score, rank).

    The ``probes`` nearest cells of the query's batch are ranked first. With ``exact`` the result is that of
    ``dense.search``: cells whose bound reaches the last of the best found, and ``least``, are ranked too.
    """
    asks = dense.usable(queries.select("query_id", "batch_id", "query_vector"), "query_vector")
    routed = asks.mapInArrow(_routed(_model(index.centroids)), f"{_ddl(asks)}, cells array<int>, angles array<double>")
    route = routed.select("query_id", "batch_id", F.explode(F.arrays_zip("cells", "angles")).alias("r"))
    route = route.select("query_id", "batch_id", F.col("r.cells").alias("cell"), F.col("r.angles").alias("to")).join(index.cells, ["batch_id", "cell"])
    bound = F.cos(F.greatest(F.lit(0.0), F.col("to") - F.col("angle"))) + 1e-9
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("to", "cell"))
    route = cut(route.select("query_id", "batch_id", "cell", bound.alias("bound"), turn.alias("turn")))
    parts = index.cells.select("batch_id", "cell", "parts")
    keys, kinds = ["batch_id", "cell", "part"], dense.schema_of(index.rows, queries)
    held = dealt(index.rows, parts, ["batch_id", "cell"], "chunk_id")

    def met(where: DataFrame) -> DataFrame:
        wide = copied(where.join(asks, ["query_id", "batch_id"]).select("query_id", "batch_id", "cell", "query_vector", "least"), parts, ["batch_id", "cell"])
        return meet(held, wide, keys, ["chunk_id"], dense.kernel(keys, top_k), kinds)

    first = dense.best(met(route.where(F.col("turn") <= probes).withColumn("least", F.lit(float(least)))), top_k, least)
    if not exact:
        return first
    first = cut(first)
    last = first.where(F.col("rank") == top_k).select("query_id", F.col("score").alias("last"))
    rest = route.where(F.col("turn") > probes).join(last, "query_id", "left").withColumn("least", F.coalesce("last", F.lit(float(least))))
    return dense.best(first.drop("rank").unionByName(met(rest.where(F.col("bound") >= F.col("least")).drop("last"))), top_k, least)
