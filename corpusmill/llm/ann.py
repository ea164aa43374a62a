"""Approximate nearest neighbours by learned partitions.

1. On a bounded sample the graph of each row's neighbours is cut into cells of nearly equal size with few edges between
   them: median splits, then moves of rows to the cell of most of their neighbours as far as there is room.
2. A network of one hidden layer learns, from the vector, how a row's neighbours spread over the cells.
3. Every row of the table goes to its most probable cell; a query is routed to its most probable cells, as many as the
   rows held out of the fit needed to find ``TARGET`` of their neighbours, and all rows there are ranked exactly: first
   those of the most probable cell, then from the others only those that reach the last of the best found there.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .meeting import firsts, groups, in_order, matrix, meet, usable, widened

SAMPLE = 8_192  # the bound of the sample that the cells are fitted on: the rows of the least hashes of their vec_ids
CELL_ROWS, MOST_CELLS = 512, 256  # a cell for so many rows at least, and the bound of the cells
GROUP_ROWS = 16_384  # rows of a cell that a task holds at a time, about
NEIGHBOURS, ROOM, MOVES = 20, 1.05, 12
HIDDEN, EPOCHS, RATE, SEED = 128, 24, 2e-3, 7
HELD_OUT, TARGET = 5, 0.96  # every fifth sampled row routes only; the share of its neighbours that routing must find
TOP = 20


def neighbours(x: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` rows of largest inner product with each row of ``of``, which are rows of ``x`` by number, but itself."""
    out = np.empty((len(of), k), np.int64)
    for at in range(0, len(of), 512):
        s = x[of[at : at + 512]] @ x.T
        s[np.arange(len(s)), of[at : at + 512]] = -np.inf
        out[at : at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _spread(near: np.ndarray, cell: np.ndarray, cells: int) -> np.ndarray:
    """How many edges, of either direction, lead from each row to each cell."""
    n, k = near.shape
    own = np.repeat(np.arange(n), k)
    out = np.bincount(own * cells + cell[near.ravel()], minlength=n * cells)
    return (out + np.bincount(near.ravel() * cells + cell[own], minlength=n * cells)).reshape(n, cells)


def balanced_cells(x: np.ndarray, near: np.ndarray, cells: int) -> np.ndarray:
    """A cell for each row: nearly equal sizes, few edges between cells. ``cells`` is a power of two."""
    rng = np.random.default_rng(SEED)
    cell = np.zeros(len(x), np.int64)
    for _ in range(cells.bit_length() - 1):
        halves = np.empty_like(cell)
        for c in np.unique(cell):
            rows = np.flatnonzero(cell == c)
            part = x[rows] - x[rows].mean(axis=0)
            axis = rng.normal(size=x.shape[1]).astype(x.dtype)
            for _ in range(8):  # power iteration to the direction of most spread
                axis = part.T @ (part @ axis)
                axis /= max(float(np.linalg.norm(axis)), 1e-30)
            order = np.argsort(part @ axis, kind="stable")
            halves[rows[order]] = 2 * c + (np.arange(len(rows)) >= len(rows) // 2)
        cell = halves
    room = int(np.ceil(len(x) / cells * ROOM))
    size = np.bincount(cell, minlength=cells)
    for _ in range(MOVES):
        edges = _spread(near, cell, cells)
        want = edges.argmax(axis=1)
        gain = edges[np.arange(len(x)), want] - edges[np.arange(len(x)), cell]
        moved = 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())].tolist():
            if size[want[i]] < room:
                size[cell[i]] -= 1
                size[want[i]] += 1
                cell[i] = want[i]
                moved += 1
        if moved <= len(x) // 1000:
            break
    return cell


def classifier(x: np.ndarray, share: np.ndarray) -> dict[str, np.ndarray]:
    """Weights of a network that gives the logarithm of each row's ``share`` of the cells, by Adam on small batches."""
    rng = np.random.default_rng(SEED)
    d, m = x.shape[1], share.shape[1]
    w = {"a": rng.normal(size=(d, HIDDEN)) * np.sqrt(2 / max(d, 1)), "b": np.zeros(HIDDEN), "c": rng.normal(size=(HIDDEN, m)) / np.sqrt(HIDDEN), "d": np.zeros(m)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            rows = order[at : at + 128]
            inner = x[rows] @ w["a"] + w["b"]
            hidden = np.maximum(inner, 0)
            logit = hidden @ w["c"] + w["d"]
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            error = (p / p.sum(axis=1, keepdims=True) - share[rows]) / len(rows)
            back = (error @ w["c"].T) * (inner > 0)
            gradient = {"a": x[rows].T @ back, "b": back.sum(axis=0), "c": hidden.T @ error, "d": error.sum(axis=0)}
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in gradient.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                w[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return w


def ranked_cells(model: dict[str, np.ndarray], v: np.ndarray) -> np.ndarray:
    """Cells of each vector, most probable first. One after the other, so that equal vectors get equal answers."""
    x = np.zeros((len(v), model["a"].shape[0]), np.float32)
    wide = min(v.shape[1], x.shape[1])
    x[:, :wide] = np.nan_to_num(v[:, :wide] / model["scale"], posinf=0, neginf=0)
    hidden = np.maximum(np.einsum("nd,dh->nh", x, model["a"], optimize=False) + model["b"], 0)
    logit = np.einsum("nh,hm->nm", hidden, model["c"], optimize=False) + model["d"]
    return np.argsort(-logit, axis=1, kind="stable")


def fit(v: np.ndarray, cells: int) -> dict[str, np.ndarray]:
    """The routing model of ``cells`` cells, and how many cells a query is routed to."""
    scale = max(float(np.sqrt((v * v).sum(axis=1).mean())) if len(v) else 0.0, 1e-300)
    x = (v / scale).astype(np.float32)
    held = np.arange(len(x)) % HELD_OUT == 0
    model = {"a": np.zeros((v.shape[1], 1), np.float32), "b": np.zeros(1, np.float32), "c": np.zeros((1, 1), np.float32), "d": np.zeros(1, np.float32)}
    probes = 1
    if cells > 1:
        own = x[~held]
        near = neighbours(own, np.arange(len(own)), min(NEIGHBOURS, len(own) - 1))
        cell = balanced_cells(own, near, cells)
        share = _spread(near, cell, cells) + np.eye(cells)[cell]
        model = classifier(own, (share / share.sum(axis=1, keepdims=True)).astype(np.float32))
    model["scale"] = np.float64(scale)
    if cells > 1:
        route = ranked_cells(model, v)
        asks = np.flatnonzero(held)
        found = route[:, 0][neighbours(x, asks, min(TOP, len(x) - 1))]
        place = np.argsort(route[asks], axis=1)[np.arange(len(asks))[:, None], found]
        probes = int(np.searchsorted(np.cumsum(np.bincount(place.ravel(), minlength=cells)) / place.size, TARGET)) + 1
    return model | {"probes": np.int64(min(probes, cells))}


def _fit_task(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, pa.schema([("vector", pa.list_(pa.float64()))]))
        out = io.BytesIO()
        np.savez(out, **fit(matrix(table["vector"]), cells))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    return run


def _route_task(model: dict[str, np.ndarray], every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                route = ranked_cells(model, matrix(batch.column(1))).astype(np.int32)
                asks = batch.column(0).to_numpy() % every == 0
                cells = pa.array([r[: int(model["probes"])] if a else None for r, a in zip(route, asks, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(route[:, 0]), cells], ["vec_id", "vector", "cell", "cells"])

    return run


def _search(keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, q in groups(batches):
            qv, xv = widened(matrix(q["vector"]), matrix(x["vector"]))
            qi, xi = q["vec_id"].to_numpy(), x["vec_id"].to_numpy()
            length = np.sqrt((xv * xv).sum(axis=1))
            slack = 1e-9 * np.sqrt((qv * qv).sum(axis=1))
            owner, score, ids = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
            least = q["least"].to_numpy() - slack * length.max()
            for at in range(0, len(xi), 2048):
                b = slice(at, at + 2048)
                s = qv @ xv[b].T
                s[qi[:, None] == xi[b]] = -np.inf
                if s.shape[1] > keep:
                    own = np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep]
                    least = np.maximum(least, own - slack * length[b].max())  # the last of the best, less what rounding may hide
                r, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                owner, ids = np.concatenate((owner, r)), np.concatenate((ids, xi[b][c]))
                score = np.concatenate((score, in_order(qv[r], xv[b][c])))
                take = firsts(owner, score, ids, keep)
                owner, score, ids = owner[take], score[take], ids[take]
            yield pa.RecordBatch.from_arrays([pa.array(qi[owner]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def cells_for(n: int) -> int:
    """A power of two: a cell for ``CELL_ROWS`` rows, ``MOST_CELLS`` at most."""
    return min(MOST_CELLS, 1 << max(0, (n // CELL_ROWS).bit_length() - 1))


def nearest(rows: DataFrame, every: int = 20, keep: int = TOP) -> DataFrame:
    """query_id, rank, vec_id and score of the ``keep`` nearest found of each row whose vec_id ``every`` divides.

    ``rows`` has vec_id and embedding (and label, not used); other columns are ignored. Rows without a vec_id, with a
    null or empty vector, one of zeros only, or a null or non-finite component, take no part; rows that share a vec_id
    count once (``meeting.usable``). Vectors of different sizes are filled up with zeros. A query is never its own
    neighbour, equal vectors under other vec_ids are; ties go to the smaller vec_id; where the cells that a query is
    routed to hold fewer rows than ``keep``, it gets those. An empty table gives no rows. Every row is indexed; the fit
    alone reads a sample of at most ``SAMPLE`` rows.
    """
    some = materialize(usable(rows).where(F.exists("vector", lambda x: x != 0)).select("vec_id", "vector"), "vectors")
    cells = cells_for(some.count())
    sample = some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector")
    raw = sample.coalesce(1).mapInArrow(_fit_task(cells), "model binary").first()
    model = dict(np.load(io.BytesIO(raw.model))) if raw else fit(np.zeros((0, 0)), 1)
    index = some.mapInArrow(_route_task(model, every), "vec_id long, vector array<double>, cell int, cells array<int>")
    index = materialize(index, "cells")
    sizes = index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("parts"))
    sizes = F.broadcast(materialize(sizes, "sizes"))  # MOST_CELLS rows at most
    grp = lambda part: (F.col("cell").cast("long") * (1 << 32) + part).alias("grp")
    held = index.join(sizes, "cell").select("vec_id", "vector", grp(F.pmod(F.xxhash64("vec_id"), "parts")))
    asks = index.where("cells IS NOT NULL").select("vec_id", "vector", "cells")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).select("query_id", "rank", "vec_id", "score")

    def met(asked: DataFrame) -> DataFrame:
        """Of queries with a cell and the least score that counts."""
        wide = asked.join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return meet(held, wide.select("vec_id", "vector", "least", grp(F.col("part"))), ["vec_id"], _search(keep), "query_id long, vec_id long, score double")

    first = materialize(ranked(met(asks.select("vec_id", "vector", F.lit(float("-inf")).alias("least"), F.col("cells")[0].alias("cell")))), "first")
    last = first.where(F.col("rank") == keep).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    others = asks.join(last, "vec_id", "left").fillna(float("-inf"), ["least"])
    others = others.select("vec_id", "vector", "least", F.explode(F.slice("cells", 2, MOST_CELLS)).alias("cell"))
    return ranked(first.drop("rank").unionByName(met(others)))
