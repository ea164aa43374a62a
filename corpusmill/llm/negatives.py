"""Hard negatives by norm-bucketed search for integer inner products in windows.

Candidates are sorted by length and cut into groups, and inside a group into buckets of falling length. A product is at
most the product of the two lengths (Cauchy-Schwarz), so an anchor never travels to a group, and never meets a bucket,
whose longest vector cannot reach the lower limit of any of its windows or the last of the best that it has found there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions
from .meeting import BUCKET, NONE, firsts, groups, matrix, meet, usable, widened

POSITIVES, NEGATIVES = 5, 5
GROUP_ROWS = 32_768  # candidates that a task holds at a time, about
FEW_ROWS = 2_048  # smaller groups are not made to keep more tasks busy
SLACK = 1 + 1e-9  # lengths are rounded, products are not


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; those beyond 64 bits count as the nearest such number."""
    q, x = widened(q, x)
    top = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * max(1, q.shape[1])
    if top < 2**53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    big = q.astype(object) @ x.T.astype(object) if q.shape[1] else np.zeros((len(q), len(x)), object)
    return np.clip(big, NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


def _search(same: bool, keep: int):
    """A kernel: the first ``keep`` of each group for each window of each anchor, of its own label or of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, q in groups(batches):
            xv, qv = matrix(x["vector"]), matrix(q["vector"])
            (xi, xl, xn), (qi, ql, qn) = ([t[c].to_numpy() for c in ("vec_id", "label", "length")] for t in (x, q))
            low, high = matrix(q["lows"]), matrix(q["highs"])
            n, w = low.shape
            best = np.full((n * w, keep), NONE)
            ids = np.zeros((n * w, keep), np.int64)
            own = np.repeat(np.arange(n), w)
            for at in range(0, len(xi), BUCKET):  # candidates come by falling length
                b = slice(at, at + BUCKET)
                limit = np.maximum(low.ravel(), best[:, -1]).reshape(n, w)
                reach = (qn * xn[b][0] * SLACK + 1)[:, None] >= limit
                asks = np.flatnonzero((reach & (low <= high)).any(axis=1))
                if not len(asks):
                    if not ((qn * xn[b][0] * SLACK + 1)[:, None] >= low).any():
                        break
                    continue
                s = products(qv[asks], xv[b])
                fit = (ql[asks][:, None] == xl[b]) == same
                fit &= qi[asks][:, None] != xi[b]
                owner, score, found = [np.repeat(np.arange(n * w), keep)[best.ravel() != NONE]], [best[best != NONE]], [ids[best != NONE]]
                for k in range(w):
                    r, c = np.nonzero(fit & (s <= high[asks, k][:, None]) & (s >= limit[asks, k][:, None]))
                    owner.append(asks[r] * w + k), score.append(s[r, c]), found.append(xi[b][c])
                owner, score, found = (np.concatenate(v) for v in (owner, score, found))
                take = firsts(owner, score, found, keep)
                owner = owner[take]
                rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
                best[owner, rank], ids[owner, rank] = score[take], found[take]
            some = best != NONE
            r = np.nonzero(some)[0]
            out = [qi[own[r]], r % w, ids[some], best[some]]
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in out], ["anchor_id", "slot", "vec_id", "score"])

    return run


def _length(vector: str) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def hard_negatives(rows: DataFrame, every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of every ``every``-th row's vec_id.

    ``rows`` has vec_id, label and embedding; other columns are ignored. Rows without a vec_id, label or vector, or with a
    null or non-finite component, take no part; rows that share a vec_id count once (``meeting.usable``). Vectors of
    different sizes are filled up with zeros; empty ones score 0 with all. Components and scores beyond 64 bits count as
    the nearest such number. An anchor without another row of its label, or whose windows hold nothing, gives no row.
    Positives with a score under 0 have empty windows. Ties go to the smaller vec_id. An empty table gives no rows.
    """
    turned = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")).cast("int")
    whole = usable(rows.where("label IS NOT NULL")).select("vec_id", turned.alias("label"), F.transform("vector", lambda x: F.floor(x * 256)).alias("vector"))
    spark = rows.sparkSession
    some = materialize(whole.withColumn("length", _length("vector")), "vectors")
    n = some.count()
    cut = max(1, -(-n // GROUP_ROWS), min(partitions(rows.sparkSession), n // FEW_ROWS))
    # Ranges over length and vec_id: rows of one length are cut as well.
    dealt = materialize(some.repartitionByRange(cut, F.desc("length"), "vec_id").withColumn("grp", F.spark_partition_id().cast("long")), "lengths")
    longest = materialize(dealt.groupBy("grp").agg(F.max("length").alias("longest")), "longest")
    last = longest.agg(F.max("grp")).first()[0] or 0
    anchors = dealt.where(F.col("vec_id") % every == 0).select("vec_id", "label", "length", "vector")

    def met(asked: DataFrame, same: bool, keep: int) -> DataFrame:
        copies = asked.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))).join(longest, "grp")
        queries = copies.where(F.col("length") * F.col("longest") * SLACK + 1 >= F.array_min("lows")).drop("longest")
        found = meet(dealt, queries, [F.desc("length"), "vec_id"], _search(same, keep), "anchor_id long, slot long, vec_id long, score long")
        order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)

    whatever = {"lows": F.array(F.lit(NONE + 1).cast("long")), "highs": F.array(F.lit(np.iinfo(np.int64).max).cast("long"))}
    near = met(anchors.withColumns(whatever), True, POSITIVES)
    positives = near.select("anchor_id", (F.col("rank") - 1).cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    positives = materialize(positives, "positives")
    window = F.array_sort(F.collect_list(F.struct("slot", "positive_score"))).alias("w")  # five at most
    windows = positives.where("positive_score >= 0").groupBy("anchor_id").agg(window)
    # 80 * positive <= 100 * negative holds from the positive's score less its fifth, rounded down, upwards.
    windows = windows.selectExpr("anchor_id AS vec_id", "w.positive_score AS highs", "transform(w.positive_score, p -> p - p div 5) AS lows")
    negatives = met(anchors.join(windows, "vec_id"), False, NEGATIVES)
    out = negatives.select("anchor_id", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(positives, ["anchor_id", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
