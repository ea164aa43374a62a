"""Mixing sources to target weights by temperature.

Weights are token shares raised to one exponent and normalised. The exponent is bisected: the largest at which the
weights reach the wanted share of the highest entropy, unless a source would then be repeated more often than allowed;
then the smallest that keeps the limit. Entropy and repetition are sums over the table of sources, which Spark takes
for a grid of exponents at once, so a search is a few small jobs for any number of sources. Weights are realised as
block permutations: each source is a stream of epochs, each epoch a permutation of its documents by a keyed hash; a
block takes from every stream the source's weight of its token budget. Prefix sums go by buckets of the hash, so a
source with a third of all rows is never one task.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

ENTROPY, REPEATS = 0.95, 2.0  # share of the highest entropy; most epochs of a source for each of the least repeated one
BLOCK_TOKENS, BUCKET_ROWS, SEED = 1_000_000, 5_000, 11
GRID, NARROWINGS = 33, 8  # exponents looked at in one job, and how often the interval is narrowed: 32 ** -8 is left of it
BROADCAST_SOURCES = 100_000  # rows of the table of sources, about 100 bytes each, that are sent to every task at most


def weights(tokens: dict, exponent: float) -> dict:
    """Normalised shares to the power ``exponent``; sources without tokens weigh nothing."""
    logs = {s: exponent * log(t) for s, t in tokens.items() if t > 0}
    top = max(logs.values(), default=0.0)
    raised = {s: exp(x - top) for s, x in logs.items()}
    total = sum(raised.values())
    return {s: raised.get(s, 0.0) / total if total else 0.0 for s in tokens}


def entropy(w: dict) -> float:
    return -sum(x * log(x) for x in w.values() if x > 0)


def repetition(tokens: dict, w: dict) -> float:
    """Epochs of the most repeated source for each epoch of the least repeated."""
    rates = [w[s] / t for s, t in tokens.items() if t > 0]
    return max(rates) / min(rates) if rates else 1.0


Measure = Callable[[list[float]], list[tuple[float, float]]]


def _last_true(low: float, high: float, holds: Callable[[list[float]], list[bool]]) -> float:
    """The largest exponent of [low, high] up to which ``holds``, which is true at ``low``."""
    for _ in range(NARROWINGS):
        grid = [low + (high - low) * i / (GRID - 1) for i in range(GRID)]
        good = holds(grid)
        if all(good):
            return high
        i = good.index(False)
        low, high = grid[max(0, i - 1)], grid[i]
    return low


def find_exponent(measure: Measure, highest: float, target: float = ENTROPY, limit: float = REPEATS) -> float:
    """The exponent from 0 (all sources alike) to 1 (as they are).

    ``measure`` gives entropy and repetition for exponents; ``highest`` is the entropy of equal weights.
    """
    found = _last_true(0.0, 1.0, lambda grid: [h >= target * highest - 1e-9 for h, _ in measure(grid)])
    # Repetition falls as the exponent grows: from the other end, the last one that keeps the limit.
    kept = 1.0 - _last_true(0.0, 1.0, lambda grid: [r <= limit + 1e-9 for _, r in measure([1.0 - x for x in grid])])
    return max(found, kept)


def measure_dict(tokens: dict) -> Measure:
    """``measure`` of a few sources by hand."""

    def at(grid: list[float]) -> list[tuple[float, float]]:
        found = [weights(tokens, a) for a in grid]
        return [(entropy(w), repetition(tokens, w)) for w in found]

    return at


def measure_table(sources: DataFrame, top: float, bottom: float) -> Measure:
    """``measure`` of a table of sources (column ``cost``) whose largest and smallest cost are given.

    With u = exp(a * log(cost / top)), the weight is u / sum(u), so the entropy is log(sum u) - sum(u * log u) / sum(u);
    the repetition is (top / bottom) ** (1 - a).
    """

    def at(grid: list[float]) -> list[tuple[float, float]]:
        x = F.log(F.col("cost") / F.lit(top))
        sums = []
        for a in grid:
            u = F.exp(F.lit(a) * x)
            sums += [F.sum(u), F.sum(u * F.lit(a) * x)]
        row = sources.agg(*(c.alias(f"c{i}") for i, c in enumerate(sums))).first()
        pairs = zip(row[::2], row[1::2], strict=True)
        return [(log(s) - t / s, (top / bottom) ** (1 - a)) for (s, t), a in zip(pairs, grid, strict=True)]

    return at


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _source(docs: DataFrame) -> Column:
    return F.coalesce(docs["source"].cast("string"), F.lit(""))


def _cost() -> Column:
    """What a reading takes of the budget: its tokens, and 1 for a text without any, so that no block takes them all."""
    return F.greatest(F.lit(1).cast("long"), F.col("n_tokens"))


def _keys(epoch: Column) -> tuple[Column, Column]:
    """Where a document stands in the permutation of an epoch; ties go by doc_id."""
    full = F.xxhash64("doc_id", epoch.cast("long"), F.lit(SEED))
    return F.pmod(full, F.lit(1 << 31)), full


def mixing_plan(rows: DataFrame, target: float = ENTROPY, limit: float = REPEATS, budget: float | None = None) -> tuple[DataFrame, float, int]:
    """((source, n, cost, weight, epochs) of each source, exponent, sources) from (source, n_tokens) rows.

    Without a budget, the least repeated source is read exactly once, so that no document is left out.
    """
    sources = materialize(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(_cost()).alias("cost")), "sources")
    count, top, bottom = sources.agg(F.count(F.lit(1)), F.max("cost"), F.min("cost")).first()
    if not count:
        return sources.withColumn("weight", F.lit(0.0)).withColumn("epochs", F.lit(0.0)), 1.0, 0
    exponent = find_exponent(measure_table(sources, top, bottom), log(count), target, limit)
    raised = F.exp(F.lit(exponent) * F.log(F.col("cost") / F.lit(top)))
    total = sources.agg(F.sum(raised)).first()[0]
    # The least repeated source is the one of the highest cost, as the exponent is at most 1.
    budget = budget if budget is not None else top * total
    weight = raised / F.lit(total)
    epochs = weight * F.lit(float(budget)) / F.col("cost")
    # Without what floating point adds to a whole number.
    whole = F.when(F.abs(epochs - F.round(epochs)) < 1e-9, F.round(epochs)).otherwise(epochs)
    return materialize(sources.select("source", "n", "cost", weight.alias("weight"), whole.alias("epochs")), "weights"), exponent, count


def mix(docs: DataFrame, target: float = ENTROPY, limit: float = REPEATS, budget: float | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Placements (doc_id, source, epoch, n_tokens, weight, block, position), one for each reading of a document.

    Tokens are words. A null source counts as the source ''; null, empty and other texts without words have no tokens
    and take one place each of their source's budget; a text longer than a block makes the block longer. Rows that
    repeat a doc_id, null ones too, are documents of their own, in an order that is open only among fully equal rows.
    Other columns are ignored; an empty table gives no rows. A reading belongs to the mixture if it begins inside its
    source's share of the budget.
    """
    rows = materialize(docs.select("doc_id", _source(docs).alias("source"), token_count(docs["text"]).alias("n_tokens")), "sized")
    plan, _, count = mixing_plan(rows, target, limit, budget)
    table = plan.select(
        "source", "weight", "epochs", F.col("cost").alias("total"),
        F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_ROWS)).cast("int").alias("buckets"), F.greatest(F.lit(1.0), F.col("weight") * block_tokens).alias("share"),
    )
    table = F.broadcast(table) if count <= BROADCAST_SOURCES else table
    epochs = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.ceil("epochs") - 1).cast("int"))))
    near, full = _keys(F.col("epoch"))
    read = rows.join(table, "source").withColumn("epoch", epochs).withColumn("near", near).withColumn("full", full)
    read = materialize(read.withColumn("bucket", F.floor(F.col("near") * F.col("buckets") / F.lit(1 << 31)).cast("int")), "readings")
    group = ["source", "epoch"]
    sums = read.groupBy(*group, "bucket").agg(F.sum(_cost()).alias("t"))
    before = sums.select(*group, "bucket", (F.sum("t").over(Window.partitionBy(*group).orderBy("bucket")) - F.col("t")).alias("before"))
    inside = Window.partitionBy(*group, "bucket").orderBy("near", "full", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    # As many rows of sums as BUCKET_ROWS go into the readings, about.
    begin = F.col("epoch") * F.col("total") + F.col("before") + F.sum(_cost()).over(inside) - _cost()
    placed = read.join(before, [*group, "bucket"]).withColumn("begin", begin)
    placed = placed.where((F.col("epoch") + 1 <= F.col("epochs")) | (F.col("begin") < F.col("epochs") * F.col("total")))
    placed = placed.withColumn("block", F.floor(F.col("begin") / F.col("share")).cast("long"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("full", "doc_id", "epoch")) - 1
    return placed.select("doc_id", "source", F.col("epoch").cast("int").alias("epoch"), "n_tokens", "weight", "block", place.cast("long").alias("position"))


def mixed_documents(docs: DataFrame, target: float = ENTROPY, limit: float = REPEATS, budget: float | None = None) -> DataFrame:
    """``docs`` with each row as often as the mixture reads it, all columns kept.

    The readings of a source's last, incomplete epoch are those up to one place in its permutation, so texts need no
    join: the place is one row for each source.
    """
    placed = mix(docs, target, limit, budget)
    near, full = _keys(F.col("epoch"))
    key = F.struct(near.alias("a"), full.alias("b"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("c"), F.col("n_tokens").alias("d"))
    ends = placed.select("source", F.struct("epoch", key.alias("key")).alias("end")).groupBy("source").agg(F.max("end").alias("end"))
    ends = materialize(ends.select(F.col("source").alias("_source"), F.col("end.epoch").alias("_last"), F.col("end.key").alias("_end")), "ends")
    held = docs.select(F.struct("*").alias("_row"), _source(docs).alias("_source"), docs["doc_id"].alias("doc_id"), token_count(docs["text"]).alias("n_tokens"))
    ends = F.broadcast(ends) if ends.count() <= BROADCAST_SOURCES else ends
    read = held.join(ends, "_source").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    a, b = _keys(F.col("_epoch"))
    key = F.struct(a.alias("a"), b.alias("b"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("c"), F.col("n_tokens").alias("d"))
    return read.where((F.col("_epoch") < F.col("_last")) | (key <= F.col("_end"))).select("_row.*")
