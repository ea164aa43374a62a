"""Toxicity by a factorization machine over hashed terms.

Terms (runs of letters, digits and non-ASCII bytes, lower case, and their beginnings of four to seven bytes, so that
inflected forms share numbers) are hashed to 2 ** 24 numbers. The machine has a bias, a weight for each number and a
vector for each number; the dot products of the vectors of two present numbers are the weight of their meeting. It is
fitted on a bounded sample of labelled rows in one task, in two steps:

1. Weights of all numbers that occur in ``MIN_DOCS`` sampled rows or more, together, by proximal gradient steps with an
   absolute penalty of ``PENALTY`` standard deviations of each number's gradient under chance.
2. Bias, weights and vectors of the numbers with a weight and of those that meet another one where the first step's
   residuals stay one-sided (by ``PAIR_Z``; meetings are tested where ``MEETINGS`` rows would hold both by chance), by
   full-batch Adam with early stopping. All other weights and vectors are zero.

The model stays small and is handed to every task. Scoring reads whole texts where they lie; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

TRAIN_ROWS = 16_384  # the bound of the sample of labelled rows
SPACE_BITS, FACTORS, MIN_DOCS, PENALTY = 24, 8, 2, 3.0
BEGINNINGS = (4, 5, 6, 7)  # bytes of a term that count as terms of their own
PAIR_Z, MEETINGS = 6.0, 8
ROUNDS, STEPS = 12, 20  # full gradients, and steps between two of them, of the penalized weights
EPOCHS, RATE, DECAY, SEED = 400, 0.05, 2e-4, 5

_BREAK = np.ones(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _BREAK[_low:_high] = False


def term_numbers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed terms and beginnings, document numbers) of all terms."""
    lower = K.LOWER[data]
    start, end, doc = K.words(lower, offsets, _BREAK)
    h = K.prefix_hash(lower)
    turn = K.powers(K.inverse(), len(lower) + 1)[start]
    found, owner = [K.mix((h[end] - h[start]) * turn)], [doc]
    for k in BEGINNINGS:
        longer = end - start > k
        found.append(K.mix((h[start[longer] + k] - h[start[longer]]) * turn[longer] + K.U64(k * 0x9E3779B97F4A7C15 % (1 << 64))))
        owner.append(doc[longer])
    return (np.concatenate(found) >> K.U64(64 - SPACE_BITS)).astype(np.int64), np.concatenate(owner)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, distinct numbers) of each text."""
    for batch in batches:
        for i, j, data, offsets in K.text_slices(batch.column(0)):
            number, doc = term_numbers(data, offsets)
            pair = np.unique(doc << SPACE_BITS | number)
            ends = np.searchsorted(pair, np.arange(j - i + 1) << SPACE_BITS).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array((pair & (1 << SPACE_BITS) - 1).astype(np.int32)))], ["label", "terms"]
            )


def forward(index: np.ndarray, doc: np.ndarray, n: int, bias: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(logits, sums of vectors) of ``n`` documents that hold parameters ``index``, grouped by ``doc``."""
    linear = np.bincount(doc, w[index], minlength=n)
    total = np.stack([np.bincount(doc, v[index, f], minlength=n) for f in range(v.shape[1])], axis=1)
    square = np.bincount(doc, (v**2).sum(axis=1)[index], minlength=n)
    return bias + linear + 0.5 * ((total**2).sum(axis=1) - square), total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def in_meetings(residual: np.ndarray, doc: np.ndarray, index: np.ndarray, df: np.ndarray, rows: int = 4096, columns: int = 1024) -> np.ndarray:
    """Which terms have residuals that are one-sided in meetings with another one, more than both alone explain.

    That is the mean product of residual and both terms, each standardized. Pairs are counted for blocks of rows and terms.
    """
    n, out = len(residual), np.zeros(len(df), bool)
    common = np.flatnonzero((df >= np.sqrt(MEETINGS * n)) & (df < n))
    place = np.full(len(df), -1)
    place[common] = np.arange(len(common))
    held = place[index] >= 0
    at, doc = place[index[held]], doc[held]  # grouped by document
    share = (df[common] / n).astype(np.float32)
    scale = np.sqrt(share * (1 - share))
    label = ((residual - residual.mean()) / (residual.std() * np.sqrt(n) + 1e-12)).astype(np.float32)[:, None]
    for c in range(0, len(common), columns):
        z = np.zeros((len(common[c : c + columns]), len(common)), np.float32)
        for r in range(0, n, rows):
            s, e = np.searchsorted(doc, (r, min(n, r + rows)))
            x = np.zeros((min(n, r + rows) - r, len(common)), np.float32)
            x[doc[s:e] - r, at[s:e]] = 1
            x = (x - share) / scale
            z += (x[:, c : c + columns] * label[r : r + rows]).T @ x
        z[np.arange(len(z)), c + np.arange(len(z))] = 0
        out[common[(np.abs(z) >= PAIR_Z).any(axis=0)]] = True
    return out


def penalized(y: np.ndarray, doc: np.ndarray, index: np.ndarray, df: np.ndarray, bias: float) -> tuple[float, np.ndarray]:
    """Bias and weights with an absolute penalty; weights whose gradient at zero stays under it are zero.

    A full gradient says which weights may leave zero; steps for these alone follow, until the next full gradient.
    """
    n, w = len(y), np.zeros(len(df))
    mean = y.mean()
    fine, curve = PENALTY * np.sqrt(df * mean * (1 - mean)) / n, 0.25 * df / n
    slow = 4.0  # by so much steps are shorter than for a weight alone
    for _ in range(ROUNDS):
        g = (_sigmoid(bias + np.bincount(doc, w[index], minlength=n)) - y) / n
        active = (w != 0) | (np.abs(np.bincount(index, g[doc], minlength=len(df))) > fine)
        place = np.cumsum(active) - 1
        held = active[index]
        at, owner = place[index[held]], doc[held]
        u, f, c = w[active], fine[active], curve[active]
        last, before = np.inf, (bias, u)
        for _ in range(STEPS):
            p = _sigmoid(bias + np.bincount(owner, u[at], minlength=n))
            loss = -np.mean(np.log(np.clip(np.where(y > 0, p, 1 - p), 1e-12, 1))) + (f * np.abs(u)).sum()
            if loss > last:
                slow, last, (bias, u) = slow * 2, np.inf, before
                continue
            last, before = loss, (bias, u)
            g = (p - y) / n
            u = u - np.bincount(at, g[owner], minlength=len(u)) / (c * slow)
            u = np.sign(u) * np.maximum(np.abs(u) - f / (c * slow), 0)
            bias -= 2 * float(g.sum()) / slow
        w[active] = u
    return bias, w


def fit(labels: np.ndarray, rows: list[np.ndarray]) -> dict[str, np.ndarray]:
    """The machine for labels 0/1 and the distinct term numbers of each row; without both labels only a bias."""
    n, y = len(labels), labels.astype(float)
    rate = (y.sum() + 1) / (n + 2)
    bias = float(np.log(rate / (1 - rate)))
    empty = {"terms": np.empty(0, np.int64), "w": np.empty(0), "v": np.empty((0, FACTORS)), "bias": np.array([bias])}
    if not 0 < y.sum() < n:
        return empty
    doc = np.repeat(np.arange(n), [len(r) for r in rows])
    terms, index, df = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    often = df >= MIN_DOCS
    held = often[index]
    index, doc, terms, df = (np.cumsum(often) - 1)[index[held]], doc[held], terms[often].astype(np.int64), df[often]
    check = np.arange(n) % 10 == 0
    inner = ~check[doc]
    inner_df = np.bincount(index[inner], minlength=len(df))
    some = np.flatnonzero(~check)
    bias, start = penalized(y[some], np.searchsorted(some, doc[inner]), index[inner], np.maximum(inner_df, 1), bias)
    residual = y - _sigmoid(bias + np.bincount(doc, start[index], minlength=n))
    used = (start != 0) | in_meetings(np.where(check, 0.0, residual), doc, index, df)
    if not used.any():
        return empty | {"bias": np.array([bias])}
    held = used[index]
    index, doc, terms = (np.cumsum(used) - 1)[index[held]], doc[held], terms[used]
    rng = np.random.default_rng(SEED)
    params = [np.array([bias]), start[used], rng.normal(0, 0.05, (len(terms), FACTORS))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    weight = np.where(check, 0.0, 1.0) / (~check).sum()
    best, kept, waited = np.inf, [p.copy() for p in params], 0
    for step in range(1, EPOCHS + 1):
        logit, total = forward(index, doc, n, params[0][0], params[1], params[2])
        p = _sigmoid(logit)
        loss = -np.mean(np.log(np.clip(np.where(y > 0, p, 1 - p), 1e-9, 1))[check])
        if loss < best - 1e-5:
            best, kept, waited = loss, [q.copy() for q in params], 0
        elif (waited := waited + 1) >= 40:
            break
        g = (p - y) * weight
        at = g[doc]
        mass = np.bincount(index, at, minlength=len(terms))
        grad_v = np.stack([np.bincount(index, at * total[doc, f], minlength=len(terms)) for f in range(FACTORS)], axis=1) - mass[:, None] * params[2]
        for k, grad in enumerate((np.array([g.sum()]), mass + DECAY * params[1], grad_v + DECAY * params[2])):
            m, s = moments[k]
            m += 0.1 * (grad - m)
            s += 0.001 * (grad**2 - s)
            params[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return {"terms": terms, "w": kept[1], "v": kept[2], "bias": kept[0]}


def _train(pdf):
    import pandas as pd

    pdf = pdf.sort_values("doc_id", kind="stable")
    model = fit(pdf["label"].to_numpy(), list(pdf["terms"]))
    return pd.DataFrame({k: [np.ascontiguousarray(v).tobytes()] for k, v in model.items()})


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Fit on at most ``most`` labelled rows whose crc32(doc_id) mod 5 is not 0, chosen by hash of doc_id.

    Repeated labels of a document count as toxic if one of them does; null labels and ids are left out; of several
    texts under one doc_id the one with the least digest counts. Null and empty texts have no terms; very long ones
    count whole. Without usable labels, or with one label only, the machine is a bias. Other columns are ignored.
    """
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    chosen = usable.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``most`` doc_ids
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text"))
    named = rows.select("text", F.struct("doc_id", "label").alias("label")).mapInArrow(_features, "label struct<doc_id:long,label:int>, terms array<int>")
    found = named.select("label.doc_id", "label.label", "terms", F.lit(0).alias("all")).groupBy("all").applyInPandas(_train, "terms binary, w binary, v binary, bias binary").first()
    if found is None:
        return fit(np.empty(0, int), [])
    raw = found.asDict()
    return {
        "terms": np.frombuffer(raw["terms"], np.int64),
        "w": np.frombuffer(raw["w"]),
        "v": np.frombuffer(raw["v"]).reshape(-1, FACTORS),
        "bias": np.frombuffer(raw["bias"]),
    }


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def scores(data: np.ndarray, offsets: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    n = len(offsets) - 1
    number, doc = term_numbers(data, offsets)
    terms = model["terms"]
    if len(terms):
        at = np.minimum(np.searchsorted(terms, number), len(terms) - 1)
        hit = terms[at] == number
        pair = np.unique(doc[hit] * len(terms) + at[hit])
        doc, index = pair // len(terms), pair % len(terms)
    else:
        doc = index = np.empty(0, np.int64)
    return _sigmoid(forward(index, doc, n, float(model["bias"][0]), model["w"], model["v"])[0])


def _scored(model: dict[str, np.ndarray]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in K.text_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(scores(data, offsets, model))], ["doc_id", "score"])

    return rows


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``; null and empty texts get the bias alone.

    Repeated rows are scored each on its own; a null doc_id has a null ``held_out``; other columns are ignored.
    """
    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scored(model), "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
