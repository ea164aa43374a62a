"""Near-duplicate groups: MinHash bands, sequential Bayesian pruning, exact verification, components.

1. Each text becomes a set of word shingles, 128 minima and a digest of the set; texts of equal sets form one class,
   which its smallest doc_id stands for, so exact copies never meet each other.
2. Signatures are cut into 32 bands of four minima: two sets of similarity 0.75 share a band with probability
   1 - (1 - 0.75 ** 4) ** 32, all but five in a million.
3. In each bucket every class is compared with the smallest one, then with the one of most links: stars, whose size
   is that of the bucket.
4. Buckets in which more than one component is left are compared block by block inside tasks; pairs of one component
   are not looked at, and a task hands on only links that join components, so its rows never outnumber its classes.
5. A comparison reads the minima in batches and stops as soon as the posterior probability of reaching the threshold
   falls under ``miss``; what is left is verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import ids_tell_rows, materialize
from .components import components

N_HASHES, BANDS, ROWS, BATCH = 128, 32, 4, 16
THRESHOLD, MISS = 75, 1e-7  # per cent; posterior probability under which a pair is given up
BLOCK = 512
BROADCAST_IDS = 1_000_000  # ids, eight bytes each, that are sent to every task at most; beyond that the texts are shuffled


def least_matches(threshold: float = THRESHOLD / 100, miss: float = MISS) -> list[tuple[int, int]]:
    """(minima read, matches under which the posterior of similarity >= threshold, from a flat prior, is under miss)."""

    def tail(m: int, n: int) -> float:  # P(s >= t | m of n matched) = P(Binomial(n + 1, t) <= m)
        return sum(comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))

    return [(n, next(m for m in range(n + 2) if m > n or tail(m, n) >= miss)) for n in range(BATCH, N_HASHES + 1, BATCH)]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in K.text_slices(batch.column(1)):
            sets, counts = K.shingle_sets(data, offsets)
            high, low = K.set_digests(sets, counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(counts.astype(np.int64)), pa.array(high), pa.array(low), K.binary_rows(K.min_hashes(sets, counts, N_HASHES), counts > 0)],
                ["doc_id", "n_shingles", "high", "low", "signature"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in K.text_slices(batch.column(1)):
            sets, counts = K.shingle_sets(data, offsets)
            ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(sets.view(np.int64)))], ["id", "shingles"]
            )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, N_HASHES)


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both signatures, those that no batch of minima rules out."""
    rule = least_matches()
    for batch in batches:
        if not len(batch):
            continue
        same = _matrix(batch.column(2)) == _matrix(batch.column(3))
        left = np.arange(len(batch))
        for n, least in rule:
            left = left[same[left, :n].sum(axis=1) >= least]
        yield batch.select([0, 1]).take(pa.array(left))


def _block_links(pdf_left, pdf_right):
    """Links between two blocks of one bucket that join components, verified on the full sets."""
    import pandas as pd

    out: list[tuple[int, int]] = []
    if len(pdf_left) and len(pdf_right):
        rule, ratio = least_matches(), THRESHOLD / 100
        pdf_right = pdf_right.set_axis(pdf_left.columns, axis=1)
        (x, a, la, sa), (y, b, lb, sb) = (
            (
                np.frombuffer(b"".join(p["signature"]), np.uint32).reshape(-1, N_HASHES),
                p["class_id"].to_numpy(),
                p["label"].to_numpy(),
                [np.asarray(s, np.int64) for s in p["shingles"]],
            )
            for p in (pdf_left, pdf_right)
        )
        root = {k: k for k in {*la.tolist(), *lb.tolist()}}

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        size = np.array([len(s) for s in sb])
        for i in range(len(x)):
            left = np.flatnonzero((lb != la[i]) & (np.minimum(size, len(sa[i])) >= ratio * np.maximum(size, len(sa[i]))))
            for n, least in rule:
                left = left[(y[left, :n] == x[i, :n]).sum(axis=1) >= least]
            for j in left.tolist():
                p, q = find(int(la[i])), find(int(lb[j]))
                if p != q:
                    shared = len(np.intersect1d(sa[i], sb[j], assume_unique=True))
                    if 100 * shared >= THRESHOLD * (len(sa[i]) + len(sb[j]) - shared):
                        root[p] = q
                        out.append((int(a[i]), int(b[j])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _prune(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that neither the sizes of the sets nor the signatures rule out."""
    one = lambda x: classes.select(F.col("class_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").where(100 * F.least("na", "nb") >= THRESHOLD * F.greatest("na", "nb"))
    return both.select("a", "b", "sa", "sb").mapInArrow(_survivors, "a long, b long")


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the documents of ``ids``, computed where the texts lie as long as the ids are few."""
    ids = materialize(ids.distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("id"), "left_semi")
    return materialize(texts.mapInArrow(_sets, "id long, shingles array<long>").dropDuplicates(["id"]), "sets")


def _verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    pairs = materialize(pairs, "survivors")
    sets = _sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    side = lambda name, s: sets.select(F.col("id").alias(name), F.col("shingles").alias(s))
    both = pairs.join(side("a", "sa"), "a").join(side("b", "sb"), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("n"))
    return materialize(shared.where(100 * F.col("i") >= THRESHOLD * (F.col("n") - F.col("i"))).select("a", "b"), "links")


def _stars(bands: DataFrame, pivots: DataFrame) -> DataFrame:
    """Distinct pairs of each bucket's pivot with its other classes."""
    pairs = bands.join(pivots, "key").where("class_id <> pivot")
    return pairs.select(F.least("pivot", "class_id").alias("a"), F.greatest("pivot", "class_id").alias("b")).distinct()


def _left_over(bands: DataFrame, classes: DataFrame, labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Links that join components, from buckets that hold three or more classes of more than one component."""
    named = bands.join(labels, F.col("class_id") == F.col("node"), "left").select("key", "class_id", F.coalesce("component", "class_id").alias("label"))
    mixed = named.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min("label").alias("l"), F.max("label").alias("h"), F.bit_xor(F.xxhash64("class_id")).alias("x"), F.bit_xor(F.xxhash64("class_id", F.lit(1))).alias("y")
    )
    # Buckets of the same classes, as near copies share many, are looked at once.
    mixed = mixed.where("size > 2 AND l <> h").groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", "size")
    member = materialize(named.join(materialize(mixed, "keys"), "key"), "mixed")
    share = materialize(member.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")), "shares")
    # A component with many members has blocks of its own; two of its blocks are never compared.
    own = F.col("n") >= BLOCK // 2
    parts = lambda c: F.greatest(F.lit(1), F.ceil(c / BLOCK)).cast("int")
    block = F.when(own, F.struct(F.col("label").alias("owner"), F.pmod(F.xxhash64("class_id"), parts(F.col("n"))).cast("long").alias("part"))).otherwise(
        F.struct(F.lit(None).cast("long").alias("owner"), F.pmod(F.xxhash64("label"), parts(F.col("size"))).cast("long").alias("part"))
    )
    placed = materialize(member.join(share, ["key", "label"]).select("key", "class_id", "label", block.alias("block")), "blocks")
    blocks = placed.select("key", "block").distinct()
    other = blocks.select("key", F.col("block").alias("other"))
    tasks = blocks.join(other, "key").where("block <= other AND (block.owner IS NULL OR other.owner IS NULL OR block.owner <> other.owner)")
    tasks = materialize(tasks.withColumn("task", F.xxhash64("key", F.col("block").cast("string"), F.col("other").cast("string"))), "tasks")
    sets = _sets_of(docs, placed.select(F.col("class_id").alias("id"))).withColumnRenamed("id", "class_id")
    fields = ("task", "class_id", "label", "signature", "shingles")
    full = materialize(classes.select("class_id", "signature").join(sets, "class_id"), "full")
    left = placed.join(tasks.select("key", "block", "task"), ["key", "block"]).join(full, "class_id").select(*fields)
    right = placed.join(tasks.select("key", F.col("other").alias("block"), "task"), ["key", "block"]).join(full, "class_id")
    right = right.select(*(F.col(c).alias(f"other_{c}") for c in fields))
    return left.groupBy("task").cogroup(right.groupBy("other_task")).applyInPandas(_block_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Null and empty texts have no shingles and are linked with nothing; a text of one to four words is one shingle; a
    very long text has all its shingles. Sets hold 64-bit hashes of shingles, so links are exact up to equal hashes.
    Rows that repeat a doc_id get the same answer each; a null doc_id gets the component of its equal texts, or null.
    Other columns are ignored.
    """
    rows = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_signatures, "doc_id long, n_shingles long, high long, low long, signature binary"), "signatures")
    key = ["n_shingles", "high", "low"]
    some = rows.where("n_shingles > 0")
    classes = materialize(some.groupBy(*key).agg(F.min("doc_id").alias("class_id"), F.max("signature").alias("signature")), "classes")
    band = F.explode(F.array(*(F.xxhash64(F.lit(k), F.substring("signature", 1 + 16 * k, 16)) for k in range(BANDS))))
    bands = classes.where("class_id IS NOT NULL").select("class_id", band.alias("key"))
    first = materialize(bands.groupBy("key").agg(F.min("class_id").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "pivot"), "buckets")
    bands = materialize(bands.join(first.select("key"), "key", "left_semi"), "bands")
    star = materialize(_stars(bands, first), "star")
    links = _verify(_prune(star, classes), docs)
    degree = materialize(links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    second = bands.join(degree, "class_id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("class_id")).alias("c"))).alias("most")).select("key", (-F.col("most.c")).alias("pivot"))
    again = _stars(bands, materialize(second, "pivots")).join(star, ["a", "b"], "left_anti")
    links = links.unionByName(_verify(_prune(again, classes), docs))
    labels = components(links)
    more = materialize(_left_over(bands, classes, labels, docs), "left_over")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    named = materialize(
        classes.select(*key, "class_id").join(labels, F.col("class_id") == F.col("node"), "left").select(*key, F.coalesce("component", "class_id").alias("found")), "named"
    )
    out = rows.select("doc_id", *key).join(named, key, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("found"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, of the smallest doc_id of each group; null comes last.

    Where doc_ids are null or repeated, doc_id and text together are the id: one doc_id with two texts is two documents,
    and rows that repeat both are kept or dropped together.
    """
    if ids_tell_rows(docs):
        kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
        return docs.join(kept, docs["doc_id"] == kept["_kept_id"], "left_semi")
    text = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    keys = docs.select(F.col("doc_id").alias("_id"), text.alias("_text")).distinct().orderBy(F.col("_id").asc_nulls_last(), "_text")
    keys = materialize(keys.withColumn("_number", F.monotonically_increasing_id()), "numbers")  # in the order of the keys
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (text == F.col("_text"))
    numbered = docs.select("doc_id", "text").join(keys, same).select(F.col("_number").alias("doc_id"), "text")
    kept = near_duplicates(numbered).where("kept").select(F.col("doc_id").alias("_number")).distinct()
    return docs.join(keys.join(kept, "_number", "left_semi"), same, "left_semi")
