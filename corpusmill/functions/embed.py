"""Text vectors: pooling of token vectors, and a deterministic embedder that hashes terms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EMBED_DIM, EMBED_TERMS, QUERY_PREFIX
from .text import words
from .vectors import norm

SLICE = 512  # texts of a batch that are embedded at once


def l2_normalized(vector: Column) -> Column:
    """A vector of length 1; one without length stays as it is."""
    length = norm(vector)
    return F.when(length > 0, F.transform(vector, lambda x: x / length)).otherwise(vector)


def mean_pooled(vectors: Column, mask: Column) -> Column:
    """The mean of the token vectors whose mask is 1; null where none is."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])
    first = F.transform(F.get(kept, F.lit(0)), lambda x: x.cast("double"))
    total = F.aggregate(F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0))), first, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))


def embedded(rows: DataFrame, column: str, out: str = "embedding", dim: int = EMBED_DIM, is_query: bool = False, most: int = EMBED_TERMS) -> DataFrame:
    """``rows`` with a vector of length 1 of each text's first ``most`` words, or zeros where it has none.

    Each word adds 1 or -1 at a place of the vector, both by the first 32 bits of its MD5; a question's text follows the fixed prefix.
    A stand-in for a model: the same words give the same vector in every process. Of a batch, ``SLICE`` texts are worked on
    at once, which bounds a worker's memory besides the batch itself.
    """
    text = F.concat(F.lit(QUERY_PREFIX), F.coalesce(F.col(column), F.lit(""))) if is_query else F.col(column)
    held = rows.select(F.slice(words(text), 1, most).alias("_words"), *rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, len(b), SLICE)):
            lists = batch.column(0)
            codes = lists.flatten().dictionary_encode()
            hashes = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in codes.dictionary.to_pylist()], np.int64)
            place = hashes[codes.indices.to_numpy()] if len(codes) else np.empty(0, np.int64)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            sums = np.bincount(row * dim + place % dim, np.where(place >> 31 & 1, -1.0, 1.0), minlength=len(lists) * dim).astype(float).reshape(-1, dim)
            length = np.sqrt((sums**2).sum(axis=1, keepdims=True))
            sums = np.divide(sums, length, out=np.zeros_like(sums), where=length > 0)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * dim), pa.array(sums.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], vectors], [*batch.schema.names[1:], out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return held.mapInArrow(run, f"{fields}, `{out}` array<float>")
