"""Models inside tasks: loaded once by each Python worker, fed by batches of Arrow columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import QUERY_PREFIX

BATCH = 256  # texts that a model sees at once

Load = Callable[[], Callable[..., np.ndarray]]  # run once in each worker; gives the function over arrays of texts


def embedder(load: Load, batch: int = BATCH) -> Callable[..., DataFrame]:
    """An embedder to be used in place of ``embed.embedded``: ``load()`` gives a function from texts to a matrix.

    Questions get the fixed prefix; null texts count as empty ones.
    """
    predict = predict_batch_udf(load, return_type=T.ArrayType(T.FloatType()), batch_size=batch)

    def embed(rows: DataFrame, column: str, out: str = "embedding", is_query: bool = False) -> DataFrame:
        text = F.coalesce(F.col(column), F.lit(""))
        return rows.withColumn(out, predict(F.concat(F.lit(QUERY_PREFIX), text) if is_query else text))

    return embed


def scorer(load: Load, batch: int = BATCH) -> Callable[[DataFrame, str, str], DataFrame]:
    """A reranker to be used in place of ``retrieval.lexical_score``: ``load()`` gives a function from two arrays of texts to scores."""
    predict = predict_batch_udf(load, return_type=T.DoubleType(), batch_size=batch)

    def score(pairs: DataFrame, a: str, b: str) -> DataFrame:
        return pairs.withColumn("rerank_score", predict(F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))))

    return score
