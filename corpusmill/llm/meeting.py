"""Vectors that take part in searches, and how queries meet groups of them (``operators.meeting``)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import meeting as core
from ..operators.meeting import firsts, in_order, matrix, widened

__all__ = ["BUCKET", "NONE", "firsts", "groups", "in_order", "matrix", "meet", "usable", "widened"]

QUERY_BLOCK, BUCKET = 128, 1024  # queries and candidates that are multiplied at once
NONE = np.iinfo(np.int64).min


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector array<double>) of the rows that take part.

    Rows with a null vec_id or vector, or with a null or non-finite component, are left out. Rows that share a vec_id
    count once, as the one with the least label and vector (nulls first).
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("embedding").cast("array<double>").alias("vector"))
    found = found.where("vec_id IS NOT NULL AND vector IS NOT NULL").where(finite)
    return found.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.*")


def meet(candidates: DataFrame, queries: DataFrame, order: list, kernel, schema: str) -> DataFrame:
    return core.meet(candidates, queries, ["grp"], order, kernel, schema)


def groups(batches):
    return core.groups(batches, ["grp"], QUERY_BLOCK)
