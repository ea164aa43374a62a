"""Vector and score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FUSE_RERANK, FUSE_RETRIEVAL


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def sigmoid(logit: Column, temperature: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-logit / temperature))


def fused(retrieval: Column, rerank: Column) -> Column:
    return FUSE_RETRIEVAL * retrieval + FUSE_RERANK * rerank


def alpha(value: Column) -> Column:
    """A weight between 0 and 1; what is no number counts as one half."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(0.5))))
