"""Expressions for speech synthesis and audio levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled_amount(value: Column, factor: Column) -> Column:
    """A signed amount with a unit, as "+10%" or "-5Hz", times a factor, cut to a whole number."""
    number = F.regexp_extract(value, r"^([+-]?\d+)", 1).try_cast("int")
    unit = F.regexp_extract(value, r"^[+-]?\d+(.*)$", 1)
    scaled = (number * factor).cast("int")
    return F.when(number.isNull(), value).otherwise(F.concat(F.when(scaled >= 0, "+").otherwise("-"), F.abs(scaled).cast("string"), unit))


def energy(mean_volume: Column) -> Column:
    """Level of a recording by its mean volume in decibels."""
    return F.when(mean_volume > -18, "HIGH").when(mean_volume > -23, "MEDIUM").otherwise("LOW")


def emphasis(text: Column) -> Column:
    """Factor for a word in capitals and for more than one exclamation mark, at most 1.5."""
    caps = F.when(text.rlike(r"\b[A-Z]{3,}\b"), 0.2).otherwise(0.0)
    marks = F.when(F.regexp_count(text, F.lit("!")) > 1, 0.2).otherwise(0.0)
    return F.least(F.lit(1.5), 1.0 + caps + marks)
