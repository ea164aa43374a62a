"""Grids of cells as text, with inferred headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _is_number(cell: Column) -> Column:
    return F.regexp_replace(F.coalesce(cell, F.lit("")), r"[,%$\s]", "").rlike(r"^-?\d+(\.\d+)?$")


def header_score(grid: Column) -> Column:
    """2 for a first row without numbers over a second with more than half, 1 for a first row clearly shorter than the second."""
    first, second = F.get(grid, F.lit(0)), F.get(grid, F.lit(1))
    numbers = lambda row: F.size(F.filter(row, _is_number))
    length = lambda row: F.aggregate(row, F.lit(0.0), lambda a, c: a + F.length(F.coalesce(c, F.lit("")))) / F.size(row)
    typed = F.when((numbers(first) == 0) & (numbers(second) > F.size(second) / 2), 2).otherwise(0)
    short = F.when(length(first) < 0.8 * length(second), 1).otherwise(0)
    return F.when((F.size(grid) >= 2) & (F.size(first) > 0) & (F.size(second) > 0), typed + short).otherwise(0)


def grid_text(grid: Column) -> Column:
    """Rows as lines: cells between bars where a header was inferred, else two spaces apart."""
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    line = lambda mark: F.array_join(F.transform(grid, lambda row: F.array_join(F.transform(row, clean), mark)), "\n")
    return F.when(header_score(grid) >= 2, line(" | ")).otherwise(line("  "))
