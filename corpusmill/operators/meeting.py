"""Queries that meet groups of held rows inside tasks.

Held rows are dealt to groups of a bounded size, queries are copied to the groups that they must see, and both go to one
task by group, held rows first: a task has one group in memory at a time and reads its queries as they come. No pair of
a query and a held row is ever a row of a DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parts_of(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, parts): how many groups of about ``size`` rows each key needs."""
    return rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))


def dealt(rows: DataFrame, parts: DataFrame, keys: list[str], *by: str) -> DataFrame:
    """``rows`` with the ``part`` of their key that each belongs to, by a hash of ``by``."""
    return rows.join(parts, keys).withColumn("part", F.pmod(F.xxhash64(*by), F.col("parts")).cast("int")).drop("parts")


def copied(rows: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` once for each ``part`` of their key."""
    return rows.join(parts, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def meet(held: DataFrame, queries: DataFrame, keys: list[str], order: list[str | Column], kernel, schema: str, tasks: int = 0) -> DataFrame:
    """``kernel`` over the rows of both: by ``keys``, the held rows of each (sorted by ``order``) before its queries.

    Columns that one side lacks are null there, or empty lists (Spark hands null lists to Arrow many times more slowly);
    ``asks`` tells the sides apart. With ``tasks``, the last key is the number of the task, below it.
    """
    fields = {f.name: f.dataType for f in [*queries.schema, *held.schema]}
    lacking = lambda kind: (F.array() if isinstance(kind, T.ArrayType) else F.lit(None)).cast(kind)
    whole = lambda side: [F.col(c) if c in side.columns else lacking(kind).alias(c) for c, kind in fields.items()]
    both = held.select(*whole(held), F.lit(False).alias("asks")).unionByName(queries.select(*whole(queries), F.lit(True).alias("asks")))
    # A number keeps small inputs on many tasks: groups are few bytes and much work.
    n = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    there = both.repartitionById(tasks, F.col(keys[-1])) if tasks else both.repartition(n, *keys)
    return there.sortWithinPartitions(*keys, "asks", *order).mapInArrow(kernel, schema)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], block: int) -> Iterator[tuple[pa.Table, pa.Table]]:
    """(a group's held rows, at most ``block`` of its queries), block by block; groups without both are left out.

    A group's table is the same object for all of its blocks.
    """
    now, held, table = None, [], None
    for batch in batches:
        if not len(batch):
            continue
        own = batch.select([*keys, "asks"])
        turns = np.zeros(len(batch), bool)
        turns[0] = True
        for column in own.columns:
            turns[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        cuts = [*np.flatnonzero(turns).tolist(), len(batch)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            key = tuple(column[i].as_py() for column in own.columns[:-1])
            if key != now:
                now, held, table = key, [], None
            if not own.column(len(keys))[i].as_py():
                held.append(batch.slice(i, j - i))
                continue
            if held:
                table, held = pa.Table.from_batches(held).combine_chunks(), []
            if table is not None:
                for k in range(i, j, block):
                    yield table, pa.Table.from_batches([batch.slice(k, min(block, j - k))])


def matrix(column: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """A row for each list, filled up with zeros to the longest list or ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.asarray(column.offsets)
    flat, sizes = np.asarray(column.values)[ends[0] : ends[-1]], np.diff(ends)
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices with the width of the wider one."""
    width = max(a.shape[1], b.shape[1])
    return tuple(m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, summed from the first component to the last, whatever stands beside a row."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def firsts(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the ``keep`` best of each owner, best first: by score, ties by id."""
    order = np.lexsort((ids, -score, owner))
    own = owner[order]
    start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.empty(0, int)
    rank = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
    return order[rank < keep]
