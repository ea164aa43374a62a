"""Radix tries of terms with counters at their leaves, kept as what a walk in byte order meets.

Of each leaf a trie has the depth at which its path leaves the one of the leaf before it, and the bytes of its own edges
from there; so shared prefixes are stored once. Counters are parallel arrays of (leaf, source, occurrences, documents).
A walk gives leaves in the order of their UTF-8 bytes. Tries are cut at border terms and merged leaf by leaf.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

DDL = "lang string, first binary, leaves long, sources array<string>, depths binary, ends binary, edges binary, counters binary"
COLUMNS = ["lang", "first", "leaves", "sources", "depths", "ends", "edges", "counters"]
COUNTER = np.dtype([("leaf", "<i4"), ("source", "<i4"), ("n", "<i8"), ("docs", "<i8")])


def depth(a: bytes, b: bytes) -> int:
    """How many first bytes both share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def pack(lang: str, sources: list[str], terms: list[bytes], counters: np.ndarray) -> dict:
    """A row of ``DDL`` from distinct terms in byte order and counters sorted by leaf."""
    depths = [0, *(depth(a, b) for a, b in zip(terms, terms[1:], strict=False))] if terms else []
    edges = [t[d:] for t, d in zip(terms, depths, strict=True)]
    return {
        "lang": lang, "first": terms[0] if terms else b"", "leaves": len(terms), "sources": sources, "depths": np.array(depths, "<i4").tobytes(),
        "ends": np.cumsum([len(e) for e in edges], dtype="<i4").tobytes(), "edges": b"".join(edges), "counters": np.ascontiguousarray(counters, COUNTER).tobytes(),
    }


def walk(row: dict) -> Iterator[bytes]:
    """The terms of a row, in byte order."""
    path, at, edges = b"", 0, row["edges"]
    for d, end in zip(np.frombuffer(row["depths"], "<i4").tolist(), np.frombuffer(row["ends"], "<i4").tolist(), strict=True):
        path = path[:d] + edges[at:end]
        at = end
        yield path


def counters(row: dict) -> np.ndarray:
    return np.frombuffer(row["counters"], COUNTER)


def cut(row: dict, borders: list[bytes]) -> Iterator[tuple[int, dict]]:
    """(range, trie) of the parts of a row between borders; range k holds the terms from border k - 1 on and under border k."""
    terms, found = list(walk(row)), counters(row)
    ends = [bisect_left(terms, b) for b in borders] + [len(terms)]
    at = 0
    for k, end in enumerate(ends):
        if end > at:
            own = found[np.searchsorted(found["leaf"], at) : np.searchsorted(found["leaf"], end)].copy()
            own["leaf"] -= at
            yield k, pack(row["lang"], row["sources"], terms[at:end], own)
            at = end


class Merge:
    """The union of tries of one lang, leaf by leaf; what it holds follows the union, not the tries that were added."""

    def __init__(self) -> None:
        self.leaf: dict[bytes, int] = {}
        self.source: dict[str, int] = {}
        self.held, self.loose, self.n = np.empty(0, COUNTER), [], 0

    def add(self, row: dict) -> None:
        leaves = np.array([self.leaf.setdefault(t, len(self.leaf)) for t in walk(row)], np.int32)
        sources = np.array([self.source.setdefault(s, len(self.source)) for s in row["sources"]], np.int32)
        found = counters(row).copy()
        found["leaf"], found["source"] = leaves[found["leaf"]], sources[found["source"]]
        self.loose.append(found)
        self.n += len(found)
        if self.n > max(1 << 18, len(self.held)):
            self.settle()

    def settle(self) -> None:
        self.held = summed(np.concatenate([self.held, *self.loose]))
        self.loose, self.n = [], 0

    def tries(self, lang: str, least_docs: int, size: int) -> Iterator[dict]:
        """Rows of at most ``size`` leaves, in byte order, of the terms in at least ``least_docs`` documents."""
        self.settle()
        docs = np.bincount(self.held["leaf"], self.held["docs"].astype(float), len(self.leaf))
        kept = [t for t in sorted(self.leaf) if docs[self.leaf[t]] >= least_docs]
        place = np.full(len(self.leaf), -1, np.int32)
        place[[self.leaf[t] for t in kept]] = np.arange(len(kept))
        found = self.held[place[self.held["leaf"]] >= 0]
        found["leaf"] = place[found["leaf"]]
        found = found[np.lexsort((found["source"], found["leaf"]))]
        for at in range(0, len(kept), size):
            own = found[np.searchsorted(found["leaf"], at) : np.searchsorted(found["leaf"], at + size)].copy()
            own["leaf"] -= at
            yield pack(lang, list(self.source), kept[at : at + size], own)


def summed(found: np.ndarray) -> np.ndarray:
    """Counters with one entry for each leaf and source, sorted by both."""
    if not len(found):
        return found
    found = found[np.lexsort((found["source"], found["leaf"]))]
    starts = np.flatnonzero(np.concatenate(([True], (found["leaf"][1:] != found["leaf"][:-1]) | (found["source"][1:] != found["source"][:-1]))))
    out = found[starts].copy()
    for c in ("n", "docs"):
        out[c] = np.add.reduceat(found[c], starts)
    return out


def batch_of(rows: list[dict], more: dict[str, pa.Array] | None = None) -> pa.RecordBatch:
    """Rows of ``DDL`` as an Arrow batch, with further columns behind."""
    kinds = [pa.string(), pa.binary(), pa.int64(), pa.list_(pa.string()), *[pa.binary()] * 4]
    arrays = [pa.array([r[c] for r in rows], k) for c, k in zip(COLUMNS, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, *(more or {}).values()], [*COLUMNS, *(more or {})])


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one after the other."""
    for k in range(len(batch)):
        yield {c: batch.column(j)[k].as_py() for j, c in enumerate(batch.schema.names)}
