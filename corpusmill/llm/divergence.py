"""Divergence of a lang's sources, by term counts in mergeable radix tries.

1. Each task counts the terms of its texts (``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased) into tries with a
   counter for each source at each leaf, and hands them on in pieces.
2. Border terms are quantiles of sampled terms; pieces are cut there, and each prefix range of a lang is merged by one
   task, which knows in how many documents a term occurs and keeps those in ``LEAST_DOCS`` or more.
3. With the totals of all groups, each task walks its merged ranges in UTF-8 order, adds up what every two sources
   differ by and keeps the best terms of each group; sums and candidates meet in Spark.

All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import tries
from .common import materialize

LEAST_DOCS, TERMS = 10, 10
SCALE = 1_000_000_000
SALTS = 16


class Limits(NamedTuple):
    """How much a task holds or hands on at a time; results don't depend on it."""

    piece: int = 4_096  # leaves of a trie that a task hands on
    head: int = 256  # leaves between two that may become borders
    range_leaves: int = 65_536  # leaves before merging for one range
    sampled: int = 8_192  # the bound of the sampled border terms
    terms: int = 400_000  # terms, their bytes and counters before a task hands on what it holds
    bytes: int = 1 << 26
    counters: int = 1 << 21
    tile: int = 256  # sources whose sums a task holds at a time
    cells: int = 1 << 20  # entries of a matrix of terms by sources


LIMITS = Limits()

_BREAK = np.ones(256, bool)
for _low, _high in ((0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _BREAK[_low:_high] = False


def counted(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, n_groups: int) -> tuple[np.ndarray, ...]:
    """(term hash, group, occurrences, documents) by hash and group; and the first place of each hash: (hash, start, end)."""
    lower = K.LOWER[data]
    start, end, doc = K.words(lower, offsets, _BREAK)
    if not len(start):
        return (np.empty((4, 0), np.int64), np.empty((3, 0), np.int64))
    h = K.word_hashes(lower, start, end)
    order = np.argsort(h, kind="stable")  # documents stay in order under each hash
    h, d = h[order], doc[order]
    new_hash = np.concatenate(([True], h[1:] != h[:-1]))
    new_pair = new_hash | np.concatenate(([True], d[1:] != d[:-1]))
    pair = np.flatnonzero(new_pair)
    tf = np.diff(np.append(pair, len(h)))
    number = np.cumsum(new_hash)[pair] - 1
    key = number * n_groups + group[d[pair]]
    turn = np.argsort(key, kind="stable")
    key = key[turn]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    first = np.flatnonzero(new_hash)
    distinct = h[first]
    by_group = (distinct[key[at] // n_groups].view(np.int64), key[at] % n_groups, np.add.reduceat(tf[turn], at), np.diff(np.append(at, len(key))))
    return by_group, (distinct.view(np.int64), start[order[first]], end[order[first]])


class _Held:
    """The terms and counters of a task since it last handed on a trie."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits
        self.group: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self) -> None:
        self.term: dict[int, bytes] = {}
        self.bytes, self.found, self.n = 0, [], 0

    def add(self, data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> None:
        found, (hashes, start, end) = counted(data, offsets, group, len(self.group))
        lower = K.LOWER[data].tobytes()
        for h, s, e in zip(hashes.tolist(), start.tolist(), end.tolist(), strict=True):
            if h not in self.term:
                self.term[h] = lower[s:e]
                self.bytes += e - s
        self.found.append(found)
        self.n += len(found[0])

    def full(self) -> bool:
        if self.n > 2 * self.limits.counters or len(self.found) > 64:
            self.settle()
        return len(self.term) > self.limits.terms or self.bytes > self.limits.bytes or self.n > self.limits.counters

    def settle(self) -> None:
        h, g, n, d = (np.concatenate(v) for v in zip(*self.found, strict=True))
        order = np.lexsort((g, h))
        h, g, n, d = h[order], g[order], n[order], d[order]
        at = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))) if len(h) else np.empty(0, int)
        sums = (np.add.reduceat(v, at) if len(at) else v for v in (n, d))
        self.found, self.n = [(h[at], g[at], *sums)], len(at)

    def pieces(self) -> Iterator[dict]:
        """Tries of one lang each, in byte order."""
        if not self.found:
            return
        self.settle()
        h, g, n, d = self.found[0]
        terms = sorted(self.term.items(), key=lambda x: x[1])
        hashes = np.array([x[0] for x in terms], np.int64)
        by_hash = np.argsort(hashes)
        place = by_hash[np.searchsorted(hashes[by_hash], h)]
        sources_of: dict[str, list[str]] = {}
        number = np.empty(len(self.group), np.int64)
        for k, (lang, source) in enumerate(self.group):
            number[k] = len(sources_of.setdefault(lang, []))
            sources_of[lang].append(source)
        langs = {lang: k for k, lang in enumerate(sources_of)}
        lang_of = np.array([langs[lang] for lang, _ in self.group])
        for lang, sources in sources_of.items():
            own = np.flatnonzero(lang_of[g] == langs[lang])
            own = own[np.lexsort((g[own], place[own]))]
            leaves, leaf = np.unique(place[own], return_inverse=True)
            for at in range(0, len(leaves), self.limits.piece):
                i, j = np.searchsorted(leaf, (at, at + self.limits.piece))
                c = np.zeros(j - i, tries.COUNTER)
                c["leaf"], c["source"], c["n"], c["docs"] = leaf[i:j] - at, number[g[own[i:j]]], n[own[i:j]], d[own[i:j]]
                yield tries.pack(lang, sources, [terms[x][1] for x in leaves[at : at + self.limits.piece].tolist()], c)
        self.clear()


def _count(limits: Limits):
    """Tries of the texts (lang, source, text) of a task, with some of their terms."""

    def handed(row: dict) -> pa.RecordBatch:
        first = limits.head // 2 % max(row["leaves"], 1)
        return tries.batch_of([row], {"heads": pa.array([[t for k, t in enumerate(tries.walk(row)) if k % limits.head == first]], pa.list_(pa.binary()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(limits)
        for batch in batches:
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            group = np.array([held.group.setdefault(x, len(held.group)) for x in names], np.int64)
            for i, j, data, offsets in K.text_slices(batch.column(2)):
                held.add(data, offsets, group[i:j])
                if held.full():
                    yield from map(handed, held.pieces())
        yield from map(handed, held.pieces())

    return run


def _cut(borders: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in tries.rows_of(batch):
                parts = list(tries.cut(row, borders))
                if parts:
                    yield tries.batch_of([r for _, r in parts], {"range": pa.array([k for k, _ in parts], pa.int32())})

    return run


def _merge(limits: Limits):
    """Merged tries of kept terms, a range of a lang after the other, and how often each source has them."""

    def handed(lang: str, merge: tries.Merge) -> Iterator[pa.RecordBatch]:
        for row in merge.tries(lang, LEAST_DOCS, limits.piece):
            found, total = tries.counters(row), np.zeros(len(row["sources"]), np.int64)
            np.add.at(total, found["source"], found["n"])
            yield tries.batch_of([row], {"totals": pa.array([total.tolist()], pa.list_(pa.int64()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, merge = None, tries.Merge()
        for batch in batches:
            for row in tries.rows_of(batch):
                if (row["lang"], row["range"]) != now:
                    if now:
                        yield from handed(now[0], merge)
                    now, merge = (row["lang"], row["range"]), tries.Merge()
                merge.add(row)
        if now:
            yield from handed(now[0], merge)

    return run


def shares(count: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (n + 2 * v)), a thousand at a time so that no step leaves 64 bits."""
    whole = n + 2 * v
    rest, out = count + 2, np.ones(np.broadcast_shapes(count.shape, n.shape), np.int64)
    out -= 1
    rest = np.broadcast_to(rest, out.shape).copy()
    for _ in range(3):
        rest *= 1000
        digit = rest // whole
        out = out * 1000 + digit
        rest -= digit * whole
    return out + 1


class _Sums:
    """What a tile of a lang's sources differ by from every later source, and their best terms so far."""

    def __init__(self, row: dict, limits: Limits) -> None:
        self.lang, self.v, self.cells = row["lang"], row["v"], limits.cells
        self.sources = [x["source"] for x in row["groups"]]
        self.n = np.array([x["n"] for x in row["groups"]], np.int64)
        self.number = {s: k for k, s in enumerate(self.sources)}
        self.tile = range(row["tile"] * limits.tile, min(len(self.sources), (row["tile"] + 1) * limits.tile))
        self.sums, self.top = np.zeros((len(self.tile), len(self.sources)), np.int64), [[] for _ in self.tile]

    def add(self, row: dict) -> None:
        found, terms = tries.counters(row), list(tries.walk(row))
        at = np.array([self.number[s] for s in row["sources"]], np.int64)[found["source"]]
        step = max(1, self.cells // len(self.sources))
        for a in range(0, len(terms), step):
            i, j = np.searchsorted(found["leaf"], (a, a + step))
            count = np.zeros((min(step, len(terms) - a), len(self.sources)), np.int64)
            count[found["leaf"][i:j] - a, at[i:j]] = found["n"][i:j]
            p, q = shares(count, self.n, self.v), shares(count.sum(axis=1), self.n.sum(), self.v)
            for k, source in enumerate(self.tile):
                own = p[:, source : source + 1]
                less = own - p[:, source + 1 :]  # f is the same either way: each two sources once
                self.sums[k, source + 1 :] += (less * less // (own + p[:, source + 1 :])).sum(axis=0)
                self.best(k, terms[a:], count[:, source], p[:, source], q)

    def best(self, k: int, terms: list[bytes], count: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
        """The walk meets smaller terms first, so stable sorts leave ties in UTF-8 order."""
        more = np.flatnonzero((count > 0) & (p > q))
        f = (p[more] - q[more]) ** 2 // (p[more] + q[more])
        keep = np.argsort(-f, kind="stable")[:TERMS]
        self.top[k] = sorted([*self.top[k], *((int(f[x]), terms[more[x]]) for x in keep)], key=lambda x: -x[0])[:TERMS]

    def rows(self) -> pa.RecordBatch:
        name = lambda k: (self.lang, self.sources[self.tile[k]])
        r, c = np.nonzero(self.sums)
        rows = [(*name(i), "pair", self.sources[j], s) for i, j, s in zip(r.tolist(), c.tolist(), self.sums[r, c].tolist(), strict=True)]
        rows += [(*name(k), "term", t.decode(), f) for k, best in enumerate(self.top) for f, t in best]
        columns, kinds = list(zip(*rows, strict=True)) or [[]] * 5, [*[pa.string()] * 4, pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["lang", "source", "part", "item", "value"])


def _audit(limits: Limits):
    """Sums and candidates from merged tries by lang and tile, each walked in byte order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sums = None
        for batch in batches:
            for row in tries.rows_of(batch):
                if (row["lang"], row["tile"]) != now:
                    if sums:
                        yield sums.rows()
                    now, sums = (row["lang"], row["tile"]), _Sums(row, limits)
                sums.add(row)
        if sums:
            yield sums.rows()

    return run


def divergence(docs: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """lang, source, part, item, value and rank: how a lang's sources differ from each other and from the lang.

    ``docs`` has text, lang and source, null counting as ''; other columns are ignored. Repeated rows count each. Groups
    without a term are paired as well, with value 0 where their lang keeps no term. Ties go to the smaller item in UTF-8
    order. Very long texts and terms are counted whole. An empty table gives no rows. In a task, terms are told apart by
    64-bit hashes; between tasks by their bytes.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(plain("lang"), plain("source"), plain("text"))
    pieces = materialize(docs.mapInArrow(_count(limits), f"{tries.DDL}, heads array<binary>"), "tries")
    leaves = pieces.agg(F.sum("leaves")).first()[0] or 0
    sampled = pieces.select(F.explode("heads").alias("t"), "lang", "leaves").orderBy(F.xxhash64("t", "lang", "leaves")).limit(limits.sampled).select("t").collect()
    sampled, ranges = sorted(bytes(r.t) for r in sampled), max(1, min(limits.sampled // 4, leaves // limits.range_leaves))
    borders = sorted({sampled[len(sampled) * k // ranges] for k in range(1, ranges)}) if sampled else []
    parts = pieces.drop("heads").mapInArrow(_cut(borders), f"{tries.DDL}, range int")
    parts = parts.repartition("lang", "range").sortWithinPartitions("lang", "range")
    merged = materialize(parts.mapInArrow(_merge(limits), f"{tries.DDL}, totals array<long>"), "merged")

    groups = docs.select("lang", "source").distinct()
    totals = merged.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("t")).groupBy("lang", F.col("t.sources").alias("source")).agg(F.sum("t.totals").alias("n"))
    known = merged.groupBy("lang").agg(F.sum("leaves").alias("v"))
    groups = materialize(groups.join(totals, ["lang", "source"], "left").fillna(0, ["n"]), "groups")
    langs = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups")).join(known, "lang")
    tiles = F.explode(F.sequence(F.lit(0), F.floor((F.size("groups") - 1) / limits.tile).cast("int"))).alias("tile")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    langs = langs.select("lang", "groups", "v", tiles).select("*", salts)
    salted = merged.drop("totals").withColumn("salt", F.pmod(F.xxhash64("first"), F.lit(SALTS)).cast("int"))
    met = salted.join(langs, ["lang", "salt"]).sortWithinPartitions("lang", "tile", "first")
    found = materialize(met.mapInArrow(_audit(limits), "lang string, source string, part string, item string, value long"), "audit")

    half = found.where("part = 'pair'").select("lang", "source", "item", "value")
    both = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    sums = both.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").fillna(0, ["value"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(found.where("part = 'term'"), "term").where(F.col("rank") <= TERMS))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
n AS (SELECT row_number() OVER () AS i, * FROM d),
t AS (SELECT i, lang, source, unnest(terms) AS term FROM n),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
w AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM g LEFT JOIN (SELECT c.* FROM c JOIN k USING (lang, term)) c USING (lang, source) GROUP BY ALL),
p AS (SELECT k.lang, w.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (w.n + 2 * v.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 2) // (v.n + 2 * v.v) AS q
  FROM k JOIN w USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = k.lang AND c.source = w.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
best AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM best))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 10"""
