"""Removal of repeated 100-byte strings by a sparse, hash-compared suffix sort.

Each 100-byte window is represented by its anchor: the 32-byte string inside it with the least hash, the leftmost of
ties. Equal windows have their anchor at the same place, so only suffixes at anchors, about one byte in 35, have to be
compared. A stretch of windows with one anchor, and the bytes they span, is the anchor's context.

1. Tasks find anchors and contexts; of equal contexts in some megabytes of text only the first travels, the others are repeats.
2. Anchors meet by the hash of their string. A context equal to an earlier one, by two hashes of its bytes to different
   bases with 112 bits together, is repeated as a whole. Where one anchor has different contexts, as at the edges of
   repeats and edits, the contexts' first occurrences go on. The contexts of an anchor with very many are dealt by the
   34 bytes before it and again by the 34 after it: two equal windows agree in one of these at least.
3. Those contexts' bytes are fetched and the suffixes at their windows are sorted by merging: the common extension of
   two suffixes is found by binary search over prefix polynomial hashes, so a comparison takes a logarithmic number
   of steps; neighbours that seem equal are verified byte by byte.
4. What is repeated is merged by document and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import ids_tell_rows, materialize, partitions

LENGTH, ANCHOR = 100, 32
STRINGS = LENGTH - ANCHOR + 1  # anchors to choose from in a window
SEGMENT = 1 << 22
ANCHOR_SLICE, AT_HAND = 1 << 20, 1 << 23  # bytes read at once; bytes whose anchors are combined before they travel
BROADCAST_ROWS = 4_000_000  # spans or contexts that are sent to every task at most, 16 bytes each, so 64 MB besides their documents
HOT_CONTEXTS, BESIDE = 2_000, 34  # different contexts from which on an anchor's are dealt by the bytes beside it; half of LENGTH - ANCHOR
_OTHER_BASE = 0x2545F4914F6CDD1D
NO_ID = -(1 << 63)  # stands for a null doc_id, and comes first


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all stretches of ``width`` values."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, document, first window, shape).

    A shape has the last window - first window in 8 bits, the anchor - first window in the next 7, a place for a mark,
    and 48 bits of a second context hash. Windows are counted from the document's beginning. Long buffers are read in overlapping segments.
    """
    out = []
    for at in range(0, max(1, len(data) - LENGTH + 1), SEGMENT):
        part = data[at : at + SEGMENT + LENGTH - 1]
        n = len(part) - LENGTH + 1
        if n <= 0:
            continue
        h = K.prefix_hash(part)
        turn = K.powers(K.inverse(), len(part) + 1)
        strings = K.mix((h[ANCHOR:] - h[:-ANCHOR]) * turn[: len(part) - ANCHOR + 1])
        low = np.uint64((1 << 24) - 1)
        owner = (sliding_min((strings & ~low) | np.arange(len(strings), dtype=np.uint64), STRINGS) & low).astype(np.int64)
        start = np.arange(at, at + n)
        doc = np.searchsorted(offsets, start, "right") - 1
        whole = start + LENGTH <= offsets[doc + 1]
        first = whole.copy()
        first[1:] &= ~whole[:-1] | (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])
        last = whole.copy()
        last[:-1] &= ~whole[1:] | (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        p = owner[a]
        span = (h[b + LENGTH] - h[a]) * turn[a]
        context = K.mix(K.mix(span ^ np.uint64(0x9FB21C651E98DF25)) + (p - a).astype(np.uint64) * np.uint64(0x100000001B3) + (b - a).astype(np.uint64))
        other = K.prefix_hash(part, _OTHER_BASE)
        check = K.mix((other[b + LENGTH] - other[a]) * K.powers(K.inverse(_OTHER_BASE), len(part) + 1)[a]) >> np.uint64(16)
        d = doc[a]
        out.append((strings[p], context, d, a + at - offsets[d], (check << np.uint64(16)).view(np.int64) | (p - a) << 8 | (b - a)))
    if not out:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_ANCHOR_DDL = "route long, context long, doc long, low long, shape long, high long"


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors (``high`` null) and, of contexts that came earlier among the texts at hand, merged repeats (``high`` set)."""
    for batch in batches:
        found, held = [], 0
        ids = batch.column(0).fill_null(NO_ID).to_numpy()
        for i, j, data, offsets in K.text_slices(batch.column(1), ANCHOR_SLICE):
            kmer, context, doc, low, shape = anchors(data, offsets)
            found.append((kmer.view(np.int64), context.view(np.int64), ids[i + doc], low, shape))
            held += len(data)
            if held >= AT_HAND or j == len(batch):
                yield _combined(found)
                found, held = [], 0


def _combined(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    kmer, context, doc, low, shape = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((low, doc, shape, context, kmer))
    k, c, d, s, f = kmer[order], context[order], doc[order], low[order], shape[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (f[1:] != f[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    again = np.zeros(len(order), bool)
    again[order] = ~new & ((d != d[head]) | (s != s[head]))
    keep = np.zeros(len(order), bool)
    keep[order] = new
    lo, hi = low[again], low[again] + (shape[again] & 255) + LENGTH
    owner, lo, hi = merged(doc[again], lo, hi)
    n = int(keep.sum())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((kmer[keep], K.mix(owner.view(np.uint64) + lo.view(np.uint64)).view(np.int64)))),
            pa.array(np.concatenate((context[keep], np.zeros(len(lo), np.int64)))),
            pa.array(np.concatenate((doc[keep], owner))),
            pa.array(np.concatenate((low[keep], lo))),
            pa.array(np.concatenate((shape[keep], np.zeros(len(lo), np.int64)))),
            pa.array(np.concatenate((np.zeros(n, np.int64), hi)), mask=np.arange(n + len(lo)) < n),
        ],
        ["route", "context", "doc", "low", "shape", "high"],
    )


def merged(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of spans that overlap or touch."""
    if not len(low):
        return doc, low, high
    order = np.lexsort((low, doc))
    doc, low, high = doc[order], low[order], high[order]
    begin = np.concatenate(([0], np.flatnonzero(doc[1:] != doc[:-1]) + 1))
    reach = high.copy()
    for s, e in zip(begin.tolist(), [*begin[1:].tolist(), len(doc)], strict=True):
        np.maximum.accumulate(reach[s:e], out=reach[s:e])
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (low[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return doc[at], low[at], reach[np.concatenate((at[1:], [len(doc)])) - 1]


def _by_group(batches: Iterator[pa.RecordBatch], least: int = 200_000) -> Iterator[pa.Table]:
    """Tables of whole groups (equal first columns) from sorted batches."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += len(batch)
        if size < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = table.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut:
            yield table.slice(0, cut)
        held, size = table.slice(cut).to_batches(), len(table) - cut
        least = max(least, 2 * size)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_FOUND_DDL = "doc long, low long, high long, route long, shape int"  # of a shape only windows, anchor and mark are left


def _meet(hot_contexts: int):
    """From anchors sorted by (route, context, shape, doc, low): repeats (``high`` set) and contexts to compare (``high`` null)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(batches):
            done = pc.is_valid(table.column("high")).to_numpy()
            kmer, context, doc, low, shape = (table.column(c).to_numpy() for c in ("route", "context", "doc", "low", "shape"))
            given = table.column("high").fill_null(0).to_numpy()
            k, c = kmer[~done], context[~done]
            d, s, f = doc[~done], low[~done], shape[~done]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (f[1:] != f[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0)) if len(k) else np.empty(0, np.int64)
            again = ~new & ((d != d[head]) | (s != s[head]))
            group = np.cumsum(np.concatenate((np.ones(min(1, len(k)), np.int64), (k[1:] != k[:-1]).astype(np.int64)))) - 1
            different = np.bincount(group[new], minlength=1)[group] if len(k) else np.empty(0, np.int64)
            several = (different > 1) & new
            f = f & 0x7FFF | (different > hot_contexts).astype(np.int64) << 15
            o = [doc[done], d[again], d[several]]
            lo = [low[done], s[again], s[several]]
            hi = [given[done], s[again] + (f[again] & 255) + LENGTH, np.zeros(several.sum(), np.int64)]
            route = [np.zeros(done.sum() + again.sum(), np.int64), k[several]]
            form = [np.zeros(done.sum() + again.sum(), np.int64), f[several]]
            n = int(done.sum() + again.sum())
            total = n + int(several.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(o)), pa.array(np.concatenate(lo)), pa.array(np.concatenate(hi), mask=np.arange(total) >= n),
                    pa.array(np.concatenate(route)), pa.array(np.concatenate(form).astype(np.int32)),
                ],
                ["doc", "low", "high", "route", "shape"],
            )

    return rows


def _routes(route: int, raw: bytes, anchor: int, lead: int, more: int) -> list[int]:
    """Where the contexts of a hot anchor meet: those with the same bytes before it, and those with the same after it."""
    sides = []
    if lead >= BESIDE:
        sides.append(b"<" + raw[anchor - BESIDE : anchor])
    if lead - more <= BESIDE:
        sides.append(b">" + raw[anchor + ANCHOR : anchor + ANCHOR + BESIDE])
    return [int.from_bytes(hashlib.blake2b(route.to_bytes(8, "little", signed=True) + x, digest_size=8).digest(), "little", signed=True) for x in sides]


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted context."""
    for batch in batches:
        ids = batch.column(0).fill_null(NO_ID).to_numpy()
        for i, j, data, offsets in K.text_slices(batch.column(1)):
            raw = data.tobytes()
            route, doc, low, shape, part = [], [], [], [], []
            for r in range(i, j):
                base = int(offsets[r - i])
                for own, at, form in zip(*(batch.column(c)[r].as_py() for c in (2, 3, 4)), strict=True):
                    s, lead, more = base + at, form >> 8 & 127, form & 255
                    for k in _routes(own, raw, s + lead, lead, more) if form >> 15 else (own,):
                        route.append(k), doc.append(ids[r]), low.append(at), shape.append(form & 0x7FFF)
                        part.append(raw[s : s + more + LENGTH])
            yield pa.RecordBatch.from_arrays(
                [pa.array(route, pa.int64()), pa.array(doc, pa.int64()), pa.array(low, pa.int64()), pa.array(shape, pa.int32()), pa.array(part, pa.binary())],
                ["route", "doc", "low", "shape", "bytes"],
            )


class Suffixes:
    """Suffixes of one buffer, compared over their first ``LENGTH`` bytes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.hash = K.prefix_hash(data)
        self.turn = K.powers(K.inverse(), len(data) + 1)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common beginning of each pair, by binary search over prefix hashes."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), LENGTH, np.int64)
        hx, hy, tx, ty = self.hash[x], self.hash[y], self.turn[x], self.turn[y]
        for _ in range(LENGTH.bit_length()):
            middle = (low + high + 1) >> 1
            same = (self.hash[x + middle] - hx) * tx == (self.hash[y + middle] - hy) * ty
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.extension(x, y)
        at = np.minimum(n, LENGTH - 1)
        return np.where(n >= LENGTH, or_equal, self.data[x + at] < self.data[y + at])

    def sort(self, start: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """``start`` with each group (from ``first``, ``size`` long) merge-sorted; all groups take each level together."""
        order = np.arange(len(start))
        group = np.repeat(np.arange(len(first)), size)
        width = 1
        while len(size) and width < size.max():
            active = np.flatnonzero(size[group] > width)
            base, n = first[group[active]], size[group[active]]
            i = active - base
            run = i // width
            other = (run ^ 1) * width
            low, high = np.minimum(other, n), np.minimum(other + width, n)
            begin = low.copy()
            mine, after = start[order[active]], (run & 1).astype(bool)  # of equal suffixes those of the left run come first
            for _ in range(width.bit_length()):
                open_ = low < high
                middle = (low + high) >> 1
                probe = start[order[base + np.minimum(middle, n - 1)]]
                before = self.less(probe, mine, after)
                low, high = np.where(open_ & before, middle + 1, low), np.where(open_ & ~before, middle, high)
            place = base + np.minimum(run * width, other) + (i - run * width) + (low - begin)
            moved = order.copy()
            moved[place] = order[active]
            order = moved
            width *= 2
        return order

    def equal(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Verified equality of the first ``LENGTH`` bytes."""
        out = self.extension(x, y) >= LENGTH
        at = np.flatnonzero(out)
        reach = np.arange(LENGTH)
        for s in range(0, len(at), 10_000):
            p = at[s : s + 10_000]
            out[p] = (self.data[x[p][:, None] + reach] == self.data[y[p][:, None] + reach]).all(axis=1)
        return out


def repeats(group: np.ndarray, data: np.ndarray, offsets: np.ndarray, lead: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first repeated window, last repeated window) of contexts, given in the order of their places.

    Windows of one group with the anchor at the same place are sorted as suffixes; of equal ones all but the earliest
    are repeats.
    """
    n = more + 1
    context = np.repeat(np.arange(len(n)), n)
    window = np.arange(len(context)) - np.repeat(np.cumsum(n) - n, n)
    key = group[context] * 256 + lead[context] - window
    by = np.argsort(key, kind="stable")
    context, window, key = context[by], window[by], key[by]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((first, [len(key)])))
    several = np.repeat(size > 1, size)
    context, window = context[several], window[several]
    size = size[size > 1]
    first = np.cumsum(size) - size
    if not len(context):
        return tuple(np.empty(0, np.int64) for _ in range(3))
    text = Suffixes(data)
    start = offsets[context] + window
    order = text.sort(start, first, size)
    same = np.zeros(len(order), bool)
    inner = np.ones(len(order), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    same[at] = text.equal(start[order[at - 1]], start[order[at]])
    run = np.cumsum(~same) - 1
    earliest = np.full(run[-1] + 1, len(order), np.int64)
    np.minimum.at(earliest, run, order)  # before sorting, a group's suffixes stand in the order of their places
    hit = order[order != earliest[run]]
    c, w = context[hit], window[hit]
    by = np.lexsort((w, c))
    c, w = c[by], w[by]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(c)), bool), c[1:] != c[:-1])))
    return c[new], w[new], w[np.concatenate((new[1:], [len(c)])) - 1] if len(c) else w


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From contexts sorted by (route, doc, low): spans that are repeated."""
    for table in _by_group(batches, 20_000):
        route, doc, low, shape = (table.column(c).to_numpy() for c in ("route", "doc", "low", "shape"))
        column = pa.chunked_array([c.cast(pa.large_binary()) for c in table.column("bytes").chunks]).combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        _, where, raw = column.buffers()
        offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
        group = np.cumsum(np.concatenate(([0], (route[1:] != route[:-1]).astype(np.int64))))
        c, w0, w1 = repeats(group, data, offsets - offsets[0], shape.astype(np.int64) >> 8, shape.astype(np.int64) & 255)
        yield pa.RecordBatch.from_arrays([pa.array(doc[c]), pa.array(low[c] + w0), pa.array(low[c] + w1 + LENGTH)], ["doc", "low", "high"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is left."""
    for batch in batches:
        for i, j, data, offsets in K.text_slices(batch.column(1)):
            rows = []
            for r in range(i, j):
                text = data[offsets[r - i] : offsets[r - i + 1]]
                low, high = (np.array(batch.column(k)[r].as_py() or (), np.int64) for k in (2, 3))
                _, low, high = merged(np.zeros(len(low), np.int64), low, high)
                keep = hashlib.sha256()
                at = 0
                for s, e in zip(low.tolist(), high.tolist(), strict=True):
                    keep.update(text[at:s].tobytes())
                    at = e
                keep.update(text[at:].tobytes())
                rows.append((len(text), int((high - low).sum()), len(low), keep.hexdigest()))
            n, removed, spans, digest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )


def _beside(docs: DataFrame, lists: DataFrame, few: bool, how: str) -> DataFrame:
    """``docs`` joined with lists by document: where the texts lie while the lists are small, else by shuffling both."""
    return docs.join(F.broadcast(lists) if few else lists, F.coalesce("doc_id", F.lit(NO_ID)) == F.col("doc"), how)


def repeated_spans(docs: DataFrame, hot_contexts: int = HOT_CONTEXTS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc, low, high): byte spans of ``docs`` (doc_id, text) covered by strings that start earlier as well."""
    n = partitions(docs.sparkSession)
    met = docs.mapInArrow(_anchor_rows, _ANCHOR_DDL).repartition(n, "route").sortWithinPartitions("route", "context", "shape", "doc", "low")
    met = materialize(met.mapInArrow(_meet(hot_contexts), _FOUND_DDL), "met")
    open_ = met.where("high IS NULL")
    lists = open_.groupBy("doc").agg(F.collect_list(F.struct("route", F.col("low").cast("int").alias("low"), "shape")).alias("w"))
    lists = lists.select("doc", *(F.col(f"w.{c}").alias(c) for c in ("route", "low", "shape")))  # flat lists are the smaller ones
    texts = _beside(docs, lists, open_.count() <= broadcast_rows, "inner").select("doc_id", "text", "route", "low", "shape")
    contexts = texts.mapInArrow(_cut_contexts, "route long, doc long, low long, shape int, bytes binary").dropDuplicates(["route", "doc", "low", "shape"])
    compared = contexts.repartition(n, "route").sortWithinPartitions("route", "doc", "low").mapInArrow(_compare, "doc long, low long, high long")
    return met.where("high IS NOT NULL").select("doc", "low", "high").unionByName(compared)


def remove_repeats(docs: DataFrame, hot_contexts: int = HOT_CONTEXTS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``.

    Null text counts as empty; texts under 100 bytes are kept whole; very long ones are read whole, in segments. A null doc_id comes before all others, and each row
    with one is a document. Rows that repeat a doc_id with the same text are one document: they don't repeat each other;
    with different texts they are different documents. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if ids_tell_rows(docs):
        return _removed(docs, hot_contexts, broadcast_rows)
    ordered = docs.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)).orderBy(F.col("doc_id").asc_nulls_first(), "digest")
    rows = materialize(ordered.withColumn("row", F.monotonically_increasing_id()), "numbered")  # in the order of the documents
    first = rows.where("doc_id IS NOT NULL").groupBy("doc_id", "digest").agg(F.min("row").alias("first"))
    names = materialize(rows.select("doc_id", "digest", "row").join(first, ["doc_id", "digest"], "left").select("row", "doc_id", F.coalesce("first", "row").alias("number")), "names")
    numbered = rows.select("row", "text").join(names, "row").select(F.col("number").alias("doc_id"), "text")
    found = _removed(numbered, hot_contexts, broadcast_rows).withColumnRenamed("doc_id", "number")
    return found.join(names.where("row = number").select("number", "doc_id"), "number").select("doc_id", *found.columns[1:])


def _removed(docs: DataFrame, hot_contexts: int, broadcast_rows: int) -> DataFrame:
    """``remove_repeats`` of documents whose doc_id stands for one text."""
    spans = materialize(repeated_spans(docs, hot_contexts, broadcast_rows), "spans")
    lists = spans.groupBy("doc").agg(F.collect_list(F.struct(F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high"))).alias("s"))
    lists = lists.select("doc", F.col("s.low").alias("lows"), F.col("s.high").alias("highs"))
    held = _beside(docs, lists, spans.count() <= broadcast_rows, "left").select("doc_id", "text", "lows", "highs")
    return held.mapInArrow(_cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
