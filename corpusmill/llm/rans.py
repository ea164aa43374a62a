"""Token ids as files of static range asymmetric numeral system (rANS) blocks.

Layout of a written corpus: ``tables`` holds the shared frequencies, scaled to 2 ** 18; ``blocks`` holds one row for
each independent block of whole documents: their ids and lengths, the states of its interleaved lanes, the 32-bit
words, and checkpoints (step, word position, lane states, checksum of the ids since the last one) from which a reader
can start anywhere. Token i of a block belongs to lane i modulo the number of lanes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, remove, remove_at_exit, scratch
from .tokens import TOKENIZER, encoded, encoder

BITS, LANES, STEPS = 18, 1024, 128  # precision of the tables; lanes of a block; steps between checkpoints
BLOCK_TOKENS = 1 << 18
LOW, WORD = np.uint64(1 << 31), np.uint64(32)
_TALLY = pa.list_(pa.struct([("id", pa.int32()), ("n", pa.int64())]))
_SCHEMA = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("tally", _TALLY)])
_SCHEMA_DDL = "part int, doc_id long, n_tokens long, ids binary, tally array<struct<id:int,n:long>>"
_BLOCK = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("lanes", pa.int32()), ("words", pa.binary()),
        ("checkpoints", pa.list_(pa.struct([("step", pa.int32()), ("word", pa.int64()), ("states", pa.binary()), ("crc32", pa.int64())]))),
    ]
)
_BLOCK_DDL = (
    "part int, block int, n_tokens long, doc_ids array<long>, lengths array<long>, lanes int, words binary, "
    "checkpoints array<struct<step:int,word:long,states:binary,crc32:long>>"
)


def scaled(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that sum to 2 ** bits, at least 1 for each id that occurs; what rounding leaves goes to the most frequent."""
    total, size = int(counts.sum()), 1 << bits
    if not total:
        return counts.astype(np.int64)
    if np.count_nonzero(counts) > size:
        raise ValueError(f"more than 2 ** {bits} different ids")
    freq = np.where(counts > 0, np.maximum(1, (counts.astype(float) * size / total).astype(np.int64)), 0)
    order = np.argsort(-freq, kind="stable")
    gap = size - int(freq.sum())
    for i in order:
        step = gap if gap >= 0 else max(gap, 1 - int(freq[i]))
        freq[i] += step
        gap -= step
        if not gap:
            break
    return freq


class Tables:
    def __init__(self, freq: np.ndarray, bits: int = BITS):
        self.bits = bits
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))


def encode_block(ids: np.ndarray, tables: Tables, lanes: int = LANES, every: int = STEPS) -> tuple[int, np.ndarray, list[tuple[int, int, np.ndarray, int]]]:
    """(lanes, words, checkpoints) of one block; the first checkpoint is its beginning."""
    lanes = max(1, min(lanes, len(ids)))
    n, bits = len(ids), np.uint64(tables.bits)
    freq, cum = tables.freq[ids], tables.cum[ids]
    most = freq << np.uint64(63 - tables.bits)
    x = np.full(lanes, LOW, np.uint64)
    out, points, written = [], [], 0
    steps = -(-n // lanes)
    for s in range(steps - 1, -1, -1):
        a, b = s * lanes, min(n, (s + 1) * lanes)
        y, f = x[: b - a], freq[a:b]
        over = y >= most[a:b]
        if over.any():
            words = y[over]
            out.append(words.astype(np.uint32))
            y[over] = words >> WORD
            written += len(words)
        q = y // f
        x[: b - a] = (q << bits) + (y - q * f) + cum[a:b]
        if s % every == 0:
            points.append((s, written, x.copy(), zlib.crc32(ids[a : min(n, (s + every) * lanes)].astype("<u4").tobytes())))
    words = np.concatenate(out[::-1]) if out else np.empty(0, np.uint32)
    return lanes, words, [(s, len(words) - w, states, crc) for s, w, states, crc in reversed(points)]


def decode_block(n: int, lanes: int, words: np.ndarray, points: list[tuple[int, int, np.ndarray, int]], tables: Tables, only: int | None = None) -> np.ndarray:
    """Ids of a block, or of the part from checkpoint ``only`` to the next; checksums are verified."""
    bits, mask = np.uint64(tables.bits), np.uint64((1 << tables.bits) - 1)
    parts = []
    for k in range(len(points)) if only is None else [only]:
        step, pos, states, crc = points[k]
        x = states.copy()
        last = points[k + 1][0] if k + 1 < len(points) else -(-n // lanes)
        ids = np.empty(min(n, last * lanes) - step * lanes, np.uint32)
        for s in range(step, last):
            m = min(lanes, n - s * lanes)
            y = x[:m]
            slot = y & mask
            found = tables.symbol[slot]
            ids[(s - step) * lanes : (s - step) * lanes + m] = found
            y = tables.freq[found] * (y >> bits) + slot - tables.cum[found]
            low = np.flatnonzero(y < LOW)
            y[low] = (y[low] << WORD) | words[pos : pos + len(low)]
            pos += len(low)
            x[:m] = y
        end = points[k + 1][2] if k + 1 < len(points) else LOW  # where the encoder began
        if (x != end).any() or zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"checksum of block part {k} is wrong")
        parts.append(ids)
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def _tokenized(name: str, bounds: list[int]):
    """Ids of each text and, as a last row of each task, how often it met each id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name)
        width, ends, counts = enc.dtype.itemsize, np.array(bounds, np.int64), np.zeros(enc.size, np.int64)
        for batch in batches:
            found, size, start = [], 0, 0
            for i, packed in encoded(batch.column(1), name):
                found.append(packed)
                size += len(packed)
                if size >= 1 << 23 or i + 1 == len(batch):
                    ids = batch.column(0).slice(start, len(found))
                    part = np.searchsorted(ends, ids.fill_null(-(1 << 63)).to_numpy(), "right").astype(np.int32)
                    counts += np.bincount(np.frombuffer(b"".join(found), enc.dtype), minlength=enc.size)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part), ids, pa.array([len(x) // width for x in found], pa.int64()), pa.array(found, pa.binary()), pa.nulls(len(found), _TALLY)], _SCHEMA.names
                    )
                    start, found, size = i + 1, [], 0
        some = np.flatnonzero(counts)
        tally = [{"id": i, "n": n} for i, n in zip(some.tolist(), counts[some].tolist(), strict=True)]
        yield pa.RecordBatch.from_pylist([{"part": None, "doc_id": None, "n_tokens": None, "ids": None, "tally": tally}], _SCHEMA)

    return rows


def _blocks(freq: np.ndarray, dtype: str, block_tokens: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(freq)
        held: list[tuple] = []  # (part, doc_id, ids)
        size = number = 0

        def flush():
            ids = np.concatenate([x for _, _, x in held])
            lanes, words, points = encode_block(ids, tables)
            row = {
                "part": held[0][0], "block": number, "n_tokens": len(ids),
                "doc_ids": [d for _, d, _ in held], "lengths": [len(x) for _, _, x in held], "lanes": lanes, "words": words.tobytes(),
                "checkpoints": [{"step": s, "word": w, "states": states.tobytes(), "crc32": crc} for s, w, states, crc in points],
            }
            return pa.RecordBatch.from_pylist([row], _BLOCK)

        for batch in batches:
            for part, doc, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if held and (part != held[-1][0] or size >= block_tokens):
                    yield flush()
                    number = number + 1 if part == held[-1][0] else 0
                    held, size = [], 0
                held.append((part, doc, np.frombuffer(packed.as_buffer(), dtype)))
                size += len(held[-1][2])
        if held:
            yield flush()

    return rows


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode every row of ``docs`` in ascending doc_id order under ``path``.

    Null and empty texts are an end id alone; null ids come first; of rows that repeat a doc_id the shorter comes first,
    then the one with the smaller checksum. A very long text is one block. Other columns are ignored; an empty table
    gives files without blocks.
    """
    spark = docs.sparkSession
    enc = encoder(tokenizer)
    n = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    share = [i / n for i in range(1, n)]
    bounds = (rows.select(F.percentile_approx("doc_id", share, 10000)).first()[0] or []) if share else []
    # The ids wait in a table for the frequencies of all of them.
    kept = f"{path}/ids"
    rows.mapInArrow(_tokenized(tokenizer, sorted(set(bounds))), _SCHEMA_DDL).write.option("compression", "zstd").parquet(kept)
    found = spark.read.schema(_SCHEMA_DDL).parquet(kept)
    tally = found.where("tally IS NOT NULL").select(F.explode("tally").alias("t")).groupBy("t.id").agg(F.sum("t.n").alias("n"))
    counts = np.zeros(enc.size, np.int64)
    for r in tally.collect():  # at most the vocabulary
        counts[r["id"]] = r["n"]
    freq = scaled(counts)
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id int, freq long").coalesce(1).write.parquet(f"{path}/tables")
    ids = found.where("ids IS NOT NULL").select("part", "doc_id", "ids", "n_tokens").repartitionById(n, F.col("part"))
    ordered = ids.sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "n_tokens", F.crc32("ids")).select("part", "doc_id", "ids")
    ordered.mapInArrow(_blocks(freq, enc.dtype.str, block_tokens), _BLOCK_DDL).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    remove(spark, kept)


def _decoded(freq: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(freq)
        for batch in batches:
            for row in batch.to_pylist():
                points = [(p["step"], p["word"], np.frombuffer(p["states"], np.uint64), p["crc32"]) for p in row["checkpoints"]]
                ids = decode_block(row["n_tokens"], row["lanes"], np.frombuffer(row["words"], np.uint32), points, tables)
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[k]] * len(lengths), pa.int32()) for k in ("part", "block")] + [pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["part", "block", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    return rows


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files under ``path`` alone."""
    table = spark.read.parquet(f"{path}/tables").collect()  # at most the vocabulary
    freq = np.zeros(max((r["id"] for r in table), default=0) + 1, np.int64)
    for r in table:
        freq[r["id"]] = r["freq"]
    blocks = spark.read.schema(_BLOCK_DDL).parquet(f"{path}/blocks")
    index = blocks.select("part", "block", "n_tokens")
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # as many rows as ranges of doc_ids
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    order = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    starts = index.withColumn("before", F.sum("n_tokens").over(order) - F.col("n_tokens")).join(F.broadcast(base), "part")
    starts = starts.select("part", "block", (F.col("base") + F.col("before")).alias("begin"))
    found = blocks.mapInArrow(_decoded(freq), "part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "block"]).select("doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Encode ``docs`` into the session's shared folder and read the files back; they go when the session ends."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    remove_at_exit(spark, path)
    return read_tokens(spark, path)
