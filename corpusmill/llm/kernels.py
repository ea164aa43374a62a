"""Array kernels over the bytes of many texts at once, for use inside Arrow tasks.

Every kernel works on slices of a batch (about two megabytes, or one longer text), so its memory does not follow the
size of Spark's batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 21

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULTIPLIER = 0x5851F42D4C957F2D
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, U64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=U64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive slices; null counts as empty."""
    column = pc.fill_null(column, "")
    if len(column) == 0:
        return
    large = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = min(len(column), max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(lower: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of all words; no word crosses documents."""
    inside = ~breaks[lower]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begin = offsets[:-1][offsets[:-1] < len(lower)]
    first[begin] = inside[begin]
    end = offsets[1:][offsets[1:] > 0] - 1
    last[end] = inside[end]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


def prefix_hash(data: np.ndarray, base: int = _MULTIPLIER) -> np.ndarray:
    """Prefix sums of the polynomial hash; the hash of [s, e) is (h[e] - h[s]) times base ** -s."""
    h = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(base, len(data)), out=h[1:])
    return h


def inverse(base: int = _MULTIPLIER) -> int:
    return pow(base, -1, 1 << 64)


def word_hashes(lower: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    h = prefix_hash(lower)
    return mix((h[end] - h[start]) * powers(inverse(), len(lower) + 1)[start])


_WEIGHTS = mix(np.arange(1, 9, dtype=U64)) | U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, counts by document). A text of fewer words is one shingle; without words none."""
    lower = LOWER[data]
    start, end, doc = words(lower, offsets)
    n = len(offsets) - 1
    w = word_hashes(lower, start, end)
    hashes, owner = [], []
    if len(w) >= width:
        whole = doc[: len(w) - width + 1] == doc[width - 1 :]
        h = np.zeros(len(w) - width + 1, U64)
        for k in range(width):
            h += w[k : len(w) - width + 1 + k] * _WEIGHTS[k]
        hashes.append(mix(h[whole]))
        owner.append(doc[: len(h)][whole])
    count = np.bincount(doc, minlength=n)
    at = np.concatenate(([0], np.cumsum(count)))[:-1]
    for c in range(1, width):
        few = np.flatnonzero(count == c)
        if len(few):
            h = np.full(len(few), c * 0x9E3779B97F4A7C15 % (1 << 64), U64)
            for k in range(c):
                h += w[at[few] + k] * _WEIGHTS[k]
            hashes.append(mix(h))
            owner.append(few)
    if not hashes:
        return np.empty(0, U64), np.zeros(n, np.int64)
    h, d = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], np.bincount(d[new], minlength=n)


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Where the values of each document with values begin."""
    return (np.cumsum(counts) - counts)[counts > 0]


def min_hashes(sets: np.ndarray, counts: np.ndarray, n_hashes: int) -> np.ndarray:
    """A row of 32-bit minima for each document with shingles."""
    starts = starts_of(counts)
    out = np.empty((len(starts), n_hashes), np.uint32)
    if len(starts):
        for k, a in enumerate(mix(np.arange(1, n_hashes + 1, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)):
            out[:, k] = np.minimum.reduceat(((sets * a) >> U64(32)).astype(np.uint32), starts)
    return out


def set_digests(sets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each document's whole set, whatever the order; 0 for empty sets."""
    out = np.zeros((2, len(counts)), U64)
    if len(sets):
        some, starts = counts > 0, starts_of(counts)
        out[0, some] = np.add.reduceat(mix(sets), starts)
        out[1, some] = np.add.reduceat(mix(sets ^ U64(0xA0761D6478BD642F)), starts)
    return out[0].view(np.int64), out[1].view(np.int64)


def binary_rows(matrix: np.ndarray, present: np.ndarray) -> pa.Array:
    """Arrow binary values from the rows of ``matrix``, empty where ``present`` is false."""
    width = matrix.shape[1] * matrix.itemsize
    offsets = np.concatenate(([0], np.cumsum(np.where(present, width, 0)))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(present), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix))])
