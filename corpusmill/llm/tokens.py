"""Token ids of whole texts, by the tokenizers library.

Byte-level vocabularies cut a text into pre-tokens and encode each on its own. Where the pre-tokens of some megabytes
of text begin is found by array operations over bytes; different pre-tokens are looked up once, and the library sees
one again only after the bounded memory was emptied. A text is then a gather from remembered ids. Texts with characters
whose class depends on the version of Unicode, or with a special token of the vocabulary, go to the library whole.
"""

from __future__ import annotations

import functools
import os
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import kernels as K

END = 0
TOKENIZER = "byte_bpe_50k.json"
MEMORY = 700_000  # pre-tokens remembered at once
SLICE = 1 << 21  # bytes of text whose pre-tokens are looked up together
_SPACE_MARK = "Ġ"  # how the vocabulary writes a space
_JOINED = 3000  # pre-tokens handed to the library at once
UNSURE, BLANK, LETTER, NUMBER, OTHER = range(5)
#: Endings that the public pattern of byte-level pre-tokenizers cuts off as words.
_ENDINGS = (b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d")

_encoders: dict[tuple, Encoder] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where a public vocabulary lies; a name with a slash is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _classes() -> np.ndarray:
    """The class of each code point under 2 ** 16; UNSURE where two versions of Unicode differ, and for surrogates."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.full(1 << 16, UNSURE, np.uint8)
    for c in range(1 << 16):
        old, new = unicodedata.ucd_3_2_0.category(chr(c)), unicodedata.category(chr(c))
        if old == new and old not in ("Cn", "Cs") and c not in range(0x1C, 0x20):
            out[c] = BLANK if old in ("Zs", "Zl", "Zp") or c in (9, 10, 11, 12, 13, 0x85) else kind.get(old[0], OTHER)
    return out


def _byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character of each byte; characters of four bytes are UNSURE."""
    table = _classes()
    out = table[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first, second = data[lead].astype(np.int64), data[lead + 1].astype(np.int64) & 63
        two = first < 0xE0
        third = data[np.where(two, lead, lead + 2)].astype(np.int64) & 63
        code = np.where(two, (first & 31) << 6 | second, (first & 15) << 12 | second << 6 | third)
        found = np.where(first < 0xF0, table[code], UNSURE)
        out[lead], out[lead + 1] = found, found
        out[lead[~two] + 2] = found[~two]
        four = lead[first >= 0xF0]
        out[four + 3] = UNSURE
    return out


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where pre-tokens begin, whether each text holds an UNSURE character).

    A run of one class is a pre-token, a space before it belongs to it; of other white space before a run, the last
    character stands alone.
    """
    n = len(data)
    kind = _byte_classes(data)
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[offsets] = True
    head = (data & 0xC0) != 0x80  # a character begins here
    blank = kind == BLANK
    start = edge[:-1].copy()
    start[1:] |= head[1:] & (kind[1:] != kind[:-1])
    after_space = np.zeros(n, bool)
    after_space[1:] = data[:-1] == 0x20
    start &= ~after_space | blank | edge[:-1]
    # The last character of white space before something else.
    turn = np.flatnonzero(blank[:-1] & ~blank[1:] & ~edge[1:-1])
    while len(turn):
        whole = head[turn]
        start[turn[whole]] = True
        turn = turn[~whole] - 1
    mark = np.flatnonzero((data == 0x27) & start)
    for ending in _ENDINGS:
        k = len(ending)
        at = mark[mark + k <= n]
        for i in range(1, k):
            at = at[(data[at + i] == ending[i]) & ~edge[at + i]]
        start[at + 1] = False
        follow = at[at + k < n] + k
        start[follow[kind[follow] == LETTER]] = True
    unsure = np.add.reduceat(np.append(kind == UNSURE, False), offsets[:-1]).astype(bool) & (offsets[1:] > offsets[:-1])
    return np.flatnonzero(start), unsure


class _Memory:
    """Numbered strings and their ids."""

    def __init__(self, dtype: np.dtype):
        self.number: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.ids = np.empty(0, dtype)
        self.start = self.length = np.empty(0, np.int64)

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """(numbers, strings that are new, their numbers); new ones wait for ``add``."""
        known = len(self.number)
        found = np.fromiter(map(self.number.__getitem__, texts), np.int64, len(texts))
        new = list(islice(self.number, known, None)) if len(self.number) > known else []
        self.start, self.length = (np.concatenate((x, np.zeros(len(new), np.int64))) for x in (self.start, self.length))
        return found, new, np.arange(known, known + len(new))

    def add(self, numbers: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.start[numbers] = len(self.ids) + np.cumsum(lengths) - lengths
        self.length[numbers] = lengths
        self.ids = np.concatenate((self.ids, ids))

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, how many of each)."""
        length = self.length[numbers]
        ends = np.cumsum(length)
        return self.ids[np.repeat(self.start[numbers] - ends + length, length) + np.arange(length.sum())], length


class Encoder:
    """Ids of texts, as little-endian integers of ``dtype``. Only for byte-level vocabularies.

    Special tokens in a text become their own ids, as the library does by default.
    """

    def __init__(self, name: str = TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.by_space = (Tokenizer.from_file(tokenizer_path(name)) for _ in range(2))
        # The same model for strings in which a space begins each pre-token and stands nowhere else.
        self.by_space.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocab = self.tokenizer.get_vocab()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for token, i in vocab.items() if token.startswith(_SPACE_MARK)]] = True
        self.end = np.array([END], self.dtype).tobytes()
        self.memory = _Memory(self.dtype)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, how many of each)."""
        found = [np.asarray(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, self.dtype), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def _opened(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pre-tokens that begin with their only space."""
        ids, lengths = [np.empty(0, self.dtype)], [np.empty(0, np.int64)]
        for i in range(0, len(texts), _JOINED):
            joined = b"".join(texts[i : i + _JOINED]).decode()
            ids.append(np.asarray(self.by_space.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype))
            lengths.append(np.diff(np.flatnonzero(self.opens[ids[-1]]), append=len(ids[-1])))
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, new: list[bytes], numbers: np.ndarray) -> None:
        spaced = np.fromiter((p[0] == 0x20 and p.count(b" ") == 1 and len(p) > 1 for p in new), bool, len(new))
        self.memory.add(numbers[spaced], *self._opened([new[i] for i in np.flatnonzero(spaced).tolist()]))
        self.memory.add(numbers[~spaced], *self._plain([new[i].decode() for i in np.flatnonzero(~spaced).tolist()]))

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Packed ids of each text, without an end id; null is empty."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        return [ids for i, j, data, offsets in K.text_slices(texts, SLICE) for ids in self.encode_slice(texts.slice(i, j - i), data, offsets)]

    def encode_slice(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Packed ids of ``texts``, whose bytes are ``data``; memory follows ``data``."""
        if len(self.memory.number) > MEMORY:
            self.memory = _Memory(self.dtype)
        start, odd = pre_tokens(data, offsets)
        for token in self.special:
            odd |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        doc = np.searchsorted(offsets, start, "right") - 1
        ends = np.append(start, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        if odd.any():
            usual = ~odd[doc]
            pieces, doc = pieces.filter(pa.array(usual)), doc[usual]
        pieces = pieces.dictionary_encode()
        numbers, new, at = self.memory.numbers(pieces.dictionary.to_pylist())
        if new:
            self._learn(new, at)
        ids, lengths = self.memory.gather(numbers[pieces.indices.to_numpy()])
        bounds = np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(doc, np.arange(len(offsets)))] * self.dtype.itemsize
        raw, bounds = ids.tobytes(), bounds.tolist()
        out = [raw[s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._plain([texts[i].as_py()])[0].tobytes()
        return out


def encoder(name: str = TOKENIZER) -> Encoder:
    key = (name, os.getpid())
    if key not in _encoders:
        _encoders[key] = Encoder(name)
    return _encoders[key]


def encoded(column: pa.Array, name: str = TOKENIZER, limit: int = SLICE) -> Iterator[tuple[int, bytes]]:
    """(row, packed ids with the end id) of each text of a column, a few megabytes at a time; null is empty."""
    enc = encoder(name)
    for i, j, data, offsets in K.text_slices(column, limit):
        for k, ids in enumerate(enc.encode_slice(column.slice(i, j - i), data, offsets)):
            yield i + k, ids + enc.end
    pa.default_memory_pool().release_unused()


def forget(name: str = TOKENIZER) -> None:
    """Drop what this process remembers: a worker that waits for its next task, or runs one of another stage, holds it for nothing."""
    enc = encoder(name)
    enc.memory = _Memory(enc.dtype)
    pa.default_memory_pool().release_unused()
