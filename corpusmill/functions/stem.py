"""Porter's stemmer (1980), applied to distinct terms and joined back."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, StringType

_C, _V = "[^aeiou]", "[aeiouy]"
_CC, _VV = f"{_C}[^aeiouy]*", f"{_V}[aeiou]*"
_M1 = re.compile(f"^({_CC})?{_VV}{_CC}")
_M1_ONLY = re.compile(f"^({_CC})?{_VV}{_CC}({_VV})?$")
_M2 = re.compile(f"^({_CC})?{_VV}{_CC}{_VV}{_CC}")
_HAS_VOWEL = re.compile(f"^({_CC})?{_V}")
_CVC = re.compile(f"^{_CC}{_V}[^aeiouwxy]$")
_DOUBLE = re.compile(r"([^aeiouylsz])\1$")

# The suffixes of the published algorithm.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al",
    "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _swap(word: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            return base + table[suffix] if _M1.match(base) else word
    return word


def stem(word: str) -> str:
    if len(word) < 3:
        return word
    first_y = word[0] == "y"
    w = "Y" + word[1:] if first_y else word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _M1.match(w[:-3]) else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix):
                base = w[: -len(suffix)]
                if _HAS_VOWEL.match(base):
                    w = base
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _DOUBLE.search(w):
                        w = w[:-1]
                    elif _M1_ONLY.match(w) and _CVC.match(w) or _CVC.match(w):
                        w += "e"
                break
    if w.endswith("y") and _HAS_VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2), _STEP3)
    for suffix in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _M2.match(base) and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _M2.match(base) or _M1_ONLY.match(base) and not _CVC.match(base):
            w = base
    if w.endswith("ll") and _M2.match(w[:-1]):
        w = w[:-1]
    return "y" + w[1:] if first_y else w


@pandas_udf(StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    return words.map(stem)


def stemmed(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the stems of a column's terms: each distinct term is stemmed once."""
    known = rows.select(column).where(f"{column} IS NOT NULL").distinct().withColumn("_stem", stem_udf(column))
    return rows.join(known, column).withColumn(column, known["_stem"]).drop("_stem")


_stems: dict[str, str] = {}


def kept_stem(word: str) -> str:
    """``stem``, remembered for a million words at once."""
    if len(_stems) > 1_000_000:
        _stems.clear()
    found = _stems.get(word)
    if found is None:
        found = _stems[word] = stem(word)
    return found


def _stem_lists(lists: pa.Array) -> pa.Array:
    codes = lists.flatten().dictionary_encode()
    stems = pa.array([s if len(s := kept_stem(w)) >= 2 else None for w in codes.dictionary.to_pylist()], pa.string())
    flat = stems.take(codes.indices)
    counts = np.concatenate(([0], np.cumsum(flat.is_valid().to_numpy(zero_copy_only=False))))
    ends = lists.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(counts[ends - ends[0]].astype(np.int32)), flat.drop_null())


@arrow_udf(ArrayType(StringType()))
def stem_lists(lists: pa.Array) -> pa.Array:
    """The stems of lists of terms, those under two characters left out; each distinct term of a batch is stemmed once."""
    from corpusmill.functions import stem as here

    return here._stem_lists(lists)
