"""JSON out of model replies: as it stands, from a fence, or the first balanced value in the text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)


def _balanced(text: str) -> str | None:
    """The first object or list whose brackets close, strings aside."""
    opens = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    if not opens:
        return None
    depth, quoted, skip = 0, False, False
    for i in range(start := min(opens), len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def rescued(text: str | None) -> str | None:
    """Compact JSON, or None where there is none."""
    if text is None:
        return None
    fenced = _FENCE.search(text)
    for part in (text, fenced[1] if fenced else None, _balanced(text)):
        if part:
            try:
                value = json.loads(part)
            except ValueError:
                continue
            if isinstance(value, dict | list):
                return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return None


@pandas_udf(StringType())
def rescue_json(text: pd.Series) -> pd.Series:
    return text.map(rescued)
