"""Tolerant JSON: fences, prose around it, truncation."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*(?:```|$)", re.DOTALL)


def repair(text: str | None) -> str | None:
    """Valid JSON for the first object or array a text holds, closed where it was cut off; null if there is none."""
    if not text:
        return None
    if m := _FENCE.search(text):
        text = m[1]
    starts = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    if not starts:
        return None
    text = text[min(starts) :]
    stack, quoted, escaped, safe = [], False, False, []
    for i, c in enumerate(text):
        if quoted:
            escaped = c == "\\" and not escaped
            if c == '"' and not escaped:
                quoted = False
            continue
        if c == '"':
            quoted, escaped = True, False
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if stack:
                stack.pop()
            if not stack:
                try:
                    return json.dumps(json.loads(text[: i + 1]), ensure_ascii=False)
                except ValueError:
                    return None
        elif c == ",":
            safe.append((i, list(stack)))
    whole = text + ('"' if quoted else "")
    for body, ends in [(whole.rstrip().rstrip(","), stack), *((text[:i], s) for i, s in reversed(safe))]:
        try:
            return json.dumps(json.loads(body + "".join(reversed(ends))), ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def repair_udf(text: pd.Series) -> pd.Series:
    return text.map(repair)


def tolerant(c: Column) -> Column:
    """The text itself where it is valid JSON, else repaired in Python."""
    return F.when(F.try_parse_json(c).isNotNull(), c).otherwise(repair_udf(c))
