"""JSON inside text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def first_object(text: str | None) -> str | None:
    """From the first opening brace to its closing one; null without either. Braces inside JSON strings don't count."""
    if text is None or (start := text.find("{")) < 0:
        return None
    depth, quoted, skip = 0, False, False
    for i in range(start, len(text)):
        ch = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = True
        elif ch == "{":
            depth += 1
        elif ch == "}":
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def _first_series(text: pd.Series) -> pd.Series:
    return text.map(first_object)


def first_json_object(c: Column) -> Column:
    """Balanced braces are no regular language: this is Arrow-batched Python."""
    return F.pandas_udf(_first_series, "string")(c)


def probe(c: Column, *paths: str) -> Column:
    """The value at the first path that there is."""
    return F.coalesce(*(F.get_json_object(c, p) for p in paths))
