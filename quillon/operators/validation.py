"""Input checks by field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def errors(fields: dict[str, Column], schema: dict[str, dict]) -> Column:
    """A map from each failing field to its error. A missing (null) field fails only if it is required; else minimum length,
    maximum length, minimum value and maximum value are checked, and the last failure counts."""
    out = []
    for name, c in fields.items():
        rules = schema.get(name, {})
        failed = F.lit(None).cast("string")
        tests = (
            ("min_length", lambda v, c=c: F.length(c) < v, "Minimum length is"),
            ("max_length", lambda v, c=c: F.length(c) > v, "Maximum length is"),
            ("min_value", lambda v, c=c: c < v, "Minimum value is"),
            ("max_value", lambda v, c=c: c > v, "Maximum value is"),
        )
        for rule, bad, says in tests:
            if rule in rules:
                failed = F.when(bad(rules[rule]), f"{says} {rules[rule]}").otherwise(failed)
        if rules.get("required"):
            failed = F.when(c.isNull(), "Field is required").otherwise(failed)
        out += [F.lit(name), failed]
    return F.map_filter(F.create_map(*out), lambda k, v: v.isNotNull())
