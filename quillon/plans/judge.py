"""Verdicts of a text model on statements, which fail closed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import first_json_object

# The fields that a verdict must have, in this order, and words of replies in prose.
FIELDS = ("is_safe", "security_issues", "confidence_level", "explanation")
UNSAFE_WORDS = ("not safe", "unsafe", "vulnerability", "issue")


def replies(df: DataFrame, sql_col: str, model, role: str = "security", schema: str = "No schema context provided") -> DataFrame:
    """df with `reply` and `failure`: what the model (a TextModel, which goes to the tasks) says to each statement, or why it said nothing. Equal
    statements of a batch are asked about once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known: dict = {}
            for sql in pdf[sql_col]:
                if sql not in known:
                    try:
                        known[sql] = (model.complete(role, f"{schema}\n\n{sql}") if sql is not None else None, None if sql is not None else "no statement")
                    except Exception as e:  # whatever a model raises is no verdict
                        known[sql] = (None, str(e) or type(e).__name__)
            yield pdf.assign(reply=[known[s][0] for s in pdf[sql_col]], failure=[known[s][1] for s in pdf[sql_col]])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{kinds}, reply string, failure string")


def verdict(reply: Column, failure: Column) -> Column:
    """A struct of is_safe, confidence, issues and explanation. Of a reply the first JSON object counts, which must have all FIELDS. Broken JSON, missing fields,
    no reply and failures are unsafe; a reply in prose (without a brace) is safe if it holds none of UNSAFE_WORDS."""
    said = first_json_object(reply)
    keys = F.json_object_keys(said)
    missing = F.coalesce(*(F.when(~F.array_contains(keys, f), f) for f in FIELDS))
    low = F.lower(reply)
    bad = F.array(*(F.contains(low, F.lit(w)) for w in UNSAFE_WORDS))
    sure = F.when(F.contains(low, F.lit("high")) & F.contains(low, F.lit("confidence")), "high").when(F.contains(low, F.lit("medium")) & F.contains(low, F.lit("confidence")), "medium").otherwise("low")

    def told(safe: Column, confidence: Column, issues: Column, why: Column) -> Column:
        return F.struct(F.coalesce(safe, F.lit(False)).alias("is_safe"), confidence.alias("confidence"), issues.cast("string").alias("issues"), why.cast("string").alias("explanation"))

    field = lambda f: F.get_json_object(said, f"$.{f}")
    unread = "Could not parse security analysis from LLM response"  # fixed value
    return (
        F.when(failure.isNotNull() | reply.isNull(), told(F.lit(False), F.lit("low"), F.lit("Analysis error occurred"), failure))
        .when(F.contains(reply, F.lit("{")) & keys.isNull(), told(F.lit(False), F.lit("low"), F.lit(unread), F.lit(None)))
        .when(said.isNotNull() & missing.isNotNull(), told(F.lit(False), F.lit("low"), F.concat(F.lit("Missing field: "), missing), F.lit(None)))
        .when(said.isNotNull(), told(F.lower(field("is_safe")) == "true", F.coalesce(field("confidence_level"), F.lit("low")), field("security_issues"), field("explanation")))
        .otherwise(told(~F.exists(bad, lambda x: x), sure, F.lit(unread), F.lit(None)))
    )


def judged(df: DataFrame, sql_col: str, model, **how) -> DataFrame:
    """df with is_safe, confidence, issues and explanation of each statement, by a model."""
    asked = replies(df, sql_col, model, **how).withColumn("__v", verdict(F.col("reply"), F.col("failure")))
    return asked.select(*df.columns, "__v.is_safe", "__v.confidence", "__v.issues", "__v.explanation")
