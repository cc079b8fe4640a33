"""Bounds for what Python workers hold."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch, so that neither many nor long texts fill a Python worker.
ROWS, BYTES = 1000, 4 << 20


def bounded(spark: SparkSession | None = None) -> None:
    """Bounds the session's Arrow batches; smaller bounds that were set stay."""
    spark = spark or SparkSession.active()
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)):
        if not 0 < _number(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def _number(text: str) -> int:
    """A setting's number, in bytes where it has that unit; one with a larger unit counts as unbounded."""
    text = text.removesuffix("b")
    return int(text) if text.isdecimal() else 0
