"""Changing texts by decisions that are computed elsewhere, without sending plain text through shuffles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import lean, tune

#: Columns that may not exist in input tables.
KEY, PACKED, SPEC = "__key", "__packed", "__spec"


def key_of(raw: bytes) -> int:
    """64 bits of a text. Rows that agree in id and text are one document here, and fare alike."""
    return xxhash.xxh64_intdigest(raw, 7) - (1 << 63)


def raw_text(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def ddl(df: DataFrame, *without: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in without)


def pack_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the text compressed (null stays null) in place of the plain one, and its key."""
    tune(df.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            raws = [None if t is None else raw_text(t) for t in b.column(text_col).to_pylist()]
            rest = [n for n in b.schema.names if n != text_col]
            keys = pa.array([key_of(r or b"") for r in raws], pa.int64())
            packed = pa.array([None if r is None else squeeze.compress(r) for r in raws], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), keys, packed], [*rest, KEY, PACKED])

    rest = ddl(df, text_col)
    return df.mapInArrow(run, rest + ", " * bool(rest) + f"{KEY} long, {PACKED} binary")


def unpacked(col: pa.Array) -> list[bytes]:
    """Raw texts of packed ones; null gives nothing."""
    loose = zstandard.ZstdDecompressor()
    return [b"" if x is None else loose.decompress(x) for x in col.to_pylist()]


def with_spec(packed: DataFrame, specs: DataFrame, id_col: str) -> DataFrame:
    """packed with the column __spec of specs (__id, __key, __spec: binary, a row for each changed document)."""
    by = specs.select(F.col("__id"), F.col(KEY).alias("__of"), SPEC)
    return packed.join(by, packed[id_col].eqNullSafe(by["__id"]) & (packed[KEY] == by["__of"]), "left").drop("__id", "__of")


def rewritten(df: DataFrame, specs: DataFrame, change: Callable[[bytes, bytes], bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the texts that have a spec changed by change(text, spec); columns and their order stay. A column
    n_chars follows the new text."""
    joined = with_spec(pack_texts(df, text_col), specs, id_col)
    names = df.columns

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: list[str | None] = []
            for raw, packed, spec in zip(unpacked(b.column(PACKED)), b.column(PACKED), b.column(SPEC).to_pylist()):
                new = raw if spec is None else change(raw, spec)
                texts.append(new.decode("utf-8", "surrogatepass") if packed.is_valid else None)
            cols = {n: b.column(n) for n in names if n != text_col} | {text_col: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    out = joined.mapInArrow(run, ddl(df))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(df.schema["n_chars"].dataType))
    return out
