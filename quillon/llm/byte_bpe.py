"""Byte-level BPE by tiktoken and a local rank file, and its inverse on raw bytes."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import lean, texts_of, tokenizer_path, tune

#: Longer texts are split before encoding.
LONG = 1 << 16
#: A space between a visible ASCII character and an ASCII letter: no match of the pattern crosses the
#: place before it.
SAFE = re.compile(r"(?<=[!-~])(?= [A-Za-z])")

_encodings: dict = {}


def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file, one per worker process."""
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def split_safely(text: str, size: int = LONG) -> list[str]:
    """Parts of about size characters, cut at safe places only; their ids follow one another."""
    parts, at = [], 0
    while len(text) - at > size:
        m = SAFE.search(text, at + size)
        if m is None:
            break
        parts.append(text[at : m.start()])
        at = m.start()
    return [*parts, text[at:]]


def encode(enc, text: str) -> list[int]:
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    return [i for part in split_safely(text) for i in enc.encode_ordinary(part)]


def bpe_encode(df: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text, each match of the pattern encoded separately.

    Null texts count as empty and give no ids; ids of documents may be null or repeated, every row
    stays a row; other columns are not read; an empty table stays empty.
    """
    import public_tokenizers

    path, pattern = tokenizer_path(ranks), pattern or public_tokenizers.PATTERN
    tune(df.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([encode(enc, t) for t in texts_of(b, "text")], pa.list_(pa.int32()))], ["doc_id", "ids"])

    named = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(df: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) with a column decoded: the raw bytes that the ids stand for, valid UTF-8 or not.
    Null ids give null bytes."""
    import public_tokenizers

    path, pattern = tokenizer_path(ranks), pattern or public_tokenizers.PATTERN
    tune(df.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            raw = [None if ids is None else enc.decode_bytes(ids) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(raw, pa.binary())], ["doc_id", "ids", "decoded"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def bpe_digests(df: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """bpe_encode, then bpe_decode, as digests: doc_id, n_tokens, ids_sha256 (of little-endian unsigned
    32-bit ids), decoded_sha256. Fused in one pass, so that ids don't travel."""
    import public_tokenizers

    path, pattern = tokenizer_path(ranks), pattern or public_tokenizers.PATTERN
    tune(df.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            n, said, back = [], [], []
            for t in texts_of(b, "text"):
                ids = encode(enc, t)
                n.append(len(ids))
                said.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(said), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    named = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
