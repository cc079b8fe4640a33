"""Embeddings: an interface, and a deterministic provider without a network."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.batches import bounded


class EmbeddingProvider(Protocol):
    def embed(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame: ...


class HashingProvider:
    """Signed counts of hashed words, scaled to unit length; null and blank texts have none."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        import zlib

        bounded(df.sparkSession)
        n, word = self.dimensions, re.compile(r"\w+")

        @F.pandas_udf("array<float>")
        def run(texts: pd.Series) -> pd.Series:
            def one(text: str | None):
                if text is None or not text.strip():
                    return None
                v = np.zeros(n)
                for w in word.findall(text.lower()):
                    h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                    v[(h >> 1) % n] += 1 if h & 1 else -1
                size = np.linalg.norm(v)
                return (v / size if size else v).astype(np.float32)

            return texts.map(one)

        return df.withColumn(out_col, run(F.col(text_col)))


#: Words: runs of digits, letters and all beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Buckets(dict):
    """One of BUCKETS for a word: the first 16 bits of the MD5 of it with A-Z in lower case. Words repeat, so those met first are kept,
    up to `most` of them."""

    def __init__(self, most: int = 1 << 18):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        low = word.lower() if word.isascii() else word.translate(LOWER)
        found = int.from_bytes(hashlib.md5(low.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()[:2], "big")
        if len(self) < self.most:
            self[word] = found
        return found

    def of(self, text: str | None) -> list[int]:
        """Those of a text's words, in their order."""
        return list(map(self.__getitem__, WORD.findall(text))) if text else []


BUCKETS = 1 << 16


class FittedProvider:
    """Weighted counts of hashed words: rare words of the corpus that it was fitted on count more (inverse document frequency). The model is a table of
    BUCKETS rows at most, (bucket, documents) and (-1, all documents), so models of parts of a corpus are merged by adding. Scaled to
    unit length; null texts and texts without words have no vector."""

    def __init__(self, model: DataFrame, dimensions: int = 64):
        self.model, self.dimensions = model, dimensions
        self._held: np.ndarray | None = None

    @classmethod
    def fit(cls, corpus: DataFrame, text_col: str, dimensions: int = 64) -> FittedProvider:
        """Counts over all texts with a word: a task sums up its own texts, which are read once, and sends BUCKETS + 1 rows at most."""
        bounded(corpus.sparkSession)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            buckets, seen = Buckets(), np.zeros(BUCKETS + 1, np.int64)  # the last place: texts with a word
            for batch in batches:
                for text in batch.column(0):
                    if own := buckets.of(text.as_py()):
                        seen[[*set(own), BUCKETS]] += 1
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(at == BUCKETS, -1, at), pa.int32()), pa.array(seen[at])], ["bucket", "documents"])

        each = corpus.select(text_col).mapInArrow(count, "bucket int, documents long")
        return cls(each.groupBy("bucket").agg(F.sum("documents").alias("documents")), dimensions)

    def merge(self, other: FittedProvider) -> FittedProvider:
        both = self.model.unionByName(other.model).groupBy("bucket").agg(F.sum("documents").alias("documents"))
        return FittedProvider(both, self.dimensions)

    def save(self, path: str) -> None:
        self.model.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, dimensions: int = 64) -> FittedProvider:
        return cls(spark.read.parquet(path), dimensions)

    def weights(self) -> DataFrame:
        """(bucket, documents, weight): ln((1 + N) / (1 + n)) + 1."""
        n = self.model.where("bucket = -1").select(F.col("documents").alias("n"))  # one row
        total = n.first()
        share = F.lit(1.0 + (total[0] if total else 0)) / (1.0 + F.col("documents"))
        return self.model.where("bucket >= 0").select("bucket", "documents", (F.ln(share) + 1.0).alias("weight"))

    def _weight(self) -> np.ndarray:
        """The weight of each bucket, gathered once: what is embedded later doesn't fit the model again."""
        if self._held is None:
            rows = self.model.collect()  # at most BUCKETS + 1
            model = self.model.sparkSession.createDataFrame(rows, self.model.schema)
            found = {r["bucket"]: r["weight"] for r in FittedProvider(model).weights().collect()}
            weight = np.full(BUCKETS, max(found.values(), default=1.0))  # words that no text had are as rare as the rarest
            weight[list(found)] = list(found.values())
            self._held = weight
        return self._held

    def embed(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        bounded(df.sparkSession)
        weight, n = self._weight(), self.dimensions

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            buckets = Buckets()

            def one(text: str | None):
                if not (own := buckets.of(text)):
                    return None
                b = np.asarray(own, np.int64)
                v = np.bincount((b >> 1) % n, weight[b] * np.where(b & 1, 1.0, -1.0), n)
                size = np.linalg.norm(v)
                return (v / size if size else v).astype(np.float32)

            for texts in batches:
                yield texts.map(one)

        return df.withColumn(out_col, run(F.col(text_col)))


PROVIDERS = {"hashing": HashingProvider, "fitted": FittedProvider}


def provider(name: str = "hashing", **options) -> EmbeddingProvider:
    """The provider of a name; unknown names are errors."""
    if name.lower() not in PROVIDERS:
        raise ValueError(f"unknown embedding provider: {name} (there are {', '.join(PROVIDERS)})")
    return PROVIDERS[name.lower()](**options)
