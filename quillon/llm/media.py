"""Media columns: bytes stored as progressive JPEG, and JPEG columns as RGB tensors."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .util import lean, texts_of, tune


def padded(text: str) -> bytes:
    """UTF-8 with zeros up to a positive multiple of 64."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)


def features(tensor: np.ndarray) -> str:
    """Height, width, and each channel's mean and deviation in hundredths."""
    flat = tensor.reshape(-1, 3)
    n = len(flat)
    total = flat.sum(axis=0, dtype=np.int64)
    square = np.array([np.dot(c, c) for c in np.ascontiguousarray(flat.T).astype(np.float64)])
    mean = total / n
    dev = np.sqrt(np.maximum(square / n - mean * mean, 0))
    return f"{tensor.shape[0]}x{tensor.shape[1]}:" + ",".join(f"{m:.2f}/{d:.2f}" for m, d in zip(mean, dev))


def decode_images(df: DataFrame, media_col: str = "media", id_col: str = "doc_id", max_pixels: int = 1 << 26) -> DataFrame:
    """A column of progressive JPEG files as full-resolution RGB tensors: doc_id, height, width, tensor (bytes,
    row by row, three to a pixel), error.

    Null media give null tensors; files that can't be read, and those whose header states more than max_pixels (nothing is
    allocated for them), give null tensors and a message, and the rest go on. Repeated rows stay; other columns are not read."""
    tune(df.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, data in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist()):
                h = w = raw = err = None
                if data is not None:
                    try:
                        t = jpeg.rgb(jpeg.decode(data, max_pixels))
                        h, w, raw = t.shape[0], t.shape[1], t.tobytes()
                    except (ValueError, IndexError, KeyError, OverflowError, TypeError, ZeroDivisionError, struct.error) as e:
                        err = str(e) or type(e).__name__
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc], pa.int64()), pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([raw], pa.binary()), pa.array([err], pa.string())],
                    ["doc_id", "height", "width", "tensor", "error"],
                )

    named = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"))
    return named.mapInArrow(run, "doc_id long, height int, width int, tensor binary, error string")


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text as a progressive JPEG that holds its padded bytes: doc_id, n_bytes, media.

    Null texts count as empty (64 zeros). Null and repeated ids stay rows; other columns are not read."""
    tune(df.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, texts = b.column("doc_id"), texts_of(b, "text")
            for first in range(0, len(texts), 256):
                some = texts[first : first + 256]
                sizes = [len(t.encode("utf-8", "surrogatepass")) for t in some]
                media = pa.array([jpeg.store(padded(t)) for t in some], pa.binary())
                yield pa.RecordBatch.from_arrays([docs.slice(first, len(some)), pa.array(sizes, pa.int64()), media], ["doc_id", "n_bytes", "media"])

    named = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_stored(df: DataFrame) -> DataFrame:
    """What store_texts() stored, read back from the media bytes: payload digests and image features."""
    tune(df.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column("media"):
                data = data.as_py()
                frame = jpeg.decode(data)
                payload = jpeg.payload_of(frame)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(jpeg.rgb(frame))))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, types))], names)

    return df.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
