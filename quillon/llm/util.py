"""Helpers shared by the operators: shared scratch tables, batching, hashing of ids."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch, so that long texts can't fill a Python worker.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20

_made: list[tuple[SparkSession, str]] = []


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers receive."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, which gives freed memory back to the system at its end: workers live on between stages, several to an
    executor."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return whole


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not with every C library
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where spark.checkpoint.dir is unset, a temporary one is made on a local
    master; on a cluster, whose executors would each see a folder of their own, an error is raised."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if (ctx := spark.sparkContext.getCheckpointDir()) is not None:
        return ctx.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="quillon-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


@atexit.register
def _clean() -> None:
    """Delete the tables written by this process, when its session still lives."""
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session has gone; the folder's owner clears it
            return


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends there, and a lost executor
    costs no recomputation of what stands before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def nameless(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with its columns named by place (no helper column can clash with those), and these names."""
    names = [f"column {k}" for k in range(len(df.columns))]
    return df.toDF(*names), names


def crc_mod(id_col: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string")) % F.lit(n)


def hash_below(column: str, share):
    """Rows whose hash of a column lies in the lowest share (0 to 1, a number or Column) of all hashes."""
    return F.xxhash64(column).cast("double") < (share * 2.0**64 - 2.0**63)


def first_by_hash(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n different values of a column whose hashes come first (ties by value), as a bounded sample. Rows are counted, and
    only the lowest hashes, about 2 n rows, are sorted, so that tasks don't each send n rows."""
    rows = df.count()
    if rows > 2 * n:
        df = df.where(hash_below(column, 2 * n / rows))
    return df.select(column).distinct().orderBy(F.xxhash64(column), column).limit(n)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def gather(flat: np.ndarray, off: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows idx of a ragged array, one after the other, and the offsets of those rows."""
    lens = off[idx + 1] - off[idx]
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(off[idx] - (ends - lens), lens)
    at += np.arange(total)
    return flat[at], np.concatenate(([0], ends))


def crc_le32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def schema_of(*fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in fields])


def tokenizer_path(name: str) -> str:
    """A path is taken as it is; a bare name is looked up among the installed public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
