"""Token ids in binary shards of shuffled planes.

A shard holds whole documents. Its ids are cut into blocks of fixed size, each block is transposed
into byte planes (or bit planes), each plane is compressed by zstandard on its own, and an index of
blocks and planes stands at the end, so that a block can be read without its neighbours::

    "QPS1" | planes of block 0 | planes of block 1 | ... | directory | index | footer

    directory  zstandard of: doc ids int64, their validity uint8, their lengths uint64
    index      for each block: offset uint64, ids uint32, bytes of each plane uint32
    footer     offsets of directory and index uint64, documents uint64, blocks, block size,
               planes, bits of a plane (1 or 8) uint32, "QPS1"

Shards are rows of a Parquet table: Spark's committer then makes the output atomic on any store, and a
task that is run again leaves nothing behind. Rows are (segment, start, n_ids, shard); segments
follow the order of ids and start counts the ids before the shard inside its segment.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .util import crc_le32, lean, tokenizer_path, tune, written
from .wordcodec import codec

MAGIC = b"QPS1"
FOOTER = struct.Struct("<QQQIIII4s")
BLOCK = 1 << 14
#: Ids after which a shard is closed.
SHARD = 1 << 18
STORE_SCHEMA = "segment int, start long, n_ids long, n_docs int, shard binary"


def _to_planes(ids: np.ndarray, bits: int) -> np.ndarray:
    """uint32 ids as planes, the lowest first; the rows are planes."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return np.ascontiguousarray(raw.T)
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")


def _from_planes(planes: np.ndarray, n: int, bits: int) -> np.ndarray:
    if bits == 8:
        raw = np.ascontiguousarray(planes.T)
    else:
        raw = np.packbits(np.unpackbits(planes, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def pack_shard(doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK, bits: int = 8) -> bytes:
    """One shard. bits: 8 for byte planes, 1 for bit planes."""
    squeeze = zstandard.ZstdCompressor(level=3)
    out, index, at = [MAGIC], [], len(MAGIC)
    n_planes = 32 // bits
    for first in range(0, len(ids), block):
        part = ids[first : first + block]
        planes = [squeeze.compress(p.tobytes()) if p.any() else b"" for p in _to_planes(part, bits)]
        index.append(struct.pack(f"<QI{n_planes}I", at, len(part), *map(len, planes)))
        out += planes
        at += sum(map(len, planes))
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    valid = np.array([d is not None for d in doc_ids], np.uint8)
    directory = squeeze.compress(known.tobytes() + valid.tobytes() + np.asarray(lengths, "<u8").tobytes())
    entries = b"".join(index)
    foot = FOOTER.pack(at, at + len(directory), len(doc_ids), len(index), block, n_planes, bits, MAGIC)
    return b"".join([*out, directory, entries, foot])


class Shard:
    """Reads a shard: its directory, any block, or all ids."""

    def __init__(self, data: bytes):
        self.data = data
        directory, index, n_docs, self.n_blocks, self.block, self.n_planes, self.bits, magic = FOOTER.unpack(data[-FOOTER.size :])
        if magic != MAGIC or data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard")
        self.open = zstandard.ZstdDecompressor()
        raw = self.open.decompress(data[directory:index])
        self.doc_ids = [d if v else None for d, v in zip(np.frombuffer(raw, "<i8", n_docs).tolist(), raw[8 * n_docs : 9 * n_docs])]
        self.lengths = np.frombuffer(raw, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        entry = struct.Struct(f"<QI{self.n_planes}I")
        self.index = [entry.unpack_from(data, index + i * entry.size) for i in range(self.n_blocks)]

    def read(self, i: int) -> np.ndarray:
        at, n, *sizes = self.index[i]
        planes = np.zeros((self.n_planes, (n * self.bits + 7) // 8), np.uint8)
        for k, size in enumerate(sizes):
            if size:
                planes[k] = np.frombuffer(self.open.decompress(self.data[at : at + size]), np.uint8)
            at += size
        return _from_planes(planes, n, self.bits)

    def ids(self) -> np.ndarray:
        return np.concatenate([self.read(i) for i in range(self.n_blocks)]) if self.n_blocks else np.empty(0, np.uint32)


def write_token_store(
    df: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 2,
    spaced: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = BLOCK,
    bits: int = 8,
) -> DataFrame:
    """Encode every text, append end_id, and write shards in ascending order of ids (then of texts).

    Null texts count as empty; a null id comes first and stays null; repeated ids are documents of
    their own, ordered by text; other columns are not read; an empty table gives no shards. The
    texts are dealt out by ranges of ids and encoded there, so that ids are never sorted again.
    """
    path = tokenizer_path(tokenizer)
    tune(df.sparkSession)

    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = codec(path, spaced)
        segment, done = TaskContext.get().partitionId(), 0
        docs, parts, lens, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal docs, parts, lens, size, done
            data = pack_shard(docs, np.concatenate(parts), np.array(lens), block, bits)
            row = pa.RecordBatch.from_arrays(
                [pa.array([segment], pa.int32()), pa.array([done]), pa.array([size]), pa.array([len(docs)], pa.int32()), pa.array([data], pa.binary())],
                ["segment", "start", "n_ids", "n_docs", "shard"],
            )
            done += size
            docs, parts, lens, size = [], [], [], 0
            return row

        for b in batches:
            ids, off = tok.encode(b.column("text"))
            for i, doc in enumerate(b.column("doc_id").to_pylist()):
                docs.append(doc)
                parts += (ids[off[i] : off[i + 1]], np.array([end_id], np.uint32))
                lens.append(int(off[i + 1] - off[i]) + 1)
                size += lens[-1]
                if size >= SHARD:
                    yield close()
        if docs:
            yield close()

    named = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = named.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(encode, STORE_SCHEMA), "tokens", codec="uncompressed")


def read_token_store(store: DataFrame) -> DataFrame:
    """One row per document of a store, read from its shards: doc_id, start, n_tokens, ids_crc32."""

    @lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for segment, start, data in zip(*(b.column(c).to_pylist() for c in ("segment", "start", "shard"))):
                shard = Shard(data)
                ids, ends = shard.ids(), np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([segment] * len(ends), pa.int32()),
                        pa.array(shard.doc_ids, pa.int64()),
                        pa.array(start + starts),
                        pa.array(shard.lengths),
                        pa.array([crc_le32(ids[i:j]) for i, j in zip(starts, ends)], pa.int64()),
                    ],
                    ["segment", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    tune(store.sparkSession)
    sums = store.groupBy("segment").agg(F.sum("n_ids").alias("n"))
    # one row per segment: as many as write tasks
    base = sums.select("segment", (F.sum("n").over(W.orderBy("segment")) - F.col("n")).alias("base"))
    docs = store.select("segment", "start", "shard").mapInArrow(read, "segment int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return docs.join(base, "segment").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
