"""Removal of repeated multi-line chunks.

A text's lines are hashed; a rolling hash over the last three line hashes cuts chunks where it is divisible by a small
number. Cuts depend on these lines only, so an insertion moves no cut but its neighbours', and a passage
of several lines falls into the same chunks wherever it stands. Chunks of two or more lines that occur again
anywhere, in the same text or another, are removed: the first (by document id, then place) stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rewrite import KEY, PACKED, SPEC, key_of, pack_texts, raw_text, rewritten, unpacked, with_spec
from .util import lean, tune, written

#: A chunk ends where the rolling hash is divisible by this: its mean length in lines.
DIVISOR = 3
#: The rolling hash: line hashes times powers of a base, from the newest back, modulo a prime.
ROLLED, BASE, PRIME = 3, 1_000_003, 4_294_967_291


def line_hash(line: bytes) -> int:
    """The first 32 bits of the MD5."""
    return int.from_bytes(hashlib.md5(line).digest()[:4], "big")


def chunks(raw: bytes, divisor: int = DIVISOR) -> list[list[bytes]]:
    """The lines of each chunk."""
    out: list[list[bytes]] = [[]]
    last = [0] * ROLLED
    rolled, oldest = 0, BASE ** (ROLLED - 1)
    for i, line in enumerate(raw.split(b"\n")):
        h = line_hash(line)
        rolled = ((rolled - last[i % ROLLED] * oldest) * BASE + h) % PRIME
        last[i % ROLLED] = h
        out[-1].append(line)
        if rolled % divisor == 0:
            out.append([])
    return out if out[-1] else out[:-1]


def countable(lines: list[bytes]) -> bool:
    """Chunks of one line, and of white space alone, never count as repeated."""
    return len(lines) > 1 and any(line.strip() for line in lines)


def repeated_chunks(df: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """(__id, __key, __spec): of each document with chunks to remove, their numbers. df has doc_id and text.

    Hashes choose the candidates: chunks whose hash occurs again. Only their bytes are gathered, and
    grouped by hash and bytes, so that chunks of equal hash but different bytes stay apart."""
    tune(df.sparkSession)
    own = ["doc_id", KEY, "chunk"]

    @lean
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                raw = raw_text(text)
                if b"\n" not in raw:
                    continue
                key = key_of(raw)
                rows += [(xxhash.xxh64_intdigest(b"\n".join(c)) - (1 << 63), doc, key, i) for i, c in enumerate(chunks(raw, divisor)) if countable(c)]
            cols = list(zip(*rows)) or [()] * 4
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["h", *own])

    @lean
    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, key, raw, wanted in zip(b.column("doc_id").to_pylist(), b.column(KEY).to_pylist(), unpacked(b.column(PACKED)), b.column(SPEC).to_pylist()):
                all_chunks = chunks(raw, divisor)
                for i in sorted(set(wanted)):
                    body = b"\n".join(all_chunks[i])
                    rows.append((xxhash.xxh64_intdigest(body) - (1 << 63), body, doc, key, i))
            cols = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["h", "body", *own])

    found = df.select("doc_id", "text").mapInArrow(hashes, f"h long, doc_id long, {KEY} long, chunk int")
    # written, so that the join below has a shuffle of its own on either side and a hot hash can be split
    again = written(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "hashes")
    wanted = found.join(again, "h").groupBy(F.col("doc_id").alias("__id"), KEY).agg(F.collect_list("chunk").alias(SPEC))
    candidates = with_spec(pack_texts(df.select("doc_id", "text")), wanted, "doc_id").where(F.col(SPEC).isNotNull())
    same = written(candidates.mapInArrow(bodies, f"h long, body binary, doc_id long, {KEY} long, chunk int"), "chunks")
    place = F.struct(*own)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), *own))
    firsts = same.groupBy("h", "body").agg(least.alias("least"))
    firsts = written(firsts.select("h", "body", F.struct(*(F.col("least")[c].alias(c) for c in own)).alias("first")), "firsts")
    shared = firsts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")  # equal hash, different bytes
    plain = same.select("h", *own).join(firsts.select("h", "first").join(shared, "h", "left_anti"), "h")
    apart = same.join(shared, "h", "left_semi").join(firsts, ["h", "body"]).select("h", *own, "first")
    gone = plain.unionByName(apart).where(~place.eqNullSafe(F.col("first")))
    return gone.groupBy(F.col("doc_id").alias("__id"), KEY).agg(F.collect_set("chunk").alias(SPEC))


def without_chunks(raw: bytes, gone: list[int] | None, divisor: int = DIVISOR) -> tuple[bytes, int, int]:
    """The text that stays, its lines before, and the lines removed."""
    all_chunks = chunks(raw, divisor)
    out = set(gone or ())
    kept = [line for i, c in enumerate(all_chunks) if i not in out for line in c]
    n = sum(map(len, all_chunks))
    return b"\n".join(kept), n, n - len(kept)


def repeated_lines(df: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text that stays) for each row of df.

    Null texts have no lines; an empty text has one. Null ids come last in the order of documents; rows
    that repeat id and text are one document and fare alike; rows of equal id and other text are ordered
    by a hash of the text. Other columns are not read; an empty table stays empty."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = with_spec(pack_texts(docs), repeated_chunks(docs), "doc_id")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw, packed, gone in zip(unpacked(b.column(PACKED)), b.column(PACKED), b.column(SPEC).to_pylist()):
                kept, n, removed = without_chunks(raw, gone) if packed.is_valid else (b"", 0, 0)
                rows.append((n, removed, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_lines", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def _change(raw: bytes, gone: list[int]) -> bytes:
    return without_chunks(raw, gone)[0]


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with repeated chunks taken out of its texts; all rows and columns stay."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rewritten(df, repeated_chunks(docs), _change, id_col, text_col)


#: The rows of repeated_lines() over the table documents.
SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), h AS (
  SELECT doc_id, i, line, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM l
), r AS (
  SELECT *, ((h + coalesce(lag(h, 1) OVER w, 0) * 1000003 + coalesce(lag(h, 2) OVER w, 0)::HUGEINT * 1000006000009) % 4294967291) % 3 = 0 AS cut
  FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), c AS (
  SELECT *, coalesce(sum(CAST(cut AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM r
), k AS (
  SELECT doc_id, chunk, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY doc_id, chunk
), m AS (
  SELECT *, n > 1 AND regexp_matches(body, '[^ \\t\\n\\v\\f\\r]') AND row_number() OVER (PARTITION BY body ORDER BY doc_id, chunk) > 1 AS gone FROM k
)
SELECT d.doc_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_lines, CAST(coalesce(sum(n) FILTER (WHERE gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id
"""
