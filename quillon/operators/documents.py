"""Documents on their way into a collection: checks, metadata, chunks, upserts."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, non_empty

EXTENSIONS = ("txt", "pdf", "docx", "html", "md")
MAX_BYTES = 100 * 1024 * 1024
SIZE, OVERLAP = 1000, 100
SEPARATORS = ("\n\n", "\n", " ", "")


def upload_reason(name: Column, size: Column, limit: int = MAX_BYTES) -> Column:
    """Why an upload is refused, or null."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(~ext.isin(*EXTENSIONS), "extension not allowed").when(size > limit, "file too large")


def fill_metadata(df: DataFrame) -> DataFrame:
    """Missing or empty source, title and upload_method filled in."""
    return df.withColumns({
        "source": F.coalesce(non_empty(F.col("source")), F.lit("unknown")),
        "title": F.coalesce(non_empty(F.col("title")), non_empty(F.col("source")), F.lit("Untitled Document")),
        "upload_method": F.coalesce(non_empty(F.col("upload_method")), F.lit("Local")),
    })


def override_metadata(df: DataFrame, name: Column, method: str = "Web upload") -> DataFrame:
    """Metadata of an upload: name, method, path and file id, whatever was there."""
    return df.withColumns({"source": name, "title": name, "upload_method": F.lit(method), "stored_file_path": F.concat(F.lit("uploads/"), F.col("file_id"), F.lit("/"), name)})


def directory_metadata(df: DataFrame, path: Column) -> DataFrame:
    return df.withColumns({"source": basename(path), "title": basename(path), "upload_method": F.lit("Local")})


def split_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most size characters, cut at the coarsest separator that serves, each beginning with the last whole pieces
    of the one before that fit into overlap; where no separator serves, pieces are single characters. Null and blank texts give none."""

    def pieces(part: str, seps: tuple[str, ...]) -> list[str]:
        """Parts of at most size characters that make up the text, each with the separator behind it."""
        if len(part) <= size:
            return [part]
        sep, rest = next(((s, seps[i + 1 :]) for i, s in enumerate(seps) if s and s in part), ("", ()))
        if not sep:
            return list(part)
        bits = part.split(sep)
        bits = [b + sep for b in bits[:-1]] + [bits[-1]]
        return [x for b in bits if b for x in pieces(b, rest)]

    if text is None or not text.strip():
        return []
    out, now, length = [], deque(), 0
    for p in pieces(text, separators):
        if length + len(p) > size and now:
            out.append("".join(now))
            while now and (length > overlap or length + len(p) > size):
                length -= len(now.popleft())
        now.append(p)
        length += len(p)
    return [*out, "".join(now)]


def chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk, content): a row for each chunk of each text, numbered from 0; other columns stay."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap))

    kept = [c for c in df.columns if c != text_col]
    return df.select(*kept, F.posexplode(cut(F.col(text_col))).alias("chunk", "content"))


def import_chunks(df: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Chunks of JSON documents {document, chunks: [{content, ...}]}: (rows, rejects with one reason each). Every key
    of a chunk stays in the map `extra`."""
    parsed = df.withColumn("__doc", F.from_json(payload, "document string, chunks array<map<string,string>>"))
    reason = F.when(F.col("__doc.document").isNull(), "document is missing").when(F.col("__doc.chunks").isNull(), "chunks are missing")
    reason = reason.when(F.exists("__doc.chunks", lambda c: F.element_at(c, "content").isNull()), "a chunk has no content")
    parsed = parsed.withColumn("reason", reason)
    good = parsed.where("reason is null").select("*", F.posexplode("__doc.chunks").alias("ordinal", "__chunk"))
    rows = good.select(
        *df.drop(payload).columns,
        F.col("__doc.document").alias("document"),
        "ordinal",
        F.col("__chunk")["content"].alias("content"),
        F.coalesce(F.col("__chunk")["section"], F.lit("")).alias("section"),
        F.coalesce(F.col("__chunk")["title"], F.col("__doc.document")).alias("title"),
        F.coalesce(F.col("__chunk")["chunk_id"].cast("int"), F.col("ordinal")).alias("chunk_id"),
        F.map_filter("__chunk", lambda k, v: ~k.isin("content", "section", "title", "chunk_id")).alias("extra"),
    )
    return rows, parsed.where("reason is not null").select(*df.columns, "reason")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with rows of new in place of those of equal key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def deduplicated(df: DataFrame) -> DataFrame:
    """One row for each (content, source, title, url), with its smallest ordinal and an id derived from the four."""
    four = ["content", "source", "title", "url"]
    ident = F.sha2(F.concat_ws("\x1f", *(F.coalesce(c, F.lit("\x00")) for c in four)), 256)  # a null differs from an empty text
    return df.groupBy(*four).agg(F.min("ordinal").alias("ordinal")).withColumn("id", ident)
