"""Search over vectors: top-k, thresholds, diversity, reranking, and joining hits to their documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import bounded
from ..functions.text import basename
from ..functions.vectors import cosine

K = 5
THRESHOLD = 0.3
#: Cosines that a task of top_k_each holds at once.
TILE = 1 << 19


def scored(corpus: DataFrame, query: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """corpus with the cosine to the one vector of query (a single row; checked, so that broadcasting it is safe)."""
    rows = query.select(F.col(vec_col)).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("one query vector expected")
    q = F.array(*(F.lit(float(x)) for x in rows[0][0])) if rows[0][0] is not None else F.lit(None).cast("array<double>")
    return corpus.withColumn("score", cosine(F.col(vec_col), q))


def top_k(df: DataFrame, k: int = K, id_col: str = "vec_id") -> DataFrame:
    """The k best scores, ties by the smaller id; null scores last. Runs as one pass with a heap per task."""
    return df.orderBy(F.desc_nulls_last("score"), id_col).limit(k)


def over_threshold(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """To be applied after top_k: fewer than k rows may stay."""
    return df.where(F.col("score") >= threshold)


def with_documents(hits: DataFrame, docs: DataFrame, hit_col: str = "vec_id", id_col: str = "doc_id", most: int = 1000) -> DataFrame:
    """hits (at most `most` rows, checked) with the columns of their documents; hits without one stay. The ids go into the
    scan of docs as a filter, so that documents are neither shuffled nor read where row groups can be skipped."""
    few = hits.limit(most + 1).collect()
    if len(few) > most:
        raise ValueError(f"more than {most} hits: join them")
    found = docs.where(F.col(id_col).isin([r[hit_col] for r in few if r[hit_col] is not None]))
    local = hits.sparkSession.createDataFrame(few, hits.schema)
    return local.join(found, F.col(hit_col) == F.col(id_col), "left")


def top_k_each(corpus: DataFrame, queries: DataFrame, k: int = K, rows: int = 1 << 18, asked: int = 1 << 15) -> DataFrame:
    """(query_id, rank, vec_id, score) for many queries, exactly: a join of blocks. The corpus (vec_id, embedding) is dealt into blocks of about `rows` vectors,
    the queries (query_id, vector) into blocks of about `asked`, and every pair of them meets in a task, which holds the queries,
    streams the corpus in bounded batches, and keeps the k best of each query by matrix products of TILE cosines at most. One plan for any number of queries: with up to `asked` of
    them the corpus is shuffled once. Scores that agree to nine decimals are equal, and go to the smaller id. Null vectors, and
    vectors of other lengths than a query's, are nobody's neighbours; of queries with one id one counts."""
    bounded(corpus.sparkSession)
    single = queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>").alias("vector")).where("query_id is not null and vector is not null").dropDuplicates(["query_id"])
    vectors = corpus.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector")).where("vector is not null")
    a_s = max(-(-corpus.count() // rows), corpus.sparkSession.sparkContext.defaultParallelism)
    b_s = max(1, -(-queries.count() // asked))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = single.select(F.col("query_id").alias("id"), "vector", F.lit(0).alias("side"), own("query_id", b_s).alias("b")).withColumn("a", every(a_s))
    v = vectors.select(F.col("vec_id").alias("id"), "vector", F.lit(1).alias("side"), own("vec_id", a_s).alias("a")).withColumn("b", every(b_s))
    cells = q.unionByName(v).withColumn("width", F.size("vector")).repartition("width", "a", "b").sortWithinPartitions("width", "a", "b", "side")
    order = ["query_id", "near", "vec_id"]

    def merged(kept: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(kept).sort_values(order, ascending=[True, False, True]).groupby("query_id").head(k)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, ids, held, unit, kept, held_rows = None, [], [], None, [], 0
        for pdf in batches:
            for key, part in pdf.groupby(["width", "a", "b", "side"], sort=False):
                if key[:3] != cell:
                    if kept:
                        yield merged(kept)
                    cell, ids, held, unit, kept, held_rows = key[:3], [], [], None, [], 0
                x = np.stack(part["vector"].to_numpy()).reshape(len(part), key[0])
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                if key[3] == 0:
                    ids.append(part["id"].to_numpy())
                    held.append(x)
                    continue
                if not ids:
                    continue
                if unit is None:
                    unit, qid, held = np.concatenate(held), np.concatenate(ids), []
                step = max(1, TILE // len(part))
                for first in range(0, len(unit), step):
                    s = unit[first : first + step] @ x.T
                    near = np.round(s, 9)
                    n = min(k, len(part))
                    row, at = np.nonzero(near >= np.partition(near, len(part) - n, axis=1)[:, len(part) - n, None])
                    kept.append(merged([pd.DataFrame({"query_id": qid[first + row], "vec_id": part["id"].to_numpy()[at], "score": s[row, at], "near": near[row, at]})]))
                    held_rows += len(kept[-1])
                if held_rows > 2 * k * len(unit) + 100_000:
                    kept = [merged(kept)]
                    held_rows = len(kept[0])
        if kept:
            yield merged(kept)

    found = cells.mapInPandas(best, "query_id long, vec_id long, score double, near double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("near"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def diverse(df: DataFrame, k: int = K, weight: float = 0.5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """k rows of scored df chosen one by one by weight * score - (1 - weight) * the largest cosine to those chosen
    (maximal marginal relevance), from the max(k, min(2 k, 20)) best; with the column mmr_rank."""
    fetch = max(k, min(2 * k, 20))
    near = top_k(df, fetch, id_col)
    schema = T.StructType([*near.schema.fields, T.StructField("mmr_rank", T.IntegerType())])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["score"]).sort_values(["score", id_col], ascending=[False, True]).reset_index(drop=True)
        if not len(pdf):
            return pdf.assign(mmr_rank=pd.Series(dtype="int32"))
        x = np.stack(pdf[vec_col].to_numpy()).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        score, like, taken = pdf["score"].to_numpy(), x @ x.T, [0]
        while len(taken) < min(k, len(pdf)):
            value = weight * score - (1 - weight) * like[:, taken].max(axis=1)
            value[taken] = -np.inf
            taken.append(int(value.argmax()))
        return pdf.iloc[taken].assign(mmr_rank=np.arange(1, len(taken) + 1, dtype="int32"))

    return near.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(lambda pdf: choose(pdf.drop(columns="__all")), schema)  # at most fetch rows


def rerank(df: DataFrame, query: DataFrame, k: int | None = None, id_col: str = "vec_id") -> DataFrame:
    """df (with original_rank) by its cosine to the query; failed embeddings score 0; equal scores keep their order."""
    again = scored(df.drop("score"), query, id_col).withColumn("score", F.coalesce("score", F.lit(0.0)))
    again = again.orderBy(F.desc("score"), "original_rank")
    return again if k is None else again.limit(k)


def rerank_size(k: int | None, documents: int, default: int = K) -> int:
    """How many rows a rerank service returns: a k that isn't given, or equals the number of documents (as clients fill it in), means
    the default."""
    return min(documents, default if k is None or k == documents else k)


def source_label(method: Column, collection: Column) -> Column:
    kind = F.when(method == "Web upload", "Client upload").when(method == "Local", "Local").when(method == "Processed JSON Import", "Processed JSON Upload").otherwise("Unknown")
    return F.concat(kind, F.lit(" [Collection: "), collection, F.lit("]"))


def download_info(file_id: Column, path: Column) -> Column:
    """A struct where both are set and not empty, else null."""
    return F.when((file_id != "") & (path != ""), F.struct(file_id.alias("file_id"), basename(path).alias("filename"), F.lit(True).alias("download_available")))


def first_of(df: DataFrame, *keys: str, order: str) -> DataFrame:
    """The first row of each key by order; null keys are a key of their own."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")


def merge_by_url(reranked: DataFrame, originals: DataFrame) -> DataFrame:
    """Reranked rows (url, score, rank) with title and content of the original of that url (its last one); those
    without an original stay with empty fields."""
    last = first_of(originals.withColumn("__back", -F.col("ordinal")), "url", order="__back")
    kept = last.select(F.col("url").alias("__url"), "title", "content")
    both = reranked.join(kept, F.col("url") == F.col("__url"), "left").drop("__url")
    return both.withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "content")})


def merge_by_content(reranked: DataFrame, originals: DataFrame) -> DataFrame:
    """Reranked rows (content, score, rank) with title and source of the first original of equal content."""
    firsts = first_of(originals, "content", order="ordinal").select(F.col("content").alias("__content"), "title", "source")
    return reranked.join(firsts, F.col("content") == F.col("__content"), "left").drop("__content")


def mean_relevance(df: DataFrame) -> DataFrame:
    """One row: the mean of scores, null ones as 0; 0 where there are no rows."""
    return df.agg(F.coalesce(F.avg(F.coalesce("score", F.lit(0.0))), F.lit(0.0)).alias("relevance"), F.count("*").alias("hits"))
