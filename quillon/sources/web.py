"""Stand-ins for the web: search and download answered from a table of pages (page_id, url, html)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.web import html_to_text, url_valid


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)


def search(pages: DataFrame, words: list[str], k: int = 10) -> DataFrame:
    """The k pages whose visible text holds most of the words, ties by page_id: rank, title, url, description, score."""
    text = F.lower(html_to_text(F.col("html"), pages.sparkSession))
    found = pages.select("page_id", "url", title(F.col("html")).alias("title"), text.alias("text"))
    score = sum((F.contains(F.col("text"), F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    rows = found.select("page_id", "title", "url", F.substring("text", 1, 200).alias("description"), score.alias("score"))
    return rows.orderBy(F.desc("score"), "page_id").limit(k).where("score > 0")  # in this order: a condition before the limit reads every text a second time


def search_many(pages: DataFrame, queries: dict[str, list[str]], k: int = 10) -> DataFrame:
    """The k best pages of each query (by name: its words), as search() ranks them: query, page_id, title, url, description, score. One scan, which reads every page's
    text once for all queries."""
    text = F.lower(html_to_text(F.col("html"), pages.sparkSession))
    found = pages.select("page_id", "url", title(F.col("html")).alias("title"), text.alias("text"))  # null texts have a null score
    score = lambda words: sum((F.contains(F.col("text"), F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    each = F.array(*(F.struct(F.lit(name).alias("query"), score(words).alias("score")) for name, words in queries.items()))
    rows = found.select("page_id", "title", "url", F.substring("text", 1, 200).alias("description"), F.explode(each).alias("q")).select("q.query", "page_id", "title", "url", "description", "q.score")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "page_id"))
    return rows.where("score > 0").withColumn("place", place).where(F.col("place") <= k).drop("place")


def download(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """Each wanted url with its page, a status, and an error for bad or unknown urls."""
    got = wanted.join(pages.select(F.col("url").alias("__url"), "page_id", F.length("html").alias("size")), F.col("url") == F.col("__url"), "left").drop("__url")
    error = F.when(~url_valid(F.col("url")), "invalid URL").when(F.col("page_id").isNull(), "not found")
    return got.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), "success").otherwise("error"))


def resolve(names: DataFrame, records: DataFrame) -> DataFrame:
    """(name, addresses): the addresses recorded for each name, in their order, without repeats."""
    listed = records.groupBy("name").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "address"))), lambda x: x["address"])).alias("addresses"))
    return names.join(listed, "name", "left")
