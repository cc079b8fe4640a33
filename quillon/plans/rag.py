"""Questions answered from documents: retrieve, augment, generate; and web search with full pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..embedding import EmbeddingProvider, provider
from ..functions.text import asks_database, context_prompt
from ..functions.vectors import cosine
from ..functions.web import html_text, html_to_text
from ..operators import retrieval as R
from ..sources import web
from ..sources.fanout import fan_out
from .agent import TextModel

SUMMARY = 4000


def applicable(spark: SparkSession, question: str) -> bool:
    """Whether a question goes to documents rather than to databases."""
    return not spark.range(1).select(asks_database(F.lit(question))).first()[0]


def retrieve(corpus: DataFrame, question: str, model: EmbeddingProvider | None = None, k: int = R.K, threshold: float | None = R.THRESHOLD, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The k documents nearest to a question, with scores; documents without an embedding column get one on the way."""
    model = model or provider()
    spark = corpus.sparkSession
    docs = corpus if "embedding" in corpus.columns else model.embed(corpus, text_col)
    query = model.embed(spark.createDataFrame([(question,)], "q string"), "q")
    hits = R.top_k(R.scored(docs, query, id_col), k, id_col)
    return hits if threshold is None else R.over_threshold(hits, threshold)


def augmented(hits: DataFrame, question: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row: the prompt from the hits (at most k), best first."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(id_col).alias("i"), F.col(text_col).alias("t"))))
    return hits.agg(context_prompt(F.transform(order, lambda x: x["t"]), F.lit(question)).alias("prompt"))


def answer(corpus: DataFrame, question: str, model: TextModel, **how) -> str:
    """The model's reply to the augmented prompt."""
    return model.complete("response", augmented(retrieve(corpus, question, **how), question).first()["prompt"])


def enhanced_search(pages: DataFrame, words: list[str], model: EmbeddingProvider | None = None, hits: int = 10, k: int = R.K) -> DataFrame:
    """Web hits with their pages' text as summary (the description where there is none), ranked again by cosine to the
    query, the k best: page_id, title, url, summary, score."""
    found = web.search(pages, words, hits)
    best = pages.select("page_id", "html").join(F.broadcast(found), "page_id")  # hits rows at most; only their texts are read again
    full = html_to_text(F.col("html"), pages.sparkSession)
    best = best.withColumn("summary", F.substring(F.coalesce(F.nullif(full, F.lit("")), F.col("description")), 1, SUMMARY)).drop("html", "score")
    return retrieve(best, " ".join(words), model, k, None, "summary", "page_id").select("page_id", "title", "url", "summary", "score")


def stored_page(row: dict) -> str:
    """The visible text of a downloaded page, for fan_out; a page that isn't there fails."""
    if row["html"] is None:
        raise LookupError(f"not found: {row['url']}")
    return html_text(row["html"]) or ""


def enhanced_search_many(
    pages: DataFrame, queries: dict[str, list[str]], fetch: Callable[[dict], str | None] = stored_page, model: EmbeddingProvider | None = None, hits: int = 10, k: int = R.K, **how
) -> DataFrame:
    """enhanced_search for several queries: query, rank, page_id, title, url, summary, score, error. Each page that any query found is downloaded once, some at a
    time in every task (how: see fan_out; fetch gets a row with page_id, url and html, which the offline stand-in reads). A page that
    can't be read is summed up by its description, and its error stays with it."""
    model, spark = model or provider(), pages.sparkSession
    found = web.search_many(pages, queries, hits)
    wanted = pages.select("page_id", "url", "html").join(found.select("page_id").distinct(), "page_id", "left_semi")
    got = fan_out(wanted, fetch, "full", **how).select("page_id", "full", "error")
    best = found.drop("score").join(got, "page_id")
    best = best.withColumn("summary", F.substring(F.coalesce(F.nullif("full", F.lit("")), F.col("description")), 1, SUMMARY))
    asked = model.embed(spark.createDataFrame([(name, " ".join(words)) for name, words in queries.items()], "query string, q string"), "q", "asked")
    ranked = model.embed(best, "summary").join(asked.select("query", "asked"), "query").withColumn("score", cosine(F.col("embedding"), F.col("asked")))
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc_nulls_last("score"), "page_id"))
    return ranked.withColumn("rank", place).where(F.col("rank") <= k).select("query", "rank", "page_id", "title", "url", "summary", "score", "error")
