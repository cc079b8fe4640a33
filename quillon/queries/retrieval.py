"""Vectors, documents and hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..embedding import FittedProvider, provider
from ..functions import text as X
from ..functions.vectors import cosine
from ..operators import documents as D
from ..operators import retrieval as R
from ..plans import rag
from ..sources import web
from ..sources.store import Store, scratch
from .common import FILE_ID, METHOD, STORED, Registry, table

REGISTRY = Registry()
add = REGISTRY.add

Q0 = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
SCORED = f"SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS s FROM embeddings, {Q0}"
TOP = f"SELECT *, row_number() OVER (ORDER BY s DESC, vec_id) AS n FROM ({SCORED})"
LABEL = (
    "(CASE m WHEN 'Web upload' THEN 'Client upload' WHEN 'Local' THEN 'Local' WHEN 'Processed JSON Import' THEN 'Processed JSON Upload' ELSE 'Unknown' END "
    "|| ' [Collection: default]')"
)


def _scored(spark, d):
    e = table(spark, d, "embeddings")
    return R.scored(e, e.where("vec_id = 0"))


@add("topk_threshold", f"SELECT t.vec_id, round(s, 6) AS score, coalesce(d.source, '') AS source, {LABEL} AS label FROM ({TOP}) t LEFT JOIN (SELECT *, {METHOD} AS m FROM documents) d ON d.doc_id = t.vec_id WHERE n <= 5 AND s >= 0.3")
def topk_threshold(spark, d):
    """Retrieval end to end: scan, cosine, top 5, threshold, documents, source labels."""
    hits = R.over_threshold(R.top_k(_scored(spark, d).select("vec_id", "score")))
    docs = table(spark, d, "documents").select("doc_id", "source", F.expr(METHOD).alias("m"))
    return R.with_documents(hits, docs).select("vec_id", F.round("score", 6).alias("score"), F.coalesce("source", F.lit("")).alias("source"), R.source_label(F.col("m"), F.lit("default")).alias("label"))


@add("topk_cosine", f"SELECT vec_id, round(s, 6) AS score, CAST(n AS INT) AS rank FROM ({TOP}) WHERE n <= 5")
def topk_cosine(spark, d):
    best = R.top_k(_scored(spark, d).select("vec_id", "score"))
    return best.select("vec_id", F.round("score", 6).alias("score"), F.expr("row_number() over (order by score desc, vec_id)").alias("rank"))  # five rows


@add(
    "topk_each",
    "SELECT query_id, CAST(n AS INT) AS rank, vec_id, round(s, 6) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s, "
    "row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) DESC, e.vec_id) AS n FROM embeddings e, embeddings q WHERE q.label = 3) WHERE n <= 5",
)
def topk_each(spark, d):
    e = table(spark, d, "embeddings")
    queries = e.where("label = 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return R.top_k_each(e, queries).withColumn("score", F.round("score", 6))


_NEAR = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@add(
    "topk_all",
    f"SELECT query_id, CAST(n AS INT) AS rank, vec_id, round(s, 6) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id, {_NEAR} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_NEAR}, 9) DESC, e.vec_id) AS n FROM embeddings e, embeddings q) WHERE n <= 3",
)
def topk_all(spark, d):
    """Every vector as a query."""
    e = table(spark, d, "embeddings")
    return R.top_k_each(e, e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), k=3).withColumn("score", F.round("score", 6))


@add("cosine_pairs", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    a = table(spark, d, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


@add("topk_mmr")
def topk_mmr(spark, d):
    return R.diverse(_scored(spark, d)).select("vec_id", F.round("score", 6).alias("score"), "mmr_rank")


@add(
    "rerank_cosine",
    f"SELECT vec_id, original_rank, round(s2, 6) AS score, CAST(row_number() OVER (ORDER BY s2 DESC, original_rank) AS INT) AS rank FROM (SELECT t.vec_id, n AS original_rank, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q1.q) AS s2 "
    f"FROM ({TOP}) t JOIN embeddings e USING (vec_id), (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 1) q1 WHERE n <= 20) QUALIFY row_number() OVER (ORDER BY s2 DESC, original_rank) <= 5",
)
def rerank_cosine(spark, d):
    e = table(spark, d, "embeddings")
    first = R.top_k(_scored(spark, d), 20).withColumn("original_rank", F.expr("row_number() over (order by score desc, vec_id)").cast("long"))
    best = R.rerank(first, e.where("vec_id = 1"), 5)
    return best.select("vec_id", "original_rank", F.round("score", 6).alias("score"), F.expr("row_number() over (order by score desc, original_rank)").alias("rank"))


@add("avg_relevance", f"SELECT round(coalesce(avg(coalesce(s, 0)), 0), 6) AS relevance, count(*) AS hits FROM ({SCORED}) WHERE label = 2")
def avg_relevance(spark, d):
    return R.mean_relevance(_scored(spark, d).where("label = 2")).withColumn("relevance", F.round("relevance", 6))


@add("summaries_topk", f"SELECT doc_id, round(s, 6) AS relevance, substr(text, 1, 4000) AS summary FROM documents JOIN ({SCORED}) ON vec_id = doc_id ORDER BY s DESC, doc_id LIMIT 5")
def summaries_topk(spark, d):
    scores = _scored(spark, d).select(F.col("vec_id").alias("doc_id"), "score")
    best = table(spark, d, "documents").select("doc_id").join(scores, "doc_id").orderBy(F.desc("score"), "doc_id").limit(5)
    return table(spark, d, "documents").join(F.broadcast(best), "doc_id").select("doc_id", F.round("score", 6).alias("relevance"), F.substring("text", 1, 4000).alias("summary"))


def _meta(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", F.expr(METHOD).alias("m"), F.expr(FILE_ID).alias("file_id"), F.expr(STORED).alias("path"))


@add("source_label", f"SELECT doc_id, {LABEL} AS label FROM (SELECT *, {METHOD} AS m FROM documents)")
def source_label(spark, d):
    return _meta(spark, d).select("doc_id", R.source_label(F.col("m"), F.lit("default")).alias("label"))


@add("download_info", f"SELECT doc_id, CASE WHEN f <> '' AND p <> '' THEN f END AS file_id, CASE WHEN f <> '' AND p <> '' THEN split_part(p, '/', -1) END AS filename, f <> '' AND p <> '' AND f IS NOT NULL AS available FROM (SELECT doc_id, {FILE_ID} AS f, {STORED} AS p FROM documents)")
def download_info(spark, d):
    info = _meta(spark, d).select("doc_id", R.download_info(F.col("file_id"), F.col("path")).alias("i"))
    return info.select("doc_id", F.col("i.file_id").alias("file_id"), F.col("i.filename").alias("filename"), F.col("i").isNotNull().alias("available"))


@add("ingest_metadata", f"SELECT doc_id, coalesce(nullif(s, ''), 'unknown') AS source, coalesce(nullif(t, ''), nullif(s, ''), 'Untitled Document') AS title, coalesce(nullif(m, ''), 'Local') AS upload_method FROM (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN '' ELSE source END AS s, CASE WHEN doc_id % 4 = 0 THEN lang END AS t, {METHOD} AS m FROM documents)")
def ingest_metadata(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 6 = 0 THEN '' ELSE source END AS source", "CASE WHEN doc_id % 4 = 0 THEN lang END AS title", f"{METHOD} AS upload_method")
    return D.fill_metadata(rows)


@add("upload_metadata", f"SELECT doc_id, f AS file_id, n AS source, n AS title, 'Web upload' AS upload_method, 'uploads/' || f || '/' || n AS stored_file_path FROM (SELECT doc_id, {FILE_ID} AS f, source || '.md' AS n FROM documents)")
def upload_metadata(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id", f"{FILE_ID} AS file_id", "source AS folder")
    return D.override_metadata(rows, F.concat("folder", F.lit(".md"))).drop("folder")


@add("dir_metadata", f"SELECT doc_id, split_part(p, '/', -1) AS source, split_part(p, '/', -1) AS title, 'Local' AS upload_method FROM (SELECT doc_id, {STORED} AS p FROM documents)")
def dir_metadata(spark, d):
    return D.directory_metadata(table(spark, d, "documents").selectExpr("doc_id", f"{STORED} AS p"), F.col("p")).drop("p")


@add("download_url", f"SELECT doc_id, CASE WHEN f IS NOT NULL THEN '/download/' || f || '/' || regexp_replace(source || ' v1.txt', '[^A-Za-z0-9_.-]', '_', 'g') END AS url FROM (SELECT doc_id, source, {FILE_ID} AS f FROM documents)")
def download_url(spark, d):
    name = X.filename_secure(F.concat("source", F.lit(" v1.txt")))
    return _meta(spark, d).select("doc_id", F.concat(F.lit("/download/"), "file_id", F.lit("/"), name).alias("url"))


@add("upload_gate", "SELECT doc_id, name, CASE WHEN lower(regexp_extract(name, '\\.([^.]+)$', 1)) NOT IN ('txt', 'pdf', 'docx', 'html', 'md') THEN 'extension not allowed' WHEN n_chars * 10000 > 104857600 THEN 'file too large' END AS reason FROM (SELECT *, concat(source, '.', CASE doc_id % 4 WHEN 0 THEN 'PDF' WHEN 1 THEN 'md' WHEN 2 THEN 'exe' ELSE 'txt' END) AS name FROM documents)")
def upload_gate(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id", "n_chars * 10000 AS size", "concat(source, '.', CASE doc_id % 4 WHEN 0 THEN 'PDF' WHEN 1 THEN 'md' WHEN 2 THEN 'exe' ELSE 'txt' END) AS name")
    return rows.select("doc_id", "name", D.upload_reason(F.col("name"), F.col("size")).alias("reason"))


@add("nonblank_docs", "SELECT doc_id, length(t) AS n FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '   ' ELSE text END AS t FROM documents) WHERE trim(t) <> ''")
def nonblank_docs(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 10 = 0 THEN '   ' ELSE text END AS t")
    return rows.where(F.trim("t") != "").select("doc_id", F.length("t").cast("long").alias("n"))


@add("embed_prefix", "SELECT item_id, CASE WHEN regexp_matches(t, '^(search_query|search_document):') THEN t ELSE 'search_document: ' || t END AS t FROM (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'search_query: ' || text ELSE text END AS t FROM benchmark)")
def embed_prefix(spark, d):
    rows = table(spark, d, "benchmark").selectExpr("item_id", "CASE WHEN item_id % 3 = 0 THEN concat('search_query: ', text) ELSE text END AS t")
    return rows.select("item_id", X.embed_prefix(F.col("t"), "search_document").alias("t"))


@add("collection_count", "SELECT count(*) AS n, count(DISTINCT label) AS labels FROM embeddings")
def collection_count(spark, d):
    return table(spark, d, "embeddings").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"))


@add("collection_upsert", "SELECT vec_id, label FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE vec_id % 7 = 0 UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 50 = 0")
def collection_upsert(spark, d):
    old = table(spark, d, "embeddings").select("vec_id", "label")
    new = old.where("vec_id % 7 = 0").select("vec_id", (F.col("label") + 100).alias("label")).unionAll(old.where("vec_id % 50 = 0").select((F.col("vec_id") + 1000000).alias("vec_id"), "label"))
    return D.upserted(old, new, "vec_id")


STORED_ROWS = "SELECT vec_id, label, embedding[1] AS first FROM embeddings"


@add(
    "stored_upsert",
    f"SELECT vec_id, label, first FROM ({STORED_ROWS}) WHERE vec_id % 7 <> 0 AND vec_id % 11 <> 3 UNION ALL SELECT vec_id, label + 100 + CASE WHEN vec_id % 21 = 0 THEN 1000 ELSE 0 END, first FROM ({STORED_ROWS}) WHERE vec_id % 7 = 0 AND vec_id % 11 <> 3 "
    f"UNION ALL SELECT vec_id + 1000000, label, first FROM ({STORED_ROWS}) WHERE vec_id % 50 = 0",
)
def stored_upsert(spark, d):
    """All vectors stored, upserted twice (some ids are new, some come twice), some deleted, and read back from storage."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].alias("first"))
    store = Store(spark, scratch(spark), "vec_id")
    store.upsert(rows)
    more = lambda n: F.col("label") + n
    store.upsert(rows.where("vec_id % 7 = 0").withColumn("label", more(100)).unionByName(rows.where("vec_id % 50 = 0").withColumn("vec_id", F.col("vec_id") + 1000000)))
    store.upsert(rows.where("vec_id % 21 = 0").withColumn("label", more(1100)))
    store.delete(rows.where("vec_id % 11 = 3"))
    return store.read()


HITS = "SELECT page_id AS ordinal, url, concat('P', CAST(page_id % 40 AS VARCHAR(9))) AS content, concat('T', CAST(page_id AS VARCHAR(9))) AS title, concat('http://h', CAST(page_id % 60 AS VARCHAR(9))) AS link FROM pages"


def _hits(spark, d):
    return table(spark, d, "pages").selectExpr("page_id AS ordinal", "concat('http://h', cast(page_id % 60 as string)) AS url", "concat('P', cast(page_id % 40 as string)) AS content", "concat('T', cast(page_id as string)) AS title")


@add("rerank_merge_url", f"WITH o AS ({HITS}), r AS (SELECT ordinal, CASE WHEN ordinal % 5 = 0 THEN 'http://none' ELSE 'http://h' || ordinal % 90 END AS url, 1.0 / (1 + ordinal) AS score FROM o WHERE ordinal % 2 = 0), l AS (SELECT link, max_by(title, ordinal) AS title, max_by(content, ordinal) AS content FROM o GROUP BY link) SELECT r.url, round(r.score, 6) AS score, coalesce(l.title, '') AS title, coalesce(l.content, '') AS content FROM r LEFT JOIN l ON l.link = r.url")
def rerank_merge_url(spark, d):
    o = _hits(spark, d)
    r = o.where("ordinal % 2 = 0").selectExpr("CASE WHEN ordinal % 5 = 0 THEN 'http://none' ELSE concat('http://h', cast(ordinal % 90 as string)) END AS url", "cast(1.0 as double) / (1 + ordinal) AS score")
    return R.merge_by_url(r, o).select("url", F.round("score", 6).alias("score"), "title", "content")


@add("rerank_merge_content", f"WITH o AS ({HITS}), r AS (SELECT 'P' || ordinal % 55 AS content, ordinal AS rank FROM o WHERE ordinal % 3 = 0), f AS (SELECT content, min_by(title, ordinal) AS title, min_by(link, ordinal) AS source FROM o GROUP BY content) SELECT r.rank, r.content, f.title, f.source FROM r LEFT JOIN f ON f.content = r.content")
def rerank_merge_content(spark, d):
    o = _hits(spark, d).withColumnRenamed("url", "source")
    r = o.where("ordinal % 3 = 0").selectExpr("concat('P', cast(ordinal % 55 as string)) AS content", "ordinal AS rank")
    return R.merge_by_content(r, o).select("rank", "content", "title", "source")


@add("dedup_results", "SELECT min(ordinal) AS ordinal, content, source, title, url, sha256(concat_ws(chr(31), content, source, title, url)) AS id FROM (SELECT page_id AS ordinal, 'P' || page_id % 40 AS content, 'S' || page_id % 4 AS source, 'T' || page_id % 20 AS title, 'U' || page_id % 10 AS url FROM pages) GROUP BY content, source, title, url")
def dedup_results(spark, d):
    rows = table(spark, d, "pages").selectExpr("page_id AS ordinal", *(f"concat('{a}', cast(page_id % {n} as string)) AS {c}" for a, n, c in (("P", 40, "content"), ("S", 4, "source"), ("T", 20, "title"), ("U", 10, "url"))))
    return D.deduplicated(rows)


CHUNKS = """WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, text FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\r\\f\\v]')),
p0 AS (SELECT doc_id, 0 AS a, text AS x FROM d),
""" + "".join(
    f"""l{n} AS (SELECT *, CASE WHEN length(x) > {D.SIZE} AND contains(x, {sep}) THEN string_split(x, {sep}) ELSE [x] END AS parts FROM p{n - 1}),
m{n} AS (SELECT doc_id, a, parts, unnest(range(1, len(parts) + 1)) AS i FROM l{n}),
p{n} AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, i) AS a, x FROM (SELECT *, parts[i] || CASE WHEN i < len(parts) THEN {sep} ELSE '' END AS x FROM m{n}) WHERE x <> ''),
"""
    for n, sep in enumerate(("chr(10) || chr(10)", "chr(10)", "' '"), 1)
) + f"""l4 AS (SELECT doc_id, a, CASE WHEN length(x) > {D.SIZE} THEN regexp_extract_all(x, '(?s).') ELSE [x] END AS parts FROM p3),
m4 AS (SELECT doc_id, a, parts, unnest(range(1, len(parts) + 1)) AS i FROM l4),
s AS (SELECT doc_id, sum(length(parts[i])) OVER (PARTITION BY doc_id ORDER BY a, i) AS hi, length(parts[i]) AS n FROM m4),
p AS MATERIALIZED (SELECT doc_id, hi - n AS lo, hi FROM s),
c AS (
  SELECT doc_id, 0 AS chunk, 0::HUGEINT AS base, max(hi) AS e FROM p WHERE hi <= {D.SIZE} GROUP BY doc_id
  UNION ALL
  SELECT b.doc_id, b.chunk + 1, b.base, max(r.hi) FROM (
    SELECT c.doc_id, c.chunk, min(q.hi) AS base FROM c JOIN p ON p.doc_id = c.doc_id AND p.lo = c.e JOIN p q ON q.doc_id = c.doc_id AND q.hi <= c.e AND q.hi >= c.e - {D.OVERLAP} AND q.hi >= p.hi - {D.SIZE}
    GROUP BY c.doc_id, c.chunk
  ) b JOIN p r ON r.doc_id = b.doc_id AND r.hi <= b.base + {D.SIZE} GROUP BY b.doc_id, b.chunk, b.base
)
SELECT c.doc_id, CAST(chunk AS INT) AS chunk, substr(text, CAST(base AS BIGINT) + 1, CAST(e - base AS BIGINT)) AS content FROM c JOIN d USING (doc_id)"""


@add("chunk_documents", CHUNKS)
def chunk_documents(spark, d):
    return D.chunks(table(spark, d, "documents").select("doc_id", "text"))


@add("html_to_text")
def html_to_text(spark, d):
    from ..functions.web import html_to_text as text

    return table(spark, d, "pages").select("page_id", text(F.col("html"), spark).alias("text"))


@add("hash_embed")
def hash_embed(spark, d):
    return provider("hashing").embed(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "embedding")


@add("web_search_offline")
def web_search_offline(spark, d):
    return web.search(table(spark, d, "pages"), ["the", "and", "ring"])


@add("download_lookup", "SELECT w.ordinal, w.url, p.page_id, length(p.html) AS size, CASE WHEN NOT regexp_matches(w.url, '^[a-z]+://[^/]+') THEN 'invalid URL' WHEN p.page_id IS NULL THEN 'not found' END AS error, CASE WHEN p.page_id IS NULL THEN 'error' ELSE 'success' END AS status FROM (SELECT page_id AS ordinal, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'no-url' ELSE url || '/gone' END AS url FROM pages) w LEFT JOIN pages p ON p.url = w.url")
def download_lookup(spark, d):
    wanted = table(spark, d, "pages").selectExpr("page_id AS ordinal", "CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'no-url' ELSE concat(url, '/gone') END AS url")
    return web.download(wanted, table(spark, d, "pages")).withColumn("size", F.col("size").cast("long"))


@add("search_hits", "SELECT ordinal, coalesce(a, b, 'Untitled') AS title, coalesce(u, '') AS url, coalesce(s, u, 'Unknown source') AS source FROM (SELECT page_id AS ordinal, CASE WHEN page_id % 2 = 0 THEN 'T' || page_id END AS a, CASE WHEN page_id % 3 = 0 THEN 'N' || page_id END AS b, CASE WHEN page_id % 5 <> 0 THEN url END AS u, CASE WHEN page_id % 7 = 0 THEN 'web' END AS s FROM pages) WHERE ordinal < 100")
def search_hits(spark, d):
    """The best 100 hits, with the first field that there is of each kind."""
    rows = table(spark, d, "pages").selectExpr("page_id AS ordinal", "CASE WHEN page_id % 2 = 0 THEN concat('T', cast(page_id as string)) END AS title", "CASE WHEN page_id % 3 = 0 THEN concat('N', cast(page_id as string)) END AS name", "CASE WHEN page_id % 5 <> 0 THEN url END AS url", "CASE WHEN page_id % 7 = 0 THEN 'web' END AS source")
    hits = rows.orderBy("ordinal").limit(100)
    return hits.select("ordinal", F.coalesce("title", "name", F.lit("Untitled")).alias("title"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("source", "url", F.lit("Unknown source")).alias("source"))


@add("longer_content", "SELECT h.page_id, CASE WHEN h.page_id = 0 AND length(p.html) > length(h.snippet) THEN p.html ELSE h.snippet END AS content FROM (SELECT page_id, url, substr(html, 1, 300) AS snippet FROM pages) h JOIN pages p USING (page_id)")
def longer_content(spark, d):
    """Only the first hit's snippet gives way to the downloaded text, if that is longer."""
    pages = table(spark, d, "pages")
    hits = pages.select("page_id", "url", F.substring("html", 1, 300).alias("snippet"))
    first = hits.orderBy("page_id").limit(1).select(F.col("page_id").alias("first_id"), F.col("url").alias("first_url"))
    got = pages.join(F.broadcast(first), (F.col("url") == F.col("first_url")) & (F.col("page_id") == F.col("first_id"))).select("first_id", "html")  # one row
    both = hits.join(F.broadcast(got), F.col("page_id") == F.col("first_id"), "left")
    return both.select("page_id", F.when(F.length("html") > F.length("snippet"), F.col("html")).otherwise(F.col("snippet")).alias("content"))


@add("session_files", "SELECT w.session, w.filename, f.path FROM (SELECT conv_id AS session, 'f' || turn || '.txt' AS filename FROM conversations WHERE turn < 3) w JOIN (SELECT conv_id AS session, 'f' || turn || '.txt' AS filename, 'up/' || conv_id || '/' || turn AS path FROM conversations WHERE turn % 2 = 0) f USING (session, filename)")
def session_files(spark, d):
    """Wanted files by name within their session; names without a file drop out together with their paths."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), "turn", F.concat(F.lit("f"), F.col("turn").cast("string"), F.lit(".txt")).alias("filename"))
    have = c.where("turn % 2 = 0").select("session", "filename", F.concat(F.lit("up/"), F.col("session").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("path"))
    return c.where("turn < 3").select("session", "filename").join(have, ["session", "filename"])


PAYLOAD = "concat('{\"document\": ', CASE WHEN doc_id % 11 = 0 THEN 'null' ELSE concat('\"d', CAST(doc_id AS VARCHAR(9)), '\"') END, ', \"chunks\": [{\"content\": \"c0\", \"section\": \"s\", \"trust\": \"hi\"}, {', CASE WHEN doc_id % 13 = 0 THEN '' ELSE '\"content\": \"c1\", ' END, '\"chunk_id\": ', CAST(doc_id % 5 AS VARCHAR(9)), '}]}')"


@add("import_chunks", f"WITH p AS (SELECT doc_id, {PAYLOAD} AS j FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0) SELECT doc_id, 'd' || doc_id AS document, i AS ordinal, json_extract_string(j, '$.chunks[' || i || '].content') AS content, coalesce(json_extract_string(j, '$.chunks[' || i || '].section'), '') AS section, 'd' || doc_id AS title, coalesce(CAST(json_extract_string(j, '$.chunks[' || i || '].chunk_id') AS INT), i) AS chunk_id, coalesce(json_extract_string(j, '$.chunks[' || i || '].trust'), '') AS trust FROM p, (VALUES (0), (1)) v(i)")
def import_chunks(spark, d):
    rows, _ = D.import_chunks(table(spark, d, "documents").selectExpr("doc_id", f"{PAYLOAD} AS payload"))
    return rows.withColumn("trust", F.coalesce(F.col("extra")["trust"], F.lit(""))).drop("extra")


@add("import_rejects", "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'document is missing' ELSE 'a chunk has no content' END AS reason FROM documents WHERE doc_id % 11 = 0 OR doc_id % 13 = 0")
def import_rejects(spark, d):
    _, bad = D.import_chunks(table(spark, d, "documents").selectExpr("doc_id", f"{PAYLOAD} AS payload"))
    return bad.select("doc_id", "reason")


@add("enhanced_search")
def enhanced_search(spark, d):
    """Search, download, summary, rerank, top k."""
    return rag.enhanced_search(table(spark, d, "pages"), ["the", "and", "ring"]).select("page_id", "title", "url", F.round("score", 6).alias("score"))


@add("rag_context")
def rag_context(spark, d):
    """A question's prompt from the documents nearest to it."""
    hits = rag.retrieve(table(spark, d, "documents").select("doc_id", "text"), "the thing and the other", threshold=None)
    return rag.augmented(hits, "the thing and the other")


WORDS = r"list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"


@add(
    "fitted_weights",
    f"WITH w AS (SELECT r, CAST('0x' || substr(md5(t), 1, 4) AS INTEGER) AS bucket FROM (SELECT row_number() OVER () AS r, unnest({WORDS}) AS t FROM documents) GROUP BY ALL) "
    "SELECT bucket, count(*) AS documents, round(ln((1 + (SELECT count(DISTINCT r) FROM w)) / (1 + count(*))) + 1, 9) AS weight FROM w GROUP BY bucket",
)
def fitted_weights(spark, d):
    """An embedding model fitted on two halves of the documents, merged, saved and loaded."""
    docs = table(spark, d, "documents")
    halves = [FittedProvider.fit(docs.where(F.col("doc_id") % 2 == n), "text") for n in (0, 1)]
    path = scratch(spark)
    halves[0].merge(halves[1]).save(path)
    return FittedProvider.load(spark, path).weights().withColumn("weight", F.round("weight", 9))


@add("rag_context_fitted")
def rag_context_fitted(spark, d):
    """As rag_context, with the fitted provider."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    hits = rag.retrieve(docs, "the thing and the other", FittedProvider.fit(docs, "text"), threshold=None)
    return rag.augmented(hits, "the thing and the other")


@add("enhanced_search_many")
def enhanced_search_many(spark, d):
    """Several queries over all pages, each page fetched once."""
    found = rag.enhanced_search_many(table(spark, d, "pages"), {"a": ["the", "and", "ring"], "b": ["price", "home"], "c": ["de", "la"]})
    return found.select("query", "rank", "page_id", "url", F.round("score", 6).alias("score"), "error")
