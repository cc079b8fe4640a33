"""Text, names, URLs, JSON and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsontext as J
from ..functions import text as X
from ..functions import web
from ..operators.normalize import source_of_hits
from ..plans import guard
from ..plans.judge import judged
from .common import STATEMENT, REPLY, Registry, table

REGISTRY = Registry()
add = REGISTRY.add

BS = "chr(92)"
UNESCAPED = f"replace(replace(replace(replace(replace(x, {BS} || chr(39), chr(39)), {BS} || 'n', chr(10)), {BS} || 't', chr(9)), {BS} || 'r', chr(13)), {BS} || {BS}, {BS})"
CLEAN = f"regexp_replace(regexp_replace({UNESCAPED}, '(?s)/\\*.*?\\*/', '', 'g'), '--[^\\n]*', '', 'g')"
WS = "[ \\t\\n\\r\\x0B\\f]"


@add("strip_reasoning", f"SELECT p_partkey, regexp_replace(regexp_replace(x, '(?s)###ponder###.*?###/ponder###', '', 'g'), '(?s)<thinking>.*?</thinking>', '', 'g') AS text FROM (SELECT p_partkey, {REPLY} AS x FROM part)")
def strip_reasoning(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", f"{REPLY} AS x").select("p_partkey", X.strip_reasoning(F.col("x")).alias("text"))


TAGGED = " ".join(f"WHEN regexp_matches(r, '(?s)<{t}>.*?</{t}>') THEN regexp_extract(r, '(?s)<{t}>(.*?)</{t}>', 1)" for t in X.TAGS)
EXTRACTED = (
    f"SELECT p_partkey, regexp_replace(CASE {TAGGED} WHEN p_partkey % 9 = 3 THEN json_extract_string(regexp_extract(r, '(?s)(\\{{.*\\}})', 1), '$.sql_query') WHEN p_partkey % 9 = 4 THEN json_extract_string(r, '$.sql_query') "
    f"WHEN regexp_matches(r, '(?s)```(?:sql)?\\n.*?\\n```') THEN regexp_extract(r, '(?s)```(?:sql)?\\n(.*?)\\n```', 1) ELSE r END, '^{WS}+|{WS}+$', '', 'g') AS x "
    f"FROM (SELECT p_partkey, regexp_replace(regexp_replace(x, '(?s)###ponder###.*?###/ponder###', '', 'g'), '(?s)<thinking>.*?</thinking>', '', 'g') AS r FROM (SELECT p_partkey, {REPLY} AS x FROM part))"
)
SANITIZED = (
    "SELECT p_partkey, CASE WHEN ends_with(c, ';') AND len(list_filter(string_split(b, ';'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13)) <> '')) = 1 THEN b || ';' ELSE b END AS sql FROM ("
    f"SELECT p_partkey, c, regexp_replace(regexp_replace(c, ';+$', ''), '^{WS}+|{WS}+$', '', 'g') AS b FROM (SELECT p_partkey, regexp_replace({CLEAN}, '{WS}+$', '') AS c FROM (%s)))"
)


@add("extract_sql", SANITIZED % EXTRACTED)
def extract_sql(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{REPLY} AS x")
    return rows.select("p_partkey", X.extract_sql(F.col("x")).alias("sql"))


@add("sanitize_text", f"SELECT p_partkey, regexp_replace({CLEAN}, '^;+|;+$', '', 'g') AS sql FROM (SELECT p_partkey, {REPLY} AS x FROM part)")
def sanitize_text(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{REPLY} AS x")
    return rows.select("p_partkey", X.sanitize_executor(F.col("x")).alias("sql"))


NAMED = "CASE p_partkey % 6 WHEN 0 THEN 'mydb.public.part' WHEN 1 THEN 'mydb.part' WHEN 2 THEN 'public.part' WHEN 3 THEN 'part' WHEN 4 THEN 'Analytics.part' ELSE concat('db', CAST(p_size AS VARCHAR(9)), '.part') END"


@add("strip_db_prefix", f"SELECT p_partkey, CASE len(string_split(n, '.')) WHEN 3 THEN split_part(n, '.', 2) || '.' || split_part(n, '.', 3) WHEN 2 THEN CASE WHEN lower(split_part(n, '.', 1)) IN {X.SCHEMAS} THEN n ELSE split_part(n, '.', 2) END ELSE n END AS name FROM (SELECT p_partkey, {NAMED} AS n FROM part)")
def strip_db_prefix(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", f"{NAMED} AS n").select("p_partkey", X.strip_db_prefix(F.col("n")).alias("name"))


SLOPPY = "CASE p_partkey % 5 WHEN 0 THEN concat('{\"k\": ', CAST(p_size AS VARCHAR(9)), '}') WHEN 1 THEN concat('```json', chr(10), '{\"k\": 1}', chr(10), '```') WHEN 2 THEN '{\"k\": [1, 2,],}' WHEN 3 THEN 'so: {\"k\": 3} ok' ELSE 'nothing' END"


@add("safe_json", f"SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN x WHEN 1 THEN '{{\"k\": 1}}' WHEN 2 THEN '{{\"k\": [1, 2]}}' WHEN 3 THEN regexp_extract(x, '(\\{{.*\\}})', 1) END AS json FROM (SELECT p_partkey, {SLOPPY} AS x FROM part)")
def safe_json(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", f"{SLOPPY} AS x").select("p_partkey", X.safe_json(F.col("x")).alias("json"))


@add("first_json_object")
def first_json_object(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", f"{REPLY} AS x").select("p_partkey", J.first_json_object(F.col("x")).alias("json"))


FILE = "CASE p_partkey % 6 WHEN 0 THEN concat('../', p_name, '.txt') WHEN 1 THEN 'a/b/..hidden' WHEN 2 THEN concat(p_name, '*?', '.PDF') WHEN 3 THEN concat(repeat('x', 300), '.docx') WHEN 4 THEN 'dir/' ELSE concat('c:', chr(92), 'tmp', chr(92), p_brand) END"


@add("filename_store", f"SELECT p_partkey, CASE WHEN length(n) > 255 THEN substr(n, 1, 255 - length(e)) || e ELSE n END AS name FROM (SELECT *, regexp_extract(n, '^.*[^.].*?(\\.[^.]*)$', 1) AS e FROM (SELECT p_partkey, regexp_replace(split_part(f, '/', -1), '[^A-Za-z0-9_. -]', '_', 'g') AS n FROM (SELECT p_partkey, {FILE} AS f FROM part)))")
def filename_store(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", f"{FILE} AS f").select("p_partkey", X.filename_store(F.col("f")).alias("name"))


@add("filename_secure", f"SELECT p_partkey, CASE n WHEN '' THEN 'unnamed_file' ELSE n END AS name FROM (SELECT p_partkey, regexp_replace(regexp_replace(split_part(replace(f, chr(92), '/'), '/', -1), '^[. ]+', ''), '[^A-Za-z0-9_.-]', '_', 'g') AS n FROM (SELECT p_partkey, {FILE} AS f FROM part))")
def filename_secure(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", f"{FILE} AS f").select("p_partkey", X.filename_secure(F.col("f")).alias("name"))


PATH = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@add("download_filename", f"SELECT page_id, CASE WHEN contains(b, '.') THEN CASE WHEN n > 1 THEN regexp_replace(b, '(\\.[^.]*)$', '_' || (n - 1) || '\\1') ELSE b END ELSE CASE WHEN n > 1 THEN 'download_1700000000_' || (n - 1) || '.dat' ELSE 'download_1700000000.dat' END END AS name FROM (SELECT page_id, b, row_number() OVER (PARTITION BY CASE WHEN contains(b, '.') THEN b ELSE 'download_1700000000.dat' END ORDER BY page_id) AS n FROM (SELECT page_id, split_part({PATH}, '/', -1) AS b FROM pages))")
def download_filename(spark, d):
    """Names of downloads in order of page_id; a name that is taken gets a number before its extension."""
    from pyspark.sql import Window as W

    named = table(spark, d, "pages").select("page_id", web.download_name(F.col("url"), F.lit(1700000000)).alias("base"))
    numbered = named.withColumn("n", F.row_number().over(W.partitionBy("base").orderBy("page_id")) - 1)
    clash = F.concat(F.regexp_replace("base", r"\.[^.]*$", ""), F.lit("_"), F.col("n").cast("string"), F.regexp_extract("base", r"(\.[^.]*)$", 1))
    return numbered.select("page_id", F.when(F.col("n") > 0, clash).otherwise(F.col("base")).alias("name"))


@add("sanitize_html", "SELECT page_id, md5(replace(replace(html, '<script', '&lt;script'), 'javascript:', 'javascript&#58;')) AS digest FROM pages")
def sanitize_html(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.neutral_html(F.col("html"))).alias("digest"))


AUTH = "nullif(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '')"
URLS = "CASE page_id % 4 WHEN 0 THEN 'not a url' WHEN 1 THEN replace(url, '://', '://user:pw@') WHEN 2 THEN replace(url, '.example', '.example:8080') ELSE url END"


@add("url_netloc", f"SELECT page_id, {AUTH} AS netloc FROM (SELECT page_id, {URLS} AS u FROM pages)")
def url_netloc(spark, d):
    rows = table(spark, d, "pages").selectExpr("page_id", f"{URLS} AS u")
    return rows.select("page_id", web.netloc(F.col("u")).alias("netloc"))


@add("url_valid", f"SELECT page_id, page_id % 4 <> 0 AND {AUTH} IS NOT NULL AS valid FROM (SELECT page_id, {URLS} AS u FROM pages)")
def url_valid(spark, d):
    return table(spark, d, "pages").selectExpr("page_id", f"{URLS} AS u").select("page_id", web.url_valid(F.col("u")).alias("valid"))


DBURL = "CASE c_custkey % 7 WHEN 0 THEN 'sqlite:///data/main.db' WHEN 1 THEN concat('sqlite:///x/shop', CAST(c_custkey AS VARCHAR(9)), '.sqlite') WHEN 2 THEN 'sqlite:///7.db' WHEN 3 THEN 'postgresql://u:p@h:5432/sales?sslmode=on' WHEN 4 THEN 'postgresql://h/db' WHEN 5 THEN 'postgresql://h/' ELSE concat('mysql://h/crm', CAST(c_nationkey AS VARCHAR(9)), '#x') END"


@add("db_name_from_url", f"SELECT c_custkey, CASE WHEN n IN ('', 'db', 'database', 'main') OR (starts_with(u, 'sqlite:///') AND regexp_matches(n, '^[0-9]+$')) THEN 'primary_db' ELSE n END AS name FROM (SELECT c_custkey, u, CASE WHEN starts_with(u, 'sqlite:///') THEN split_part(split_part(u, '/', -1), '.', 1) ELSE regexp_replace(split_part(u, '/', -1), '[?#].*$', '') END AS n FROM (SELECT c_custkey, {DBURL} AS u FROM customer))")
def db_name_from_url(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey", f"{DBURL} AS u").select("c_custkey", web.db_name(F.col("u")).alias("name"))


VERDICT = "CASE p_partkey % 5 WHEN 0 THEN '{\"is_safe\": true, \"confidence\": 0.9}' WHEN 1 THEN '{\"is_safe\": true}' WHEN 2 THEN '{\"is_safe\": false, \"confidence\": 0.9}' WHEN 3 THEN 'broken' ELSE '{\"confidence\": 1.0}' END"


@add("verdict_check", "SELECT p_partkey, p_partkey % 5 = 0 AS safe FROM part")
def verdict_check(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", f"{VERDICT} AS v").select("p_partkey", guard.verdict(F.col("v")).alias("safe"))


class RuleModel:
    """A stand-in that answers in every way that models do."""

    def complete(self, role: str, prompt: str) -> str:
        sql = prompt.rsplit("\n\n", 1)[-1]
        if sql.startswith("WITH"):
            raise TimeoutError("no answer")
        for word, reply in (("DROP", "This is NOT SAFE, with high confidence."), ("UPDATE", '{"is_safe": true, "security_issues": []}'), ("UNION", "Looks fine, medium confidence."), ("EXPLAIN", 'Well: {"is_safe": tr')):
            if word in sql:
                return reply
        safe = "false" if "information_schema" in sql else "true"
        return f'Here: {{"is_safe": {safe}, "security_issues": ["{{x}}"], "confidence_level": "high", "explanation": "read"}} done'


_UNREAD = "'Could not parse security analysis from LLM response'"


@add(
    "model_verdicts",
    "SELECT p_partkey, CASE WHEN starts_with(s, 'WITH') OR contains(s, 'DROP') OR contains(s, 'UPDATE') THEN false WHEN contains(s, 'UNION') THEN true ELSE NOT contains(s, 'EXPLAIN') AND NOT contains(s, 'information_schema') END AS is_safe, "
    "CASE WHEN starts_with(s, 'WITH') OR contains(s, 'UPDATE') OR contains(s, 'EXPLAIN') THEN 'low' WHEN contains(s, 'UNION') THEN 'medium' ELSE 'high' END AS confidence, "
    f"CASE WHEN starts_with(s, 'WITH') THEN 'Analysis error occurred' WHEN contains(s, 'DROP') OR contains(s, 'UNION') OR contains(s, 'EXPLAIN') THEN {_UNREAD} WHEN contains(s, 'UPDATE') THEN 'Missing field: confidence_level' ELSE '[\"{{x}}\"]' END AS issues FROM (SELECT p_partkey, {STATEMENT} AS s FROM part)",
)
def model_verdicts(spark, d):
    """A model's word on each statement: JSON, broken JSON, prose, silence."""
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{STATEMENT} AS s")
    return judged(rows, "s", RuleModel()).select("p_partkey", "is_safe", "confidence", "issues")


SAID = "CASE event_id % 8 WHEN 0 THEN ' TRUE ' WHEN 1 THEN '1' WHEN 2 THEN 'Yes' WHEN 3 THEN 'no' WHEN 4 THEN 'f' WHEN 5 THEN '' WHEN 6 THEN 'N' ELSE 'false' END"


@add("str_to_bool", f"SELECT event_id, CASE WHEN lower(trim(s)) IN ('true', '1', 'yes', 'y') THEN true WHEN lower(trim(s)) IN ('false', '0', 'no', 'n') THEN false ELSE true END AS flag FROM (SELECT event_id, {SAID} AS s FROM events)")
def str_to_bool(spark, d):
    return table(spark, d, "events").selectExpr("event_id", f"{SAID} AS s").select("event_id", X.str_to_bool(F.col("s"), True).alias("flag"))


@add("answerable_flag", "SELECT event_id, contains(s, 'true') OR contains(s, 'yes') AS substring, regexp_matches(s, '\\b(true|yes)\\b') AS word FROM (SELECT event_id, lower(CASE event_id % 4 WHEN 0 THEN 'Yes, enough' WHEN 1 THEN 'Since yesterday' WHEN 2 THEN 'TRUE' ELSE 'no' END) AS s FROM events)")
def answerable_flag(spark, d):
    s = table(spark, d, "events").selectExpr("event_id", "CASE event_id % 4 WHEN 0 THEN 'Yes, enough' WHEN 1 THEN 'Since yesterday' WHEN 2 THEN 'TRUE' ELSE 'no' END AS s")
    return s.select("event_id", X.answerable(F.col("s")).alias("substring"), X.answerable(F.col("s"), True).alias("word"))


@add("route_rag_sql", "SELECT conv_id, turn, CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in X.DATABASE_WORDS) + " THEN 'sql' ELSE 'rag' END AS route FROM conversations")
def route_rag_sql(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(X.asks_database(F.col("text")), "sql").otherwise("rag").alias("route"))


@add("session_id", "SELECT event_id, sha256(CAST(user_id AS VARCHAR) || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || '10.0.0.1') AS session FROM events")
def session_id(spark, d):
    return table(spark, d, "events").select("event_id", X.session_id(F.col("user_id"), F.round(F.col("value") * 100).cast("long"), F.lit("10.0.0.1")).alias("session"))


@add("backoff_schedule", "SELECT user_id, CAST(n AS BIGINT) AS attempts, round(0.5 * pow(2, n % 10), 6) AS delay FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id)")
def backoff_schedule(spark, d):
    n = table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("attempts"))
    return n.select("user_id", "attempts", F.round(X.backoff(F.lit(0.5), F.col("attempts") % 10), 6).alias("delay"))


@add("context_numbering", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, 'Context ' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS label FROM conversations")
def context_numbering(spark, d):
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", n.cast("long").alias("position"), F.concat(F.lit("Context "), n.cast("string")).alias("label"))


@add("augment_context", "SELECT conv_id, md5('Use the following context to answer the question:' || chr(10) || string_agg(chr(10) || 'Context ' || n || ':' || chr(10) || substr(text, 1, 500) || chr(10), chr(10) ORDER BY turn) || chr(10) || chr(10) || 'Question: q' || conv_id) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id")
def augment_context(spark, d):
    parts = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    grouped = table(spark, d, "conversations").groupBy("conv_id").agg(parts.alias("parts"))
    return grouped.select("conv_id", F.md5(X.context_prompt(F.col("parts"), F.concat(F.lit("q"), F.col("conv_id").cast("string")))).alias("digest"))


@add("search_source_label", "WITH h AS (SELECT page_id // 6 AS g, page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages), f AS (SELECT g, host, min(page_id) AS p FROM h GROUP BY g, host), n AS (SELECT g, count(*) AS n FROM h GROUP BY g), m AS (SELECT g, count(*) AS m, array_to_string((list(host ORDER BY p))[1:3], ', ') AS s, min_by(host, p) AS one FROM f GROUP BY g) SELECT g, CASE WHEN m = 1 THEN one ELSE 'Search (' || n || ' results from ' || m || ' sources: ' || s || ')' || CASE WHEN m > 3 THEN '...' ELSE '' END END AS label FROM n JOIN m USING (g)")
def search_source_label(spark, d):
    """Six hits make a search result: its label names their hosts in order of appearance."""
    hit = F.struct("page_id", F.lit(None).cast("string").alias("title"), "url", F.lit(None).cast("string").alias("source"))
    grouped = table(spark, d, "pages").groupBy(F.expr("page_id div 6").alias("g")).agg(F.sort_array(F.collect_list(hit)).alias("h"))
    return grouped.select("g", source_of_hits(F.col("h"), F.lit(None).cast("string")).alias("label"))


@add("error_summary", "SELECT user_id, string_agg('E' || event_id, '; ' ORDER BY event_id) AS errors FROM events WHERE event_type = 'error' GROUP BY user_id")
def error_summary(spark, d):
    bad = table(spark, d, "events").where("event_type = 'error'")
    said = F.transform(F.sort_array(F.collect_list("event_id")), lambda e: F.concat(F.lit("E"), e.cast("string")))
    return bad.groupBy("user_id").agg(F.array_join(said, "; ").alias("errors"))


@add("format_results")
def format_results(spark, d):
    """Results per source class as JSON for a prompt."""
    rows = table(spark, d, "nation").select(F.when(F.col("n_regionkey") == 0, "DATABASE").when(F.col("n_regionkey") == 1, "MCP_SERVICE").otherwise("OTHER").alias("source"), "n_nationkey", "n_name")
    return rows.groupBy("source").agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("results"))
