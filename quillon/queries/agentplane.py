"""Tool calls, routers, reducers and unified results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import normalize as N
from ..operators import routing as G
from ..operators import toolcalls as C
from ..plans.agent import Agent
from .common import SERVICE, Registry, table

REGISTRY = Registry()
add = REGISTRY.add

FLAGS = {"sql": False, "download": False}
LOW = "lower(service_id)"
KIND = f"CASE WHEN contains({LOW}, 'sql') OR contains({LOW}, 'database') THEN 'sql' WHEN contains({LOW}, 'search') OR contains({LOW}, 'web') THEN 'search' WHEN contains({LOW}, 'dns') THEN 'dns' WHEN contains({LOW}, 'download') THEN 'download' ELSE '' END"
CALLS = f"(SELECT event_id AS ordinal, {SERVICE} AS service_id, event_type AS method FROM events)"


def _calls(spark, d):
    return table(spark, d, "events").selectExpr("event_id AS ordinal", f"{SERVICE} AS service_id", "event_type AS method")


@add("toolcall_filter", f"SELECT ordinal, service_id FROM {CALLS} WHERE {KIND} NOT IN ('sql', 'download')")
def toolcall_filter(spark, d):
    return _calls(spark, d).where(C.enabled(F.col("service_id"), FLAGS)).select("ordinal", "service_id")


@add("toolcall_filter_rag", f"SELECT ordinal, service_id FROM {CALLS} WHERE {KIND} NOT IN ('sql', 'download') AND NOT ({KIND} = '' AND contains({LOW}, 'rag'))")
def toolcall_filter_rag(spark, d):
    return _calls(spark, d).where(C.enabled(F.col("service_id"), FLAGS | {"rag": False}, with_rag=True)).select("ordinal", "service_id")


@add("toolcall_reorder", f"SELECT plan, ordinal, row_number() OVER (PARTITION BY plan ORDER BY CASE WHEN contains({LOW}, 'search') OR contains({LOW}, 'web') THEN 0 WHEN contains({LOW}, 'rag') THEN 1 WHEN contains({LOW}, 'sql') OR contains({LOW}, 'database') THEN 2 WHEN contains({LOW}, 'dns') THEN 3 ELSE 4 END, ordinal) AS place FROM (SELECT event_id AS ordinal, user_id AS plan, {SERVICE} AS service_id FROM events)")
def toolcall_reorder(spark, d):
    """A plan's calls by kind, then as planned; a plan is the calls for one user."""
    from pyspark.sql import Window as W

    plan = table(spark, d, "events").selectExpr("event_id AS ordinal", "user_id AS plan", f"{SERVICE} AS service_id")
    place = F.row_number().over(W.partitionBy("plan").orderBy(C.priority(F.col("service_id")), "ordinal"))
    return plan.select("plan", "ordinal", place.cast("long").alias("place"))


JSON_CALL = "CASE event_id % 4 WHEN 0 THEN concat('{\"service_id\": \"s', CAST(user_id AS VARCHAR(9)), '\", \"method\": \"m\", \"params\": ', props, '}') WHEN 1 THEN '{\"service_id\": \"only\"}' WHEN 2 THEN 'no call' ELSE '[1]' END"


@add("toolcall_validate", f"SELECT event_id, coalesce(json_extract_string(j, '$.service_id'), '') AS service_id, coalesce(json_extract_string(j, '$.method'), '') AS method, replace(coalesce(CAST(json_extract(j, '$.params') AS VARCHAR), '{{}}'), ' ', '') AS params FROM (SELECT event_id, {JSON_CALL} AS j FROM events WHERE event_id % 4 < 2)")
def toolcall_validate(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id", f"{JSON_CALL} AS j").select("event_id", C.validated(F.col("j")).alias("c")).where("c is not null")
    return rows.select("event_id", "c.service_id", "c.method", F.replace("c.params", F.lit(" "), F.lit("")).alias("params"))


OTHER_CALL = "CASE event_id % 3 WHEN 0 THEN concat('{\"service\": \"a\", \"method\": \"m\", \"params\": {\"k\": \"p\", \"q\": \"', event_type, '\"}, \"k\": \"top\"}') WHEN 1 THEN '{\"service_id\": \"b\", \"action\": \"x\", \"parameters\": {\"k\": \"1\", \"z\": \"2\"}, \"params\": {\"k\": \"3\"}}' ELSE '{\"service_id\": \"\", \"service\": \"c\"}' END"


@add("toolcall_normalize", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS service_id, CASE event_id % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'x' END AS action, CASE event_id % 3 WHEN 0 THEN 'top' WHEN 1 THEN '3' END AS k, CASE event_id % 3 WHEN 0 THEN event_type END AS q, CASE event_id % 3 WHEN 1 THEN '2' END AS z, CASE event_id % 3 WHEN 2 THEN 0 ELSE 2 END AS n FROM events")
def toolcall_normalize(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id", f"{OTHER_CALL} AS j").select("event_id", C.normalized(F.col("j")).alias("c"))
    p = F.col("c.parameters")
    return rows.select("event_id", "c.service_id", "c.action", p["k"].alias("k"), p["q"].alias("q"), p["z"].alias("z"), F.size(p).alias("n"))


PLAN = "CASE event_id % 5 WHEN 0 THEN '{\"tool_call\":{\"a\":1}}' WHEN 1 THEN '[{\"a\":2}]' WHEN 2 THEN '{\"tool_calls\":[{\"a\":3}]}' WHEN 3 THEN '{\"a\":4}' ELSE 'nothing' END"


@add("toolcall_wrap", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN '[{\"a\":1}]' WHEN 1 THEN '[{\"a\":2}]' WHEN 2 THEN '[{\"a\":3}]' WHEN 3 THEN '[{\"a\":4}]' END AS calls FROM events")
def toolcall_wrap(spark, d):
    return table(spark, d, "events").selectExpr("event_id", f"{PLAN} AS j").select("event_id", C.wrapped(F.col("j")).alias("calls"))


SERVICES = "(VALUES ('sql-server', 'h1', 1), ('rag-store', 'h2', 2), ('brave-search', 'h3', 3)) s(id, host, port)"


@add("toolcall_service_join", f"SELECT ordinal, service_id, host, port, CASE WHEN id IS NULL THEN 'error' ELSE 'ready' END AS status, CASE WHEN id IS NULL THEN 'Service ' || service_id || ' not found' END AS error FROM {CALLS} LEFT JOIN {SERVICES} ON id = service_id")
def toolcall_service_join(spark, d):
    services = spark.createDataFrame([("sql-server", "h1", 1), ("rag-store", "h2", 2), ("brave-search", "h3", 3)], "id string, host string, port int")
    return C.with_service(_calls(spark, d), services).drop("method")


@add("toolcall_outcomes", "SELECT count(*) FILTER (WHERE event_type <> 'error' AND value > 1) AS successes, count(*) FILTER (WHERE NOT (event_type <> 'error' AND value > 1)) AS errors, count(*) AS total FROM events")
def toolcall_outcomes(spark, d):
    rows = table(spark, d, "events").select(F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"), F.when(F.col("value") > 1, F.col("props")).alias("result"))
    return C.outcomes(rows)


COUNTED = ("nation", "customer", "orders", "lineitem", "events", "documents", "pages")


@add("parallel_dispatch", " UNION ALL ".join(f"SELECT {i} AS ordinal, 'count-{t}' AS service_id, 'success' AS status, count(*) AS n FROM {t}" for i, t in enumerate(COUNTED)) + f" UNION ALL SELECT {len(COUNTED)}, 'missing', 'error', NULL")
def parallel_dispatch(spark, d):
    """A call per table, whose jobs run at once from driver threads; a switched-off one is left out, a missing one is an error."""
    from ..plans.agent import Tool

    tools = {f"count-{t}": Tool({"name": str}, lambda name: table(spark, d, name)) for t in COUNTED}
    calls = [{"service_id": f"count-{t}", "params": {"name": t}} for t in COUNTED]
    done = Agent(tools, {"sql": False}).run([*calls, {"service_id": "sql-x"}, {"service_id": "missing"}], read=lambda df: df.count())
    return spark.createDataFrame([(i, r["service_id"], r["status"], r.get("result")) for i, r in enumerate(done)], "ordinal int, service_id string, status string, n long")


STATE = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'v' ELSE '' END AS verr, CASE WHEN event_id % 5 = 0 THEN 'e' END AS xerr, CASE WHEN event_id % 7 = 0 THEN 'g' END AS gerr, event_id % 13 AS retries, CASE WHEN event_id % 2 = 0 THEN 'initial' WHEN event_id % 11 = 0 THEN NULL ELSE 'wider_search' END AS qtype, event_id % 4 AS rows, event_id % 2 = 1 AS off, event_id % 3 AS calls, event_id % 5 < 2 AS use_results FROM events"


def _state(spark, d):
    return table(spark, d, "events").selectExpr(*STATE.removeprefix("SELECT ").removesuffix(" FROM events").replace(", CASE", "\nCASE").replace(", event_id", "\nevent_id").split("\n"))


@add("route_refine", f"SELECT event_id, CASE WHEN (coalesce(verr, '') <> '' OR coalesce(xerr, '') <> '' OR coalesce(gerr, '') <> '') AND retries < 10 THEN 'refine' ELSE 'respond' END AS next FROM ({STATE})")
def route_refine(spark, d):
    return _state(spark, d).select("event_id", G.refine(F.col("verr"), F.col("xerr"), F.col("gerr"), F.col("retries")).alias("next"))


@add("route_wider", f"SELECT event_id, CASE WHEN coalesce(xerr, '') <> '' THEN 'wider_search' WHEN rows = 0 AND coalesce(qtype, 'initial') = 'initial' AND retries < 10 THEN 'wider_search' ELSE 'respond' END AS next FROM ({STATE})")
def route_wider(spark, d):
    return _state(spark, d).select("event_id", G.wider(F.col("xerr"), F.col("rows"), F.col("qtype"), F.col("retries")).alias("next"))


@add("route_continue", f"SELECT event_id, CASE WHEN (coalesce(xerr, '') <> '' OR rows = 0) AND retries < 10 THEN 'wider_search' ELSE 'respond' END AS next FROM ({STATE})")
def route_continue(spark, d):
    return _state(spark, d).select("event_id", G.keep_widening(F.col("xerr"), F.col("rows"), F.col("retries")).alias("next"))


@add("route_validation", f"SELECT event_id, CASE WHEN coalesce(verr, '') <> '' THEN 'refine_sql' WHEN qtype = 'wider_search' THEN 'execute_wider_search' ELSE 'execute_sql' END AS next FROM ({STATE})")
def route_validation(spark, d):
    return _state(spark, d).select("event_id", G.after_validation(F.col("verr"), F.col("qtype")).alias("next"))


@add("route_after_tools", f"SELECT event_id, CASE WHEN off AND calls > 0 THEN 'execute_mcp_tool_calls_and_return' WHEN off AND use_results AND rows > 0 THEN 'generate_prompt' WHEN off THEN 'execute_mcp_tool_calls_and_return' WHEN calls > 0 AND rows > 0 THEN 'return_mcp_response_to_llm' ELSE 'generate_sql' END AS next FROM ({STATE})")
def route_after_tools(spark, d):
    return _state(spark, d).select("event_id", G.after_tools(F.col("off"), F.col("calls"), F.col("use_results"), F.col("rows")).alias("next"))


@add("route_iterate", f"SELECT event_id, CASE WHEN use_results THEN 'generate_final_answer' WHEN calls < rows THEN 'plan_refined_queries' ELSE 'generate_failure_response' END AS next FROM ({STATE})")
def route_iterate(spark, d):
    return _state(spark, d).select("event_id", G.iterate(F.col("use_results"), F.col("calls"), F.col("rows")).alias("next"))


@add("state_reduce", "SELECT conv_id, max_by(text, turn) AS answer, string_agg(role, ',' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars, min_by(role, turn) AS first_role FROM conversations GROUP BY conv_id")
def state_reduce(spark, d):
    deltas = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("answer"), F.col("role").alias("roles"), F.length("text").cast("long").alias("chars"), F.col("role").alias("first_role"))
    out = G.reduce_states(deltas, "conv_id", "turn", replace=["answer"], append=["roles"], add=["chars"], keep=["first_role"])
    return out.withColumn("roles", F.array_join("roles", ","))


@add("infer_service", f"SELECT ordinal, CASE WHEN contains({LOW}, 'search') OR contains({LOW}, 'web') OR contains({LOW}, 'brave') THEN 'search' WHEN contains({LOW}, 'rag') OR contains({LOW}, 'vector') THEN 'rag' WHEN contains({LOW}, 'download') OR contains({LOW}, 'file') THEN 'download' WHEN contains({LOW}, 'sql') OR contains({LOW}, 'database') THEN 'sql' WHEN contains({LOW}, 'dns') THEN 'dns' ELSE 'generic' END AS kind FROM {CALLS}")
def infer_service(spark, d):
    return _calls(spark, d).select("ordinal", C.service_kind(F.col("service_id"), F.col("method")).alias("kind"))


@add("enhance_results", f"SELECT ordinal, CASE WHEN contains({LOW}, 'search') OR contains({LOW}, 'web') THEN 'search' WHEN contains({LOW}, 'rag') OR contains({LOW}, 'vector') THEN 'rag' WHEN contains({LOW}, 'download') THEN 'download' WHEN contains({LOW}, 'sql') OR contains({LOW}, 'database') THEN 'sql' WHEN contains({LOW}, 'dns') THEN 'dns' ELSE 'generic' END AS type, '2024-02-01' AS enhanced_at FROM {CALLS}")
def enhance_results(spark, d):
    return N.enhanced(_calls(spark, d).withColumn("action", F.col("method")), F.lit("2024-02-01")).select("ordinal", "type", "enhanced_at")


RAW = (
    "CASE WHEN event_id % 10 = 7 THEN 'no object' ELSE CASE event_id % 9 WHEN 0 THEN '{\"result\": {\"rows\": [{\"a\": 1}, {\"a\": 2}]}}' WHEN 1 THEN '{\"rows\": []}' "
    "WHEN 2 THEN concat('{\"results\": [{\"url\": \"http://h', CAST(user_id AS VARCHAR(9)), '/a\", \"description\": \"D\"}, {\"url\": \"http://other/b\"}]}') WHEN 3 THEN '{\"result\": {\"results\": []}}' "
    "WHEN 4 THEN concat('{\"documents\": [{\"content\": \"', event_type, '\"}]}') WHEN 5 THEN '{\"addresses\": [\"1.1.1.1\", \"2.2.2.2\", \"3.3.3.3\"]}' WHEN 6 THEN concat('{\"result\": {\"path\": \"/tmp/d/', CAST(event_id AS VARCHAR(9)), '.pdf\"}}') "
    "ELSE '{}' END END"
)


@add(
    "enhanced_fields",
    "SELECT event_id, CASE WHEN bad THEN 'enhancement_error' ELSE (['sql', 'sql', 'search', 'search', 'rag', 'dns', 'download', 'rag', 'generic'])[n + 1] || '_enhanced' END AS type, CASE WHEN bad THEN 'Cannot enhance: result is not a valid dictionary' END AS error, "
    "CASE WHEN NOT bad THEN ([2, 0, 2, 0, 1, 3, NULL, NULL, NULL])[n + 1] END AS row_count, CASE WHEN NOT bad THEN CASE n WHEN 2 THEN 'h' || user_id || ',other' WHEN 3 THEN '' END END AS hosts, "
    "CASE WHEN NOT bad THEN CASE n WHEN 2 THEN 'D' WHEN 4 THEN event_type END END AS summary, CASE WHEN NOT bad AND n = 6 THEN event_id || '.pdf' END AS file_name FROM (SELECT *, event_id % 9 AS n, event_id % 10 = 7 AS bad FROM events)",
)
def enhanced_fields(spark, d):
    """Results of each kind with the fields that kind gives."""
    rows = table(spark, d, "events").selectExpr("event_id", f"{SERVICE} AS service_id", f"{RAW} AS raw")
    return N.enhance(rows, F.lit("2024-02-01")).select("event_id", "type", "error", "row_count", "hosts", "summary", "file_name")


HITS = "concat('[{\"title\":\"T', CAST(page_id AS VARCHAR(9)), '\",\"url\":\"', url, '\",\"description\":\"D\"},{\"url\":\"http://other.net/x\",\"summary\":\"S\"}]')"
SEARCH = f"CASE page_id % 4 WHEN 0 THEN concat('{{\"service_id\":\"web\",\"result\":{{\"result\":{{\"results\":', {HITS}, '}}}}}}') WHEN 1 THEN concat('{{\"result\":{{\"results\":', {HITS}, '}}}}') WHEN 2 THEN concat('{{\"results\":', {HITS}, ',\"score\":0.5}}') ELSE '{{\"service_id\":\"empty-web\",\"results\":[]}}' END"
HOST = "regexp_extract(url, '://([^/?#]*)', 1)"


@add(
    "normalize_search",
    f"SELECT page_id, CASE WHEN k THEN 'Title: T' || page_id || chr(10) || 'URL: ' || url || chr(10) || 'Description: D' || chr(10) || chr(10) || 'Title: No Title' || chr(10) || 'URL: http://other.net/x' || chr(10) || 'Description: S' || chr(10) ELSE '' END AS content, "
    f"CASE WHEN k THEN 'T' || page_id ELSE 'Search Results' END AS title, CASE WHEN k THEN url ELSE '' END AS url, CASE WHEN k THEN 'Search (2 results from 2 sources: ' || {HOST} || ', other.net)' ELSE 'empty-web' END AS source, 'web_search' AS source_type, CASE WHEN page_id % 4 = 2 THEN 0.5 ELSE 0.0 END AS relevance_score, k AS full_content_available FROM (SELECT *, page_id % 4 <> 3 AS k FROM pages)",
)
def normalize_search(spark, d):
    rows = table(spark, d, "pages").selectExpr("page_id", f"{SEARCH} AS raw")
    return N.normalized(rows, kind=F.lit("search")).select("page_id", "content", "title", "url", "source", "source_type", "relevance_score", "full_content_available")


RAG = "CASE page_id % 4 WHEN 0 THEN concat('{\"content\":\"C\",\"metadata\":{\"source\":\"src\",\"title\":\"MT\"},\"score\":0.25}') WHEN 1 THEN '{\"page_content\":\"P\",\"title\":\"T\",\"metadata\":{\"file_path\":\"a/b.txt\"}}' WHEN 2 THEN '{\"text\":\"X\",\"source\":\"top\",\"metadata\":{}}' ELSE '{\"metadata\":{}}' END"


@add("normalize_rag", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'P' WHEN 2 THEN 'X' ELSE '' END AS content, CASE page_id % 4 WHEN 0 THEN 'MT' WHEN 1 THEN 'T' ELSE 'RAG Document' END AS title, CASE page_id % 4 WHEN 1 THEN 'a/b.txt' ELSE '' END AS url, CASE page_id % 4 WHEN 0 THEN 'src' WHEN 1 THEN 'b.txt' WHEN 2 THEN 'top' ELSE 'RAG Document' END AS source, 'local_document' AS source_type, CASE page_id % 4 WHEN 0 THEN 0.25 ELSE 0.0 END AS relevance_score FROM pages")
def normalize_rag(spark, d):
    rows = table(spark, d, "pages").selectExpr("page_id", f"{RAG} AS raw")
    return N.normalized(rows, kind=F.lit("rag")).select("page_id", "content", "title", "url", "source", "source_type", "relevance_score")


LOADED = "CASE page_id % 4 WHEN 0 THEN '{\"status\":\"success\",\"result\":{\"result\":{\"file_path\":\"f/x\",\"url\":\"http://u\"}}}' WHEN 1 THEN '{\"status\":\"success\",\"result\":{\"file_path\":\"g/y\"}}' WHEN 2 THEN '{\"status\":\"error\",\"error\":\"gone\"}' ELSE '{\"status\":\"success\",\"result\":\"plain\"}' END"


@add("normalize_download", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Successfully downloaded content to: f/x' WHEN 1 THEN 'Successfully downloaded content to: g/y' WHEN 2 THEN 'Download failed: gone' ELSE 'plain' END AS content, CASE page_id % 4 WHEN 0 THEN 'http://u' ELSE '' END AS url, CASE page_id % 4 WHEN 0 THEN 'f/x' WHEN 1 THEN 'g/y' WHEN 2 THEN 'Download Service (Error)' ELSE 'Download Service' END AS source, 'download_result' AS source_type FROM pages")
def normalize_download(spark, d):
    rows = table(spark, d, "pages").selectExpr("page_id", f"{LOADED} AS raw")
    return N.normalized(rows, kind=F.lit("download")).select("page_id", "content", "url", "source", "source_type")


OTHER = "CASE page_id % 4 WHEN 0 THEN '{\"service_id\":\"sql-1\",\"content\":\"rows\"}' WHEN 1 THEN '{\"service\":\"dns\",\"result\":\"1.2.3.4\",\"title\":\"A\"}' WHEN 2 THEN '{\"source\":\"s\",\"result\":{\"a\":1}}' ELSE 'broken' END"


@add("normalize_generic", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'rows' WHEN 1 THEN '1.2.3.4' WHEN 2 THEN '{\"a\":1}' ELSE 'broken' END AS content, CASE page_id % 4 WHEN 1 THEN 'A' WHEN 3 THEN 'Error Processing Result' ELSE 'Generic Result' END AS title, CASE page_id % 4 WHEN 0 THEN 'sql-1' WHEN 1 THEN 'dns' WHEN 2 THEN 's' ELSE 'Error Source' END AS source, CASE page_id % 4 WHEN 0 THEN 'sql' WHEN 1 THEN 'dns' ELSE 'generic' END AS source_type, CASE page_id % 4 WHEN 3 THEN 'Error occurred during result normalization' ELSE '' END AS summary FROM pages")
def normalize_generic(spark, d):
    rows = table(spark, d, "pages").selectExpr("page_id", f"{OTHER} AS raw")
    return N.normalized(rows).select("page_id", "content", "title", "source", "source_type", "summary")


SHAPES = "CASE page_id % 6 WHEN 0 THEN '{\"result\":[{\"a\":1}]}' WHEN 1 THEN '{\"result\":{\"results\":[{\"a\":2}]}}' WHEN 2 THEN '{\"results\":[{\"a\":3}]}' WHEN 3 THEN '{\"content\":\"c\",\"metadata\":{}}' WHEN 4 THEN '[{\"a\":5}]' ELSE '{\"x\":1}' END"


@add("rag_shapes", "SELECT page_id, CASE page_id % 6 WHEN 0 THEN '[{\"a\":1}]' WHEN 1 THEN '[{\"a\":2}]' WHEN 2 THEN '[{\"a\":3}]' WHEN 3 THEN '[{\"content\":\"c\",\"metadata\":{}}]' WHEN 4 THEN '[{\"a\":5}]' ELSE '[]' END AS documents FROM pages")
def rag_shapes(spark, d):
    return table(spark, d, "pages").selectExpr("page_id", f"{SHAPES} AS raw").select("page_id", strip(N.document_list(F.col("raw"))).alias("documents"))
