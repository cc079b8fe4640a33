"""Results of different services as rows of one schema.

id, content, title, url, source, source_type, relevance_score, summary, full_content_available, and metadata: a struct of
original_source_field, service_used, raw_result. Ids are derived from the raw result, so that runs agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import probe
from ..functions.text import basename, non_empty
from ..functions.web import netloc
from .toolcalls import service_kind

HIT = "array<struct<title:string,url:string,description:string,summary:string,content:string,source:string>>"


def get(raw: Column, *paths: str) -> Column:
    """The first of the paths with a value that isn't empty."""
    return F.coalesce(*(non_empty(F.get_json_object(raw, f"$.{p}")) for p in paths))


def hits(raw: Column) -> Column:
    """The array of search hits, wherever it is nested; null without one."""
    return F.from_json(probe(raw, "$.result.result.results", "$.result.results", "$.results"), HIT)


def source_of_hits(h: Column, fallback: Column) -> Column:
    """A label for where hits come from: one host; or how many hits from how many hosts, with the first three."""
    hosts = F.array_distinct(F.filter(F.transform(h, lambda x: netloc(x["url"])), lambda x: x.isNotNull() & (x != "")))
    n, m = F.size(h), F.size(hosts)
    shown = F.concat(F.array_join(F.slice(hosts, 1, 3), ", "), F.lit(")"), F.when(m > 3, "...").otherwise(""))
    many = F.concat(F.lit("Search ("), n.cast("string"), F.lit(" results from "), m.cast("string"), F.lit(" sources: "), shown)
    first = F.get(h, F.lit(0))
    single = F.coalesce(non_empty(F.get(hosts, F.lit(0))), non_empty(first["title"]), first["source"], F.lit("Search Result"))
    label = F.when(n == 1, single).when(m == 1, F.get(hosts, F.lit(0))).when(m > 1, many).otherwise(F.concat(F.lit("Search ("), n.cast("string"), F.lit(" results)")))
    return F.when(F.coalesce(n, F.lit(0)) > 0, label).otherwise(F.coalesce(non_empty(fallback), F.lit("Web Search")))


def _hit_text(h: Column) -> Column:
    said = F.coalesce(h["description"], h["summary"], h["content"], F.lit("No description"))
    return F.concat(F.lit("Title: "), F.coalesce(h["title"], F.lit("No Title")), F.lit("\nURL: "), F.coalesce(h["url"], F.lit("")), F.lit("\nDescription: "), said, F.lit("\n"))


def _row(raw: Column, content: Column, title: Column, url: Column, source: Column, kind: Column) -> list[Column]:
    content = F.coalesce(content, F.lit(""))
    return [
        F.coalesce(get(raw, "id", "_id"), F.sha2(raw, 256)).alias("id"),
        content.alias("content"),
        title.alias("title"),
        F.coalesce(url, F.lit("")).alias("url"),
        source.alias("source"),
        kind.alias("source_type"),
        F.coalesce(get(raw, "score", "relevance_score").cast("double"), F.lit(0.0)).alias("relevance_score"),
        F.lit("").alias("summary"),
        (content != "").alias("full_content_available"),
        F.struct(
            F.coalesce(get(raw, "source"), F.lit("")).alias("original_source_field"),
            F.coalesce(get(raw, "service_id", "service"), F.lit("")).alias("service_used"),
            raw.alias("raw_result"),
        ).alias("metadata"),
    ]


def search(raw: Column) -> list[Column]:
    h = hits(raw)
    first = F.get(h, F.lit(0))
    return _row(
        raw, F.array_join(F.transform(h, _hit_text), "\n"), F.coalesce(non_empty(first["title"]), F.lit("Search Results")), first["url"],
        source_of_hits(h, get(raw, "service_id", "service")), F.lit("web_search"),
    )


def rag(raw: Column) -> list[Column]:
    path = get(raw, "metadata.file_path", "metadata.stored_file_path")
    return _row(
        raw, get(raw, "content", "page_content", "text"), F.coalesce(get(raw, "title", "metadata.title", "metadata.source"), F.lit("RAG Document")),
        get(raw, "url", "metadata.url", "metadata.stored_file_path", "metadata.file_path"),
        F.coalesce(get(raw, "metadata.source", "source"), basename(path), F.lit("RAG Document")), F.lit("local_document"),
    )


def download(raw: Column) -> list[Column]:
    good = F.coalesce(get(raw, "status") == "success", F.lit(False))
    path = get(raw, "result.result.file_path", "result.file_path")
    plain = F.when(~F.coalesce(get(raw, "result").startswith("{"), F.lit(False)), get(raw, "result"))
    done = F.coalesce(F.concat(F.lit("Successfully downloaded content to: "), path), plain)
    failed = F.concat(F.lit("Download failed: "), F.coalesce(get(raw, "error"), F.lit("Unknown error")))
    return _row(
        raw, F.when(good, done).otherwise(failed), F.lit("Download Result"), F.when(good, get(raw, "result.result.url", "result.url")),
        F.when(good, F.coalesce(path, F.lit("Download Service"))).otherwise("Download Service (Error)"), F.lit("download_result"),
    )


def generic(raw: Column, kind: Column) -> list[Column]:
    return _row(
        raw, get(raw, "content", "result"), F.coalesce(get(raw, "title"), F.lit("Generic Result")), get(raw, "url"),
        F.coalesce(get(raw, "service_id", "service", "source"), F.lit("Generic Service")), kind,
    )


def normalized(df: DataFrame, raw: str = "raw", kind: Column | None = None) -> DataFrame:
    """df's JSON results as unified rows, whatever service they come from (inferred where kind isn't given). Text that is
    no JSON object gives a row that says so, and none is dropped."""
    r = F.col(raw)
    kind = service_kind(get(r, "service_id", "service"), get(r, "action")) if kind is None else kind
    bad = F.try_parse_json(r).isNull() | ~F.coalesce(F.ltrim(r).startswith("{"), F.lit(False))
    forms = {"search": search(r), "rag": rag(r), "download": download(r)}
    other = generic(r, F.col("__kind"))
    names = ["id", "content", "title", "url", "source", "source_type", "relevance_score", "summary", "full_content_available", "metadata"]
    error = {"content": F.coalesce(r, F.lit("")), "title": F.lit("Error Processing Result"), "source": F.lit("Error Source"), "summary": F.lit("Error occurred during result normalization"), "full_content_available": F.lit(False)}
    out = []
    for i, name in enumerate(names):
        c = F.when(F.col("__bad"), error[name]) if name in error else None
        for k, form in forms.items():
            c = F.when(F.col("__kind") == k, form[i]) if c is None else c.when(F.col("__kind") == k, form[i])
        out.append(c.otherwise(other[i]).alias(name))
    marked = df.withColumns({"__bad": bad, "__kind": F.when(bad, "generic").otherwise(kind)})
    return marked.select(*df.columns, *out)


def document_list(raw: Column) -> Column:
    """The JSON array of documents in a retrieval result, for each of its known shapes; [] for others."""
    text = F.trim(raw)
    result, nested, direct = (F.get_json_object(text, p) for p in ("$.result", "$.result.results", "$.results"))
    single = F.get_json_object(text, "$.content").isNotNull() & F.get_json_object(text, "$.metadata").isNotNull()
    return (
        F.when(result.startswith("["), result).when(nested.startswith("["), nested).when(direct.startswith("["), direct)
        .when(single, F.concat(F.lit("["), text, F.lit("]"))).when(text.startswith("["), text).otherwise("[]")
    )


def _sql_fields(raw: Column) -> dict[str, Column]:
    return {"row_count": F.json_array_length(probe(raw, "$.result.rows", "$.rows"))}


def _search_fields(raw: Column) -> dict[str, Column]:
    """How many hits, from which hosts, and the best text of the first."""
    h = hits(raw)
    hosts = F.array_distinct(F.filter(F.transform(h, lambda x: netloc(x["url"])), lambda x: F.coalesce(x != "", F.lit(False))))
    first = F.get(h, F.lit(0))
    return {"row_count": F.size(h), "hosts": F.array_join(hosts, ","), "summary": F.coalesce(non_empty(first["summary"]), non_empty(first["content"]), first["description"])}


def _rag_fields(raw: Column) -> dict[str, Column]:
    documents = probe(raw, "$.result.documents", "$.documents", "$.results")
    return {"row_count": F.json_array_length(documents), "summary": F.get_json_object(documents, "$[0].content")}


def _download_fields(raw: Column) -> dict[str, Column]:
    return {"file_name": basename(get(raw, "result.path", "result.file_path", "path"))}


def _dns_fields(raw: Column) -> dict[str, Column]:
    return {"row_count": F.json_array_length(probe(raw, "$.result.addresses", "$.addresses"))}


#: What results of a kind get besides their stamp: columns of the raw JSON. Kinds that aren't here get the stamp alone.
ENHANCERS: dict[str, Callable[[Column], dict[str, Column]]] = {"sql": _sql_fields, "search": _search_fields, "rag": _rag_fields, "download": _download_fields, "dns": _dns_fields}


def enhance(df: DataFrame, as_of: Column, raw: str = "raw", service: str = "service_id", enhancers: dict[str, Callable[[Column], dict[str, Column]]] | None = None) -> DataFrame:
    """df with `type` (kind and _enhanced), `enhanced_at`, and the columns of all enhancers, which are null for other kinds. What is no JSON object
    becomes an enhancement_error. enhancers replace and add to those that there are. One pass: each kind's columns are computed where it applies."""
    table = ENHANCERS | (enhancers or {})
    kind = F.when(F.json_object_keys(raw).isNotNull(), service_kind(F.col(service), F.lit("")))
    fields: dict[str, list[Column]] = {}
    for k, make in table.items():
        for name, c in make(F.col(raw)).items():
            fields.setdefault(name, []).append(F.when(kind == k, c))
    error = F.when(kind.isNull(), F.lit("Cannot enhance: result is not a valid dictionary"))  # fixed value
    out = df.withColumns({"type": F.coalesce(F.concat(kind, F.lit("_enhanced")), F.lit("enhancement_error")), "enhanced_at": as_of, "error": error})
    return out.withColumns({name: F.coalesce(*cs) for name, cs in fields.items()})


def enhanced(df: DataFrame, as_of: Column, service: str = "service_id", action: str = "action") -> DataFrame:
    """df stamped with the kind of its service and the time given."""
    return df.withColumns({"type": service_kind(F.col(service), F.col(action)), "enhanced_at": as_of})
