"""Tool calls planned by a model: their shapes, filters, order and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (kind, substrings of service ids), in order of precedence.
KINDS = (("sql", ("sql", "database")), ("search", ("search", "web")), ("dns", ("dns",)), ("download", ("download",)))
ORDER = {"search": ("search", "web"), "rag": ("rag",), "sql": ("sql", "database"), "dns": ("dns",)}
KNOWN = ("service_id", "service", "action", "method", "parameters", "params")


def _has(c: Column, words: tuple[str, ...]) -> Column:
    out = F.contains(c, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(c, F.lit(w))
    return out


def enabled(service_id: Column, flags: dict[str, bool], with_rag: bool = False) -> Column:
    """Whether a call's kind is switched on; kinds without a flag are."""
    low = F.lower(F.coalesce(service_id, F.lit("")))
    out = None
    for kind, words in (*KINDS, *((("rag", ("rag",)),) if with_rag else ())):
        value = F.lit(flags.get(kind, True))
        out = F.when(_has(low, words), value) if out is None else out.when(_has(low, words), value)
    return out.otherwise(F.lit(True))


def priority(service_id: Column) -> Column:
    """0 search, 1 rag, 2 sql, 3 dns, 4 others."""
    low = F.lower(F.coalesce(service_id, F.lit("")))
    out = None
    for i, words in enumerate(ORDER.values()):
        out = F.when(_has(low, words), F.lit(i)) if out is None else out.when(_has(low, words), F.lit(i))
    return out.otherwise(F.lit(len(ORDER)))


def validated(call: Column) -> Column:
    """A JSON call as a struct with its three fields, defaults '' and {}; null if it isn't an object."""
    is_object = call.rlike(r"(?s)^\s*\{.*\}\s*$") & F.try_parse_json(call).isNotNull()
    get = lambda k, d: F.coalesce(F.get_json_object(call, f"$.{k}"), F.lit(d))
    return F.when(is_object, F.struct(get("service_id", "").alias("service_id"), get("method", "").alias("method"), get("params", "{}").alias("params")))


def normalized(call: Column) -> Column:
    """Either spelling of service and action, and one map of parameters: `parameters`, then `params`, then other keys,
    later ones winning (the session's map key policy must be LAST_WIN or keys distinct)."""
    top = F.from_json(call, "map<string,string>")
    inner = [F.coalesce(F.from_json(F.get_json_object(call, f"$.{k}"), "map<string,string>"), F.create_map().cast("map<string,string>")) for k in ("parameters", "params")]
    rest = F.map_filter(F.coalesce(top, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*KNOWN))
    first = F.map_filter(inner[0], lambda k, v: ~F.map_contains_key(inner[1], k))
    both = F.map_concat(first, inner[1])
    merged = F.map_concat(F.map_filter(both, lambda k, v: ~F.map_contains_key(rest, k)), rest)
    said = lambda a, b: F.coalesce(F.nullif(F.get_json_object(call, f"$.{a}"), F.lit("")), F.get_json_object(call, f"$.{b}"))
    return F.struct(said("service_id", "service").alias("service_id"), said("action", "method").alias("action"), merged.alias("parameters"))


def wrapped(reply: Column) -> Column:
    """The JSON array of calls in a planner's reply: tool_call wrapped, a list as it is, tool_calls taken out, and a
    single object wrapped; null for anything else."""
    text = F.trim(reply)
    inner = F.get_json_object(text, "$.tool_call")
    calls = F.get_json_object(text, "$.tool_calls")
    one = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    return F.when(F.try_parse_json(text).isNull(), F.lit(None)).when(inner.startswith("{"), one(inner)).when(text.startswith("["), text).when(calls.isNotNull(), calls).when(text.startswith("{"), one(text))


def with_service(calls: DataFrame, services: DataFrame) -> DataFrame:
    """Calls with their service's host and port; calls to unknown services stay as errors."""
    s = services.select(F.col("id").alias("__id"), "host", "port")
    both = calls.join(s, F.col("service_id") == F.col("__id"), "left")
    miss = F.col("__id").isNull()
    error = F.when(miss, F.concat(F.lit("Service "), F.coalesce("service_id", F.lit("None")), F.lit(" not found")))
    return both.withColumns({"status": F.when(miss, "error").otherwise("ready"), "error": error}).drop("__id")


def outcomes(results: DataFrame) -> DataFrame:
    """Counts of successes and errors; a result without content is an error."""
    good = F.coalesce((F.col("status") == "success") & (F.coalesce("result", F.lit("")) != ""), F.lit(False))
    return results.agg(F.count_if(good).alias("successes"), F.count_if(~good).alias("errors"), F.count("*").alias("total"))


def service_kind(service_id: Column, action: Column) -> Column:
    """search, rag, download, sql, dns or generic, by what the id or action holds."""
    low = F.lower(F.coalesce(service_id, F.lit("")))
    rag = _has(low, ("rag", "vector")) | F.coalesce(F.contains(action, F.lit("query_documents")), F.lit(False))
    return (
        F.when(_has(low, ("search", "web", "brave")), "search").when(rag, "rag").when(_has(low, ("download", "file")), "download")
        .when(_has(low, ("sql", "database")), "sql").when(_has(low, ("dns",)), "dns").otherwise("generic")
    )
