"""Registries, limits, sessions, uploads and histories over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..streaming import keyed as K
from .common import Registry, table

REGISTRY = Registry()
add = REGISTRY.add

AS_OF = "2024-01-30 20:00:00"
TTL = 7200
LAST = f"SELECT user_id, max(ts) AS last_beat, max_by(event_type, ts) AS status, max(ts) + INTERVAL {TTL} SECOND AS expires_at FROM events GROUP BY user_id"


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _registry(spark, d):
    return K.registry(table(spark, d, "events"), "user_id", "ts", "event_type", _as_of(), TTL)


@add("registry_state", f"SELECT *, expires_at >= TIMESTAMP '{AS_OF}' AS alive FROM ({LAST})")
def registry_state(spark, d):
    return _registry(spark, d)


@add("registry_expired", f"SELECT user_id, last_beat FROM ({LAST}) WHERE expires_at < TIMESTAMP '{AS_OF}'")
def registry_expired(spark, d):
    return _registry(spark, d).where("not alive").select("user_id", "last_beat")


@add("discover_services", f"SELECT user_id FROM ({LAST}) WHERE expires_at >= TIMESTAMP '{AS_OF}' AND status = 'click' AND user_id % 2 = 0")
def discover_services(spark, d):
    """Alive, of a type, and with the metadata asked for."""
    found = _registry(spark, d).withColumn("metadata", F.create_map(F.lit("zone"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")))
    return found.where(F.col("alive") & (F.col("status") == "click") & (F.col("metadata")["zone"] == "even")).select("user_id")


@add(
    "heartbeats_known",
    "SELECT event_id, known FROM (SELECT *, coalesce(last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_type = 'signup' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS known FROM events) WHERE event_type NOT IN ('signup', 'error')",
)
def heartbeats_known(spark, d):
    """A signup registers, an error unregisters, all else is a heartbeat; those of unknown keys are answered with false."""
    return K.heard(table(spark, d, "events"), "user_id", "ts", "event_type", "event_id", "signup", "error").select("event_id", "known")


@add(
    "registered_services",
    f"SELECT user_id, since, last_beat FROM (SELECT user_id, max_by(event_type, (ts, event_id)) FILTER (WHERE event_type IN ('signup', 'error')) AS edge, max(ts) FILTER (WHERE event_type IN ('signup', 'error')) AS since, max(ts) AS last_beat FROM events WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY user_id) WHERE edge = 'signup' AND last_beat + INTERVAL {TTL} SECOND >= TIMESTAMP '{AS_OF}'",
)
def registered_services(spark, d):
    return K.registered(table(spark, d, "events"), "user_id", "ts", "event_type", "event_id", "signup", "error", _as_of(), TTL)


@add("iso_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS iso, ts AS parsed, CAST(NULL AS TIMESTAMP) AS broken FROM events")
def iso_timestamps(spark, d):
    e = table(spark, d, "events").withColumn("iso", X.iso_format(F.col("ts").cast("timestamp_ntz")))
    broken = F.concat(F.lit("on "), F.col("iso"))
    return e.select("event_id", "iso", X.iso_parse(F.col("iso")).cast("timestamp_ntz").alias("parsed"), X.iso_parse(broken).cast("timestamp_ntz").alias("broken"))


@add("heartbeat_gaps", "SELECT user_id, ts, before, epoch_us(ts) - epoch_us(before) AS gap_us FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE epoch_us(ts) - epoch_us(before) > 86400000000")
def heartbeat_gaps(spark, d):
    return K.heartbeat_gaps(table(spark, d, "events"), "user_id", "ts", 86400)


@add("rate_sliding_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rate_sliding_count(spark, d):
    return K.sliding_counts(table(spark, d, "events"), "user_id", "ts", 6 * 3600).select("event_id", "in_window")


@add("rate_fixed_clock", "SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS window_start, count(*) AS requests FROM events GROUP BY ALL")
def rate_fixed_clock(spark, d):
    """Clock-aligned: an approximation of windows that start at a first request."""
    return K.fixed_clock_counts(table(spark, d, "events"), "user_id", "ts", "6 hours").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _limit_sql(kept: str) -> str:
    """Row by row of a user: the instants kept up to a request, and whether it passes. kept: those of r.kept that count at e.us."""
    first = "SELECT user_id, ts, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events"
    step = f"SELECT e.user_id, e.n, e.event_id, e.us, {kept} AS k FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1"
    return (
        f"WITH RECURSIVE e AS MATERIALIZED ({first}), r AS (SELECT user_id, n, event_id, [us] AS kept, true AS admitted FROM e WHERE n = 1 UNION ALL "
        f"SELECT user_id, n, event_id, CASE WHEN len(k) < 3 THEN list_append(k, us) ELSE k END, len(k) < 3 FROM ({step})) SELECT event_id, user_id, admitted FROM r"
    )


@add("rate_limit_sliding", _limit_sql("list_filter(r.kept, lambda x: x > e.us - 86400000000)"))
def rate_limit_sliding(spark, d):
    return K.admit(table(spark, d, "events"), "user_id", "ts", "event_id", 3, 86400)


@add("rate_limit_fixed", _limit_sql("CASE WHEN e.us >= r.kept[1] + 86400000000 THEN [] ELSE r.kept END"))
def rate_limit_fixed(spark, d):
    return K.admit(table(spark, d, "events"), "user_id", "ts", "event_id", 3, 86400, fixed=True)


@add("sessions_alive", f"SELECT event_id, ts + INTERVAL 24 HOUR AS expires_at FROM events WHERE event_type = 'signup' AND ts + INTERVAL 24 HOUR > TIMESTAMP '{AS_OF}'")
def sessions_alive(spark, d):
    logins = table(spark, d, "events").where("event_type = 'signup'")
    return K.sessions_alive(logins, "ts", _as_of()).select("event_id", "expires_at")


@add("session_windows", "SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 3 HOUR > ts THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def session_windows(spark, d):
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    got = e.groupBy("user_id", F.session_window("t", "3 hours").alias("w")).agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))
    return got.select("user_id", "first_ts", "n")


@add("upload_complete", "SELECT conv_id, count(DISTINCT turn) AS received, max(turn) + 1 AS expected, count(DISTINCT turn) = max(turn) + 1 AS complete FROM conversations WHERE NOT (conv_id % 5 = 0 AND turn = 0) GROUP BY conv_id")
def upload_complete(spark, d):
    parts = table(spark, d, "conversations").where("not (conv_id % 5 = 0 and turn = 0)").withColumn("total", F.col("turn") + 1)
    return K.upload_progress(parts, "conv_id", "turn", "total")


UPLOAD_TTL = 4 * 3600


@add(
    "upload_sessions",
    f"SELECT user_id, min(ts) AS started, max(ts) AS last, count(DISTINCT event_id % 5) AS received, 5 AS expected, count(DISTINCT event_id % 5) = 5 AS complete, max(ts) + INTERVAL {UPLOAD_TTL} SECOND AS expires_at FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL {UPLOAD_TTL} SECOND THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s",
)
def upload_sessions(spark, d):
    """Events as parts of five; those that come after the expiry start a new upload."""
    parts = table(spark, d, "events").withColumns({"part": F.col("event_id") % 5, "total": F.lit(5)})
    return K.uploads(parts, "user_id", "part", "total", "ts", "event_id", UPLOAD_TTL)


@add("history_last_n", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM (SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)")
def history_last_n(spark, d):
    return K.last_n(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@add("run_durations", "SELECT user_id, round((max(epoch_us(ts)) FILTER (WHERE event_type = 'purchase') - min(epoch_us(ts)) FILTER (WHERE event_type = 'signup')) / 1e6, 6) AS seconds FROM events GROUP BY user_id")
def run_durations(spark, d):
    return K.run_durations(table(spark, d, "events"), "user_id", "ts", "event_type", "signup", "purchase")


@add("permission_check", "SELECT user_id, event_type, CASE user_id % 3 WHEN 0 THEN true WHEN 1 THEN event_type IN ('view', 'click') ELSE event_type = 'view' END AS allowed FROM (SELECT DISTINCT user_id, event_type FROM events)")
def permission_check(spark, d):
    roles = F.array(F.array(*(F.lit(x) for x in ("view", "click", "purchase", "signup", "error"))), F.array(F.lit("view"), F.lit("click")), F.array(F.lit("view")))
    asked = table(spark, d, "events").select("user_id", "event_type").distinct()
    granted = F.element_at(roles, (F.col("user_id") % 3 + 1).cast("int"))
    return asked.select("user_id", "event_type", F.array_contains(granted, F.col("event_type")).alias("allowed"))


@add("validate_input", "SELECT event_id, CASE WHEN length(q) > 8 THEN 'Maximum length is 8' WHEN q IS NULL THEN 'Field is required' WHEN length(q) < 5 THEN 'Minimum length is 5' END AS query, CASE WHEN k > 100 THEN 'Maximum value is 100' WHEN k < 5 THEN 'Minimum value is 5' END AS top_k FROM (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN event_type || CASE WHEN event_id % 4 = 0 THEN '!' ELSE '' END END AS q, value AS k FROM events)")
def validate_input(spark, d):
    """Errors by field; of several failures of a field the last one checked counts."""
    from ..operators.validation import errors

    rows = table(spark, d, "events").selectExpr("event_id", "CASE WHEN event_id % 9 <> 0 THEN concat(event_type, CASE WHEN event_id % 4 = 0 THEN '!' ELSE '' END) END AS q", "value AS k")
    schema = {"query": {"required": True, "min_length": 5, "max_length": 8}, "top_k": {"min_value": 5, "max_value": 100}}
    e = rows.select("event_id", errors({"query": F.col("q"), "top_k": F.col("k")}, schema).alias("e"))
    return e.select("event_id", F.col("e")["query"].alias("query"), F.col("e")["top_k"].alias("top_k"))


@add("event_windows", "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    got = table(spark, d, "events").groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return got.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", "total")
