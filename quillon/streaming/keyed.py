"""State per key over time, from tables of events: registries, rate limits, sessions, uploads, histories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TTL_S, GAP_S = 45, 45
SESSION_H = 24
HISTORY = 3
UPLOAD_TTL_S = 3600


def registry(beats: DataFrame, key: str, ts: str, kind: str, as_of: Column, ttl_s: int = TTL_S) -> DataFrame:
    """Each key's latest beat, what it said, its expiry, and whether it is alive at as_of. A minimum of state: the latest
    beat is found by a partial aggregation, so keys with many beats cost no more to shuffle."""
    last = beats.groupBy(key).agg(F.max(F.struct(ts, kind)).alias("last"))
    expires = F.col(f"last.{ts}") + F.make_interval(secs=F.lit(ttl_s))
    return last.select(key, F.col(f"last.{ts}").alias("last_beat"), F.col(f"last.{kind}").alias("status"), expires.alias("expires_at"), (expires >= as_of).alias("alive"))


def heard(beats: DataFrame, key: str, ts: str, kind: str, ident: str, register: str, unregister: str) -> DataFrame:
    """Each beat (every row that neither registers nor unregisters) with `known`: whether its key was registered before it, and not
    unregistered since. Of rows at one instant the smaller ident comes first."""
    said = F.when(F.col(kind).isin(register, unregister), F.col(kind) == register)
    now = F.last(said, ignorenulls=True).over(W.partitionBy(key).orderBy(ts, ident).rowsBetween(W.unboundedPreceding, W.currentRow))
    return beats.withColumn("known", F.coalesce(now, F.lit(False))).where(said.isNull())


def registered(beats: DataFrame, key: str, ts: str, kind: str, ident: str, register: str, unregister: str, as_of: Column, ttl_s: int = TTL_S) -> DataFrame:
    """Keys that are registered at as_of: their last register or unregister registers, and their last row (a register or a beat) is
    at most ttl_s old. Two maxima per key, aggregated before they are shuffled."""
    edge = F.max(F.when(F.col(kind).isin(register, unregister), F.struct(ts, ident, F.col(kind))))
    last = beats.where(F.col(ts) <= as_of).groupBy(key).agg(edge.alias("edge"), F.max(ts).alias("last_beat"))
    alive = F.col("last_beat") + F.make_interval(secs=F.lit(ttl_s)) >= as_of
    return last.where((F.col(f"edge.{kind}") == register) & alive).select(key, F.col(f"edge.{ts}").alias("since"), "last_beat")


def heartbeat_gaps(beats: DataFrame, key: str, ts: str, gap_s: int = GAP_S) -> DataFrame:
    """Beats that come later than gap_s after the one before, with the seconds between."""
    before = F.lag(ts).over(W.partitionBy(key).orderBy(ts))
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))
    return beats.select(key, ts, before.alias("before")).withColumn("gap_us", seconds).where(F.col("gap_us") > gap_s * 1_000_000)


def sliding_counts(requests: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Each request with the requests of its key in the seconds up to it."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return requests.withColumn("in_window", F.count("*").over(W.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)))


def admitted(kept: list[int], us: int, limit: int, span_us: int, fixed: bool) -> bool:
    """Whether a request passes, by the instants kept of its key, which are brought up to it: admissions of the last span_us, or of the window that the
    first of them started."""
    if fixed:
        if kept and us >= kept[0] + span_us:
            kept.clear()
    else:
        while kept and kept[0] <= us - span_us:
            kept.pop(0)
    if len(kept) >= limit:
        return False
    kept.append(us)
    return True


def admit(requests: DataFrame, key: str, ts: str, ident: str, limit: int, seconds: int, fixed: bool = False) -> DataFrame:
    """Each request with `admitted`: at most limit admitted ones in a window of so many seconds. A sliding window ends at
    the request; a fixed one starts at the first request after the last window. Rejected requests don't count,
    so each depends on those before. Keys are dealt over the cluster, sorted, and streamed: a key's state is
    its last `limit` admissions, and no key's rows are gathered."""
    schema = f"{ident} long, {key} long, admitted boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, []
        for pdf in batches:
            verdicts = []
            for k, us in zip(pdf[key].tolist(), pdf["us"].tolist()):
                if k != now:
                    now, kept = k, []
                verdicts.append(admitted(kept, us, limit, seconds * 1_000_000, fixed))
            yield pd.DataFrame({ident: pdf[ident], key: pdf[key], "admitted": verdicts})

    rows = requests.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(ident, key, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    return rows.repartition(key).sortWithinPartitions(key, "us", ident).mapInPandas(run, schema)


def fixed_clock_counts(requests: DataFrame, key: str, ts: str, window: str) -> DataFrame:
    """Requests per key and clock-aligned window."""
    w = F.window(F.col(ts).cast("timestamp"), window)
    return requests.groupBy(key, w.alias("w")).agg(F.count("*").alias("requests")).select(key, F.col("w.start").alias("window_start"), "requests")


def sessions_alive(logins: DataFrame, ts: str, as_of: Column, hours: int = SESSION_H) -> DataFrame:
    """Sessions whose absolute lifetime hasn't ended; using them doesn't renew them."""
    return logins.withColumn("expires_at", F.col(ts) + F.make_interval(hours=F.lit(hours))).where(F.col("expires_at") > as_of)


def upload_progress(parts: DataFrame, session: str, part: str, total: str) -> DataFrame:
    """Distinct parts received per upload, parts expected, and whether all are there."""
    got = parts.groupBy(session).agg(F.countDistinct(part).alias("received"), F.max(total).alias("expected"))
    return got.withColumn("complete", F.col("received") == F.col("expected"))


def uploads(parts: DataFrame, session: str, part: str, total: str, ts: str, ident: str, ttl_s: int = UPLOAD_TTL_S) -> DataFrame:
    """(session, started, last, received, expected, complete, expires_at), a row for each upload. Every part renews its session for ttl_s; one that comes later
    than that finds it expired and starts a new upload, so what was received before counts no more. Parts of one instant follow ident."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    order = W.partitionBy(session).orderBy("__us", ident)
    rows = parts.where(F.col(session).isNotNull() & F.col(ts).isNotNull()).withColumn("__us", at)
    new = F.coalesce(F.col("__us") - F.lag("__us").over(order) > ttl_s * 1_000_000, F.lit(True))
    numbered = rows.withColumn("__new", new.cast("int")).withColumn("__upload", F.sum("__new").over(order))
    got = numbered.groupBy(session, "__upload").agg(F.min(ts).alias("started"), F.max(ts).alias("last"), F.countDistinct(part).alias("received"), F.max(total).alias("expected"))
    return got.select(session, "started", "last", "received", "expected", (F.col("received") == F.col("expected")).alias("complete"), (F.col("last") + F.make_interval(secs=F.lit(ttl_s))).alias("expires_at"))


def last_n(events: DataFrame, key: str, seq: str, n: int = HISTORY) -> DataFrame:
    """The last n rows of each key, with position 1 for the oldest of them."""
    back = F.row_number().over(W.partitionBy(key).orderBy(F.desc(seq)))
    kept = events.withColumn("back", back).where(F.col("back") <= n)
    return kept.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy(seq))).drop("back")


def undo_history(actions: list[tuple[str, object]], limit: int = HISTORY) -> tuple[list, int]:
    """States and the cursor after save, undo and redo: saving drops what could be redone, and keeps the last states."""
    states, at = [], -1
    for kind, value in actions:
        if kind == "save":
            states = [*states[: at + 1], value][-limit:]
            at = len(states) - 1
        elif kind == "undo":
            at = max(at - 1, 0) if states else -1
        elif kind == "redo":
            at = min(at + 1, len(states) - 1)
    return states, at


def run_durations(events: DataFrame, run: str, ts: str, kind: str, start: str, end: str) -> DataFrame:
    """Seconds between the first start and the last end of each run that has both."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    both = events.groupBy(run).agg(F.min(F.when(F.col(kind) == start, at)).alias("a"), F.max(F.when(F.col(kind) == end, at)).alias("b"))
    return both.where("a is not null and b is not null").select(run, F.round((F.col("b") - F.col("a")) / 1e6, 6).alias("seconds"))
