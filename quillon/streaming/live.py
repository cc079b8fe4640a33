"""The same state in Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .keyed import UPLOAD_TTL_S, admitted


def read_events(spark: SparkSession, path: str, schema, ts: str = "ts", per_trigger: int = 8) -> DataFrame:
    """A stream of Parquet files, with ts as an instant (watermarks need one)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def windowed(events: DataFrame, ts: str, late: str, window: str, slide: str | None, *keys: str) -> DataFrame:
    """Counts per window and keys; rows later than the watermark are dropped, finished windows leave the state."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return events.withWatermark(ts, late).groupBy(w, *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, ts: str, late: str, gap: str, *keys: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))


def live_registry(beats: DataFrame, key: str = "user_id", ts: str = "ts", ttl_s: int = 45) -> DataFrame:
    """(key, last_beat_us, expires_us, beats) of each key whenever it beats; keys silent beyond the watermark by ttl_s
    are reported once more with beats = 0 and forgotten."""
    out = f"{key} long, last_beat_us long, expires_us long, beats long"

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, _ = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "last_beat_us": [last], "expires_us": [last + ttl_s * 1_000_000], "beats": [0]})
            return
        last, n = state.get if state.exists else (0, 0)
        for pdf in batches:
            last, n = max(last, int(pdf["us"].max())), n + len(pdf)
        state.update((last, n))
        state.setTimeoutTimestamp(max(last // 1000 + ttl_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "last_beat_us": [last], "expires_us": [last + ttl_s * 1_000_000], "beats": [n]})

    rows = beats.select(key, ts, F.unix_micros(ts).alias("us")).withWatermark(ts, f"{ttl_s} seconds")
    return rows.groupBy(key).applyInPandasWithState(update, out, "last long, n long", "update", "EventTimeTimeout")


class Ordered(StatefulProcessor):
    """Rows (us, ident, ...) of a key in order of time, however they arrive: they wait as list state until the watermark passes them, and a timer at the
    first of them wakes the key. Subclasses take them one by one and say when, without further rows, the key ends."""

    waits = "us long, ident long"

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waits)
        self.open(handle)

    def open(self, handle) -> None:
        """Make further state."""

    def take(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        """What comes out of rows that are due, in order."""
        raise NotImplementedError

    def ends(self) -> int | None:
        """The instant (us) at which the key's state has no use any more."""
        raise NotImplementedError

    def end(self, key: tuple) -> list[tuple]:
        """What comes out when the key ends; its state is cleared."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in self.waits.split(", ")]
        new = [tuple(map(int, r)) for pdf in rows for r in pdf[names].itertuples(index=False)]
        self.waiting.appendList(new)
        yield from self._release(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, timerValues)

    def _release(self, key: tuple, times) -> Iterator[pd.DataFrame]:
        mark = times.getCurrentWatermarkInMs()
        held = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in held if r[0] // 1000 < mark]
        out, later = [], held[len(due) :]
        if due:
            out += self.take(key, due)
            self.waiting.put(later) if later else self.waiting.clear()
        stop = self.ends()
        if stop is not None and stop // 1000 < mark:
            out += self.end(key)
            stop = None
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if wake := [*([later[0][0]] if later else []), *([stop] if stop is not None else [])]:
            self.handle.registerTimer(min(wake) // 1000 + 1)
        if out:
            yield pd.DataFrame([(*key, *r) for r in out], columns=self.columns)


class Limiter(Ordered):
    """Verdicts of a rate limit (see keyed.admit); a key keeps its last `limit` admissions until they count no more."""

    def __init__(self, key: str, ident: str, limit: int, seconds: int, fixed: bool):
        self.limit, self.span, self.fixed = limit, seconds * 1_000_000, fixed
        self.columns = [key, ident, "admitted"]

    def open(self, handle) -> None:
        self.kept = handle.getListState("kept", "us long")

    def take(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        kept = [r[0] for r in self.kept.get()]
        out = [(ident, admitted(kept, us, self.limit, self.span, self.fixed)) for us, ident in rows]
        self.kept.put([(us,) for us in kept])
        return out

    def ends(self) -> int | None:
        kept = [r[0] for r in self.kept.get()]
        return max(kept) + self.span if kept else None

    def end(self, key: tuple) -> list[tuple]:
        self.kept.clear()
        return []


def live_limits(requests: DataFrame, limit: int, seconds: int, fixed: bool = False, key: str = "user_id", ts: str = "ts", ident: str = "event_id", late: str = "1 hour") -> DataFrame:
    """(key, ident, admitted) of each request once the watermark has passed it: the same verdicts as keyed.admit on all rows, whatever their order
    within `late`. Needs the RocksDB state store."""
    return _ordered(requests, Limiter(key, ident, limit, seconds, fixed), f"{key} long, {ident} long, admitted boolean", key, ts, late, F.col(ident).alias("ident"))


class Uploads(Ordered):
    """Uploads (see keyed.uploads), each once it has expired."""

    waits = "us long, ident long, part long, total long"

    def __init__(self, session: str, ttl_s: int):
        self.ttl = ttl_s * 1_000_000
        self.columns = [session, "started_us", "last_us", "received", "expected", "complete"]

    def open(self, handle) -> None:
        self.now = handle.getValueState("now", "started long, last long, expected long")
        self.parts = handle.getMapState("parts", "part long", "us long")

    def take(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        out = []
        for us, _, part, total in rows:
            started, last, expected = self.now.get() if self.now.exists() else (us, us, 0)
            if us - last > self.ttl:
                out += self.end(key)
                started, expected = us, 0
            self.now.update((started, us, max(expected, total)))
            self.parts.updateValue((part,), (us,))
        return out

    def ends(self) -> int | None:
        return self.now.get()[1] + self.ttl if self.now.exists() else None

    def end(self, key: tuple) -> list[tuple]:
        started, last, expected = self.now.get()
        received = sum(1 for _ in self.parts.keys())
        self.now.clear()
        self.parts.clear()
        return [(started, last, received, expected, received == expected)]


def live_uploads(parts: DataFrame, session: str, part: str, total: str, ts: str = "ts", ident: str = "event_id", ttl_s: int = UPLOAD_TTL_S, late: str = "1 hour") -> DataFrame:
    """(session, started_us, last_us, received, expected, complete) of each upload once it has expired, as keyed.uploads finds them. Needs the RocksDB state
    store."""
    out = f"{session} long, started_us long, last_us long, received long, expected long, complete boolean"
    extra = (F.col(ident).alias("ident"), F.col(part).cast("long").alias("part"), F.col(total).cast("long").alias("total"))
    return _ordered(parts, Uploads(session, ttl_s), out, session, ts, late, *extra)


def _ordered(events: DataFrame, processor: Ordered, out: str, key: str, ts: str, late: str, *columns) -> DataFrame:
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, ts, F.unix_micros(ts).alias("us"), *columns)
    return rows.withWatermark(ts, late).groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")
