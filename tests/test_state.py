import datetime as dt
import time
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.streaming import keyed, live


def requests(spark, seconds, key=1):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, key, t0 + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)], "event_id long, user_id long, ts timestamp_ntz")


def admitted(spark, at, **how):
    rows = keyed.admit(requests(spark, at), "user_id", "ts", "event_id", **how).orderBy("event_id").collect()
    return [r["admitted"] for r in rows]


def test_sliding_limit_ignores_rejected(spark):
    assert admitted(spark, [0, 1, 2, 3, 10, 11, 12], limit=2, seconds=10) == [True, True, False, False, True, True, False]


def test_fixed_limit_starts_at_first_request(spark):
    assert admitted(spark, [5, 6, 7, 14, 15, 16, 17], limit=2, seconds=10, fixed=True) == [True, True, False, False, True, True, False]


def test_limit_is_per_key_and_skips_nulls(spark):
    rows = requests(spark, [0, 1], 1).unionAll(requests(spark, [0, 1], 2)).unionAll(requests(spark, [0], None))
    assert keyed.admit(rows, "user_id", "ts", "event_id", 1, 10).where("admitted").count() == 2
    assert keyed.admit(rows.where("false"), "user_id", "ts", "event_id", 1, 10).count() == 0


def test_undo_history():
    save = [("save", i) for i in range(5)]
    assert keyed.undo_history(save) == ([2, 3, 4], 2)
    assert keyed.undo_history([*save, ("undo", None), ("undo", None), ("save", 9)]) == ([2, 9], 1)
    assert keyed.undo_history([("undo", None), ("redo", None)]) == ([], -1)


def test_live_windows_and_registry(spark, tmp_path):
    folder = str(tmp_path / "in")
    requests(spark, [0, 10, 20, 400], 1).unionAll(requests(spark, [5], 2)).coalesce(1).write.parquet(folder)
    schema = spark.read.parquet(folder).schema

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    counts = run(live.windowed(live.read_events(spark, folder, schema), "ts", "1 minute", "1 minute", None), "complete", "w")
    assert sorted(r["n"] for r in counts.collect()) == [1, 4]
    beats = run(live.live_registry(live.read_events(spark, folder, schema)), "update", "r")
    assert beats.groupBy("user_id").agg(F.max("beats").alias("b")).orderBy("user_id").collect() == [(1, 4), (2, 1)]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def streamed(spark, rows, tmp_path, parts, df_of):
    """What df_of gives for rows that arrive in so many files, each shuffled, with a last row that lets the watermark pass all others."""
    pdf = rows.toPandas().sort_values("ts")
    cuts = [round(i * len(pdf) / parts) for i in range(parts + 1)]
    last = pdf.iloc[-1:].assign(user_id=-1, event_id=-1, ts=pdf["ts"].max() + pd.Timedelta(days=40))
    frames = [pdf.iloc[a:b].sample(frac=1, random_state=a) for a, b in zip(cuts, cuts[1:])] + [last, last.assign(event_id=-2)]
    for i, part in enumerate(frames):
        spark.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read in the order of their whole seconds
    events = live.read_events(spark, str(tmp_path / "in"), rows.schema, per_trigger=1)
    name = f"t{uuid.uuid4().hex}"
    q = df_of(events).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(600)
    return sorted(map(tuple, spark.table(name).where("user_id <> -1").collect()))


@pytest.mark.parametrize("fixed", [False, True])
def test_live_limits_as_in_batch(spark, rocks, tmp_path, fixed):
    rows = table_events(spark)
    got = streamed(spark, rows, tmp_path, 3, lambda e: live.live_limits(e, 3, 86400, fixed))
    want = keyed.admit(rows, "user_id", "ts", "event_id", 3, 86400, fixed)
    assert got == sorted(map(tuple, want.select("user_id", "event_id", "admitted").collect())) and len({r[2] for r in got}) == 2


def test_live_uploads_as_in_batch(spark, rocks, tmp_path):
    rows = table_events(spark)
    parts = lambda e: e.withColumns({"part": F.col("event_id") % 5, "total": F.lit(5)})
    got = streamed(spark, rows, tmp_path, 3, lambda e: live.live_uploads(parts(e), "user_id", "part", "total", ttl_s=86400))
    want = keyed.uploads(parts(rows), "user_id", "part", "total", "ts", "event_id", 86400)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    assert got == sorted(map(tuple, want.select("user_id", us("started"), us("last"), "received", "expected", "complete").collect()))
    assert {r[5] for r in got} == {False, True}


def table_events(spark):
    """Events of some users, so that each has many; their rows are all there."""
    from conftest import SF

    e = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id")
    return e.withColumn("user_id", F.col("user_id") % 12)


def test_a_part_at_the_very_expiry_still_counts(spark):
    rows = requests(spark, [0, 3600, 7201, 7201], 1).withColumns({"part": F.col("event_id") % 2, "total": F.lit(2)})
    got = keyed.uploads(rows, "user_id", "part", "total", "ts", "event_id").orderBy("started").collect()
    assert [(r["received"], r["complete"]) for r in got] == [(2, True), (2, True)]
    assert keyed.uploads(rows.where("false"), "user_id", "part", "total", "ts", "event_id").count() == 0
