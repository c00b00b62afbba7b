"""Streams over several files give what one batch over all of them gives."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from setwise.operators import aggregates as ag
from setwise.operators import alerts as al
from setwise.operators.incremental import snapshot_series_delta
from setwise.session import scratch_path
from setwise.sources.tables import event_stream
from setwise.streaming import jobs

SCHEMA = "id int, t timestamp_ntz, who string, kind string, v int"


def landed(make, spark, lateness):
    """Events over five files, one file per micro-batch: in time order, but for a share that comes a file or more too late."""
    rnd, at, data = random.Random(3), datetime(2024, 1, 1), []
    for i in range(250):
        at += timedelta(seconds=rnd.choice([1, 20, 400, 5000]))
        data.append((i, at, rnd.choice(["hot", "hot", "a", "b"]), rnd.choice("xyz"), rnd.randrange(100)))
    folder = scratch_path(spark, "history")
    late = lambda i: rnd.randrange(1, 5) if rnd.random() < lateness else 0
    files = [min(i // 50 + late(i), 4) for i in range(250)]
    for n in range(5):
        make([row for row, f in zip(data, files) if f == n], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return make(data, SCHEMA), folder


@pytest.fixture
def history(make, spark):
    return landed(make, spark, 0)


@pytest.fixture
def late_history(make, spark):
    return landed(make, spark, 0.25)


def stream(spark, folder):
    return event_stream(spark, folder, SCHEMA, files_per_trigger=1)


def paths(spark, *labels):
    return [scratch_path(spark, x) for x in labels]


def batches(spark, target):
    return spark.read.parquet(target).select("batch").distinct().count()


def test_rollup(spark, history, rows):
    whole, folder = history
    target, check = paths(spark, "rollup", "check")
    jobs.stream_rollup(stream(spark, folder), target, check, ["who"], "t").awaitTermination()
    assert batches(spark, target) == 5
    merged = ag.merge_partials(spark.read.parquet(target), ["window_start", "who"], ["latest"], ["earliest"], ["n"])
    hour = F.date_trunc("hour", F.col("t").cast("timestamp"))
    want = whole.groupBy(hour, "who").agg(F.max("t"), F.min("t"), F.count("*"))
    assert rows(merged) == rows(want)


def test_windowed_rollup_emits_closed_windows(spark, history, rows):
    whole, folder = history
    target, check = paths(spark, "windowed", "check")
    out = jobs.windowed_rollup(stream(spark, folder), ["who"], "t")
    out.writeStream.format("parquet").option("path", target).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    hour = F.date_trunc("hour", F.col("t").cast("timestamp"))
    want = set(rows(whole.groupBy(hour, "who").agg(F.max("t"), F.min("t"), F.count("*"))))
    got = rows(spark.read.parquet(target))
    assert got and set(got) <= want and len(want) - len(got) <= 6


def test_late_rows_of_closed_windows_are_counted_apart(spark, make, rows):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    files = [[(1, at(0), "a", "x", 1), (2, at(1), "a", "x", 1)], [(3, at(5), "a", "x", 1)], [(4, at(0, 30), "a", "x", 1), (5, at(2), "b", "x", 1), (6, at(9), "b", "x", 1)]]
    folder, target, check = paths(spark, "files", "windowed", "check")
    schema = "who string, latest timestamp_ntz, earliest timestamp_ntz"
    for part in files:  # each time anew from the checkpoint
        make(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        for query in jobs.stream_windowed_rollup(stream(spark, folder), target, check, ["who"], "t"):
            query.awaitTermination()
    got = rows(jobs.closed_windows(spark, target, ["who"], schema).select(F.hour("window_start"), "who", "latest", "n", "n_late"))
    assert got == [(0, "a", at(0), 1, 1), (1, "a", at(1), 1, 0), (2, "b", None, 0, 1), (5, "a", at(5), 1, 0)]


def fired(data, delay):
    last, out = None, []
    for us, i in sorted(data):
        if delay == 0 or last is None or us >= last + delay:
            out.append((us, i))
            last = us
    return out


def hits_of(make, data):
    return make([(r, d, us, i) for r, d, us, i in data], "rule string, delay long, us long, event_id long")


def test_alert_example(make, rows):
    df = hits_of(make, [("r", 60, t, t) for t in (0, 30, 70, 100, 140)] + [("z", 0, t, t) for t in (1, 1, 2)])
    assert rows(al.fire_alerts(df).select("rule", "us")) == [("r", 0), ("r", 70), ("r", 140), ("z", 1), ("z", 1), ("z", 2)]


@pytest.mark.parametrize("seed", [0, 5])
def test_alerts_against_a_walk(make, rows, seed):
    """Pointer doubling gives the firings of a walk over the hits."""
    rnd = random.Random(seed)
    data = []
    for rule, delay, gap in (("dense", 40, 6), ("sparse", 40, 90), ("never", 10**9, 5)):
        us = 0
        for i in range(120):
            us += rnd.randrange(1, gap)
            data.append((rule, delay, us, i))
    want = sorted((r, us, i) for r, d in {(x[0], x[1]) for x in data} for us, i in fired([(x[2], x[3]) for x in data if x[0] == r], d))
    assert rows(al.fire_alerts(hits_of(make, data))) == want


def test_stream_alerts(spark, late_history, rows):
    whole, folder = late_history
    hits = lambda df: df.select(
        F.col("kind").alias("rule"), F.when(F.col("kind") == "x", 0).otherwise(900_000_000).cast("bigint").alias("delay"),
        F.unix_micros(F.col("t").cast("timestamp")).alias("us"), F.col("id").cast("bigint").alias("event_id"))
    target, state, check = paths(spark, "alerts", "state", "check")
    jobs.stream_alerts(stream(spark, folder), hits, target, state, check).awaitTermination()
    assert rows(jobs.current_alerts(spark, target)) == rows(al.fire_alerts(hits(whole)))


@pytest.mark.parametrize("compact", [2, 10])
def test_stream_delta(spark, late_history, rows, compact, monkeypatch):
    whole, folder = late_history
    init = jobs.BatchState.__init__
    monkeypatch.setattr(jobs.BatchState, "__init__", lambda self, *a, **k: init(self, *a, compact_every=compact, **k))
    target, state, check = paths(spark, "delta", "state", "check")
    jobs.stream_delta(stream(spark, folder), target, state, check, ["who"], "t", ["v"], "kind", ["id"]).awaitTermination()
    want = snapshot_series_delta(whole, ["who"], "t", ["v"], "kind", ["id"]).select("id", "v_delta")
    stored = spark.read.parquet(target)
    assert rows(jobs.current_captures(stored, ["who"], "t", ["id"]).select("id", "v_delta")) == rows(want)
    # A late capture costs its own row and a new version of the next one, no more.
    assert stored.count() <= 2 * whole.count()


def test_stream_daily_snapshot(spark, history, rows):
    whole, folder = history
    target, check = paths(spark, "daily", "check")
    summarise = lambda df: df.groupBy("day").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    run = lambda check: jobs.stream_daily_snapshot(
        stream(spark, folder), lambda: spark.read.schema(SCHEMA).parquet(folder), target, check, "t", summarise, "day").awaitTermination()
    want = rows(summarise(whole.withColumn("day", F.col("t").cast("date"))).select("day", "n", "v"))
    for c in (check, scratch_path(spark, "check")):  # a second run from the start changes nothing
        run(c)
        assert rows(spark.read.parquet(target).select("day", "n", "v")) == want


def test_runs_of_days():
    days = [date(2024, 1, d) for d in (1, 2, 5, 7, 8, 9)]
    assert jobs._runs(days) == [(date(2024, 1, 1), date(2024, 1, 3)), (date(2024, 1, 5), date(2024, 1, 6)), (date(2024, 1, 7), date(2024, 1, 10))]


def test_dense_hits_are_not_stored_again_each_round(make, rows, monkeypatch):
    """Of hits that come many in a delay few are where others lead to; rounds hold only these."""
    from setwise.operators import graph

    rnd, us, data = random.Random(3), 0, []
    for i in range(3000):
        us += rnd.randrange(1, 4)
        data.append(("dense", 60, us, i))
    stored, store = [], graph.materialize

    def recorded(df, label="stage"):
        out = store(df, label)
        stored.append(out.count())
        return out

    monkeypatch.setattr(graph, "materialize", recorded)
    want = sorted(("dense", us, i) for us, i in fired([(x[2], x[3]) for x in data], 60))
    assert rows(al.fire_alerts(hits_of(make, data))) == want
    assert sum(stored) < 3 * len(data)
