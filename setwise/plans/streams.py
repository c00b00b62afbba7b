"""The streaming jobs over the event table, run until what is there is read."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from setwise.functions.measures import money
from setwise.operators import aggregates as ag
from setwise.operators import alerts as al
from setwise.plans.registry import day_text, number, query, time_text
from setwise.session import scratch_path
from setwise.sources import sinks
from setwise.sources.tables import Tables, event_stream, literal_rows
from setwise.streaming import jobs

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

# The rules of the alert queries.
RULES = [
    ("errors", "error", None, 60), ("purchases", "purchase", None, 3600), ("signups", "signup", None, 0),
    ("severity 19", None, 19, 600), ("severity 17", None, 17, 180), ("severity 12", None, 12, 86400),
]
RULE_SCHEMA = "name string, message_id string, severity int, delay_seconds int"


# The times at which the events are cut into arrivals, each of one range or more.
ARRIVALS = [[(None, "2024-01-10")], [("2024-01-10", "2024-01-20")], [("2024-01-20", None)]]
# The same with two days that land after the week that follows them.
LATE_ARRIVALS = [[(None, "2024-01-10")], [("2024-01-12", "2024-01-20")], [("2024-01-10", "2024-01-12"), ("2024-01-20", None)]]


def _within(lo: str | None, hi: str | None) -> Column:
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    return (F.col("ts") >= at(lo) if lo else F.lit(True)) & (F.col("ts") < at(hi) if hi else F.lit(True))


def in_arrivals(t: Tables, run: Callable[[DataFrame, str, str], StreamingQuery], arrivals=ARRIVALS) -> None:
    """All events, landing in several parts; after each the same job runs until what is there is read.

    The job gets the stream, its checkpoint and the folder. State, checkpoint
    and output carry over from run to run, as they would from day to day.
    """
    landed, checkpoint = scratch_path(t.spark, "landed"), scratch_path(t.spark, "checkpoint")
    for ranges in arrivals:
        part = t.events.where(reduce(Column.__or__, [_within(*r) for r in ranges]))
        sinks.append(part, landed)
        run(event_stream(t.spark, landed, EVENTS), checkpoint, landed).awaitTermination()


@query("stream_login_rollup", sql="""
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, event_type, strftime(MAX(ts), '%Y-%m-%d %H:%M:%S.%f') AS latest,
  strftime(MIN(ts), '%Y-%m-%d %H:%M:%S.%f') AS earliest, COUNT(*) AS n FROM events GROUP BY ALL""")
def stream_login_rollup(t: Tables):
    """Hourly rollup from partials written by the stream."""
    target = scratch_path(t.spark, "login-rollup")
    in_arrivals(t, lambda source, checkpoint, _: jobs.stream_rollup(source, target, checkpoint, ["event_type"], "ts"))
    partials = t.spark.read.parquet(target)
    out = ag.merge_partials(partials, ["window_start", "event_type"], ["latest"], ["earliest"], ["n"])
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", time_text("latest", "latest"),
                      time_text("earliest", "earliest"), "n")


_LATE = "ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'"


@query("stream_windowed_rollup", sql=f"""
WITH e AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w, ({_LATE}) OR ts >= TIMESTAMP '2024-01-20' AS last_part FROM events),
m AS (SELECT MAX(ts) - INTERVAL 1 DAY AS passed, MAX(ts) FILTER (NOT last_part) - INTERVAL 1 DAY AS passed_before FROM e),
r AS (SELECT e.*, last_part AND w + INTERVAL 1 HOUR <= passed_before AS late FROM e, m)
SELECT strftime(w, '%Y-%m-%d %H') AS hour, event_type, COALESCE(strftime(MAX(ts) FILTER (NOT late), '%Y-%m-%d %H:%M:%S.%f'), 'none') AS latest,
  COALESCE(strftime(MIN(ts) FILTER (NOT late), '%Y-%m-%d %H:%M:%S.%f'), 'none') AS earliest, COUNT(*) FILTER (NOT late) AS n, COUNT(*) FILTER (late) AS n_late
FROM r, m WHERE w + INTERVAL 1 HOUR <= passed GROUP BY ALL""")
def stream_windowed_rollup(t: Tables):
    """Hours closed by a watermark one day behind; what arrives for a closed hour is counted apart."""
    target = scratch_path(t.spark, "windowed")

    def run(source: DataFrame, checkpoint: str, _: str) -> StreamingQuery:
        closed, everything = jobs.stream_windowed_rollup(source, target, checkpoint, ["event_type"], "ts", delay="1 day")
        closed.awaitTermination()
        return everything

    in_arrivals(t, run, LATE_ARRIVALS)
    out = jobs.closed_windows(t.spark, target, ["event_type"], "event_type string, latest timestamp_ntz, earliest timestamp_ntz", delay="1 day")
    return out.select(
        F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type",
        *[F.coalesce(time_text(c, c), F.lit("none")).alias(c) for c in ("latest", "earliest")], "n", "n_late")


def rule_hits(events: DataFrame) -> DataFrame:
    """Events against the rules; severity comes from the property k."""
    severity = (F.get_json_object("props", "$.k").cast("int") % 10 + 10).alias("severity_level")
    rows = events.select("event_id", "ts", "event_type", severity)
    rules = literal_rows(events.sparkSession, RULES, RULE_SCHEMA)
    return al.match_rules(rows, rules, "event_type", "severity_level", "ts", "event_id")


_ALERTS = """
WITH RECURSIVE r(name, message_id, severity, delay) AS (VALUES """ + ", ".join(
    f"('{n}', {repr(m) if m else 'NULL'}, {s if s else 'NULL'}, {d})" for n, m, s, d in RULES) + """),
e AS (SELECT event_id, epoch_us(ts) AS us, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 + 10 AS sev FROM events),
h AS (SELECT name, delay::BIGINT * 1000000 AS delay, us, event_id FROM e JOIN r ON (message_id IS NOT NULL AND message_id = event_type) OR (message_id IS NULL AND severity = sev)),
u AS (SELECT name, delay, us, MIN(event_id) AS event_id FROM h WHERE delay > 0 GROUP BY ALL),
f AS (SELECT name, MIN(us) AS us FROM u GROUP BY name
  UNION ALL SELECT u.name, MIN(u.us) FROM f JOIN u ON u.name = f.name AND u.us >= f.us + u.delay GROUP BY u.name)
SELECT name AS rule, us, event_id FROM h WHERE delay = 0 UNION ALL SELECT u.name, u.us, u.event_id FROM f JOIN u ON u.name = f.name AND u.us = f.us"""


@query("alerts", sql=_ALERTS)
def alerts(t: Tables):
    """Alerts with repeat delays over all events at once."""
    return al.fire_alerts(rule_hits(t.events))


@query("stream_alerts", sql=_ALERTS)
def stream_alerts(t: Tables):
    """Alerts kept up by the stream while some days arrive late."""
    target, state = scratch_path(t.spark, "alerts"), scratch_path(t.spark, "alert-state")
    in_arrivals(t, lambda source, checkpoint, _: jobs.stream_alerts(source, rule_hits, target, state, checkpoint), LATE_ARRIVALS)
    return jobs.current_alerts(t.spark, target)


@query("stream_delta", sql="""
WITH l AS (SELECT event_id, ROUND(value * 100)::BIGINT AS cents, event_type, LAG(ROUND(value * 100)::BIGINT) OVER w AS p, LAG(event_type) OVER w AS pt
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, COALESCE(CASE WHEN event_type = pt AND cents >= p THEN cents - p END, -1) AS cents_delta FROM l""")
def stream_delta(t: Tables):
    """Growth between consecutive events of a user, kept up by the stream while some days arrive late."""
    cents = F.round(F.col("value") * 100).cast("bigint").alias("cents")
    target, state = scratch_path(t.spark, "delta"), scratch_path(t.spark, "delta-state")
    in_arrivals(t, lambda source, checkpoint, _: jobs.stream_delta(
        source.select("event_id", "user_id", "ts", "event_type", cents), target, state, checkpoint, ["user_id"], "ts", ["cents"],
        "event_type", ["event_id"]), LATE_ARRIVALS)
    newest = jobs.current_captures(t.spark.read.parquet(target), ["user_id"], "ts", ["event_id"])
    return newest.select("event_id", F.coalesce("cents_delta", F.lit(-1)).alias("cents_delta"))


def day_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("snapshot_date", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(money("value")).alias("value"))


@query("stream_daily_snapshot", sql="""
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY ALL""")
def stream_daily_snapshot(t: Tables):
    target = scratch_path(t.spark, "daily")
    in_arrivals(t, lambda source, checkpoint, landed: jobs.stream_daily_snapshot(
        source, lambda: t.spark.read.schema(EVENTS).parquet(landed), target, checkpoint, "ts", day_summary), LATE_ARRIVALS)
    stored = t.spark.read.schema("event_type string, n bigint, value decimal(28,2), snapshot_date date").parquet(target)
    return stored.select(day_text("snapshot_date", "day"), "event_type", "n", number("value"))
