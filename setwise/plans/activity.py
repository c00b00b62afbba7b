"""The activity report over the event table: users as sessions, referrals as blocking."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from setwise.operators.activity import ActivityOptions, activity_report
from setwise.plans.registry import query
from setwise.sources.tables import Tables


def sessions_at(t: Tables, until: str) -> DataFrame:
    """Users as they stood at one moment; user n waits for user n div 2."""
    seen = t.events.where(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
    per = seen.groupBy("user_id").agg(
        F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("start_time"),
        F.count_if(F.col("event_type") == "view").alias("reads"), F.count_if(F.col("event_type") == "click").alias("writes"),
        F.count(F.lit(1)).alias("physical_io"))
    half = F.floor(F.col("user_id") / 2).cast("bigint")
    return per.select(
        F.col("user_id").alias("session_id"), F.lit(0).alias("request_id"), "start_time", "reads", "writes", "physical_io",
        F.when(F.col("user_id") > 0, half).alias("blocking_session_id"),
        F.concat(F.lit("app"), (F.col("user_id") % 7).cast("string")).alias("program_name"),
        F.concat(F.lit("login"), (F.col("user_id") % 10).cast("string")).alias("login_name"))


_SESSIONS = """SELECT user_id, MAX(ts) FILTER (event_type = 'signup') AS st, COUNT(*) FILTER (event_type = 'view') AS reads, COUNT(*) FILTER (event_type = 'click') AS writes,
  COUNT(*) AS io FROM events WHERE ts < TIMESTAMP '{}' GROUP BY user_id"""


@query("activity_report", sql=f"""
WITH RECURSIVE a AS ({_SESSIONS.format('2024-01-10')}), b AS ({_SESSIONS.format('2024-01-12')}),
up AS (SELECT user_id AS node, user_id // 2 AS anc FROM b WHERE user_id > 0 AND user_id // 2 IN (SELECT user_id FROM b)
  UNION SELECT up.node, p.user_id // 2 FROM up JOIN b p ON p.user_id = up.anc AND p.user_id > 0 AND p.user_id // 2 IN (SELECT user_id FROM b)),
bc AS (SELECT anc, COUNT(DISTINCT node) AS n FROM up WHERE anc <> node GROUP BY anc),
w AS (SELECT user_id, event_type, COUNT(*) AS n, MIN(v) AS lo, MAX(v) AS hi, SUM(v)::BIGINT // COUNT(*) AS mid
  FROM (SELECT user_id, event_type, CAST(ROUND(value * 100) AS BIGINT) AS v FROM events) GROUP BY ALL),
d AS (SELECT user_id, string_agg('(' || n || 'x: ' || CASE WHEN lo = hi THEN lo::VARCHAR WHEN n = 2 THEN lo || '/' || hi
  ELSE lo || '/' || mid || '/' || hi END || 'ms)' || event_type, ', ' ORDER BY n DESC, event_type) AS wait_info FROM w GROUP BY user_id),
l AS (SELECT user_id, '[{{"group":"events","items":[' || string_agg('{{"name":"' || event_type || '","count":' || n || '}}', ',' ORDER BY event_type) || ']}}]' AS locks FROM w GROUP BY user_id),
j AS (SELECT b.user_id, b.io, b.io - a.io AS dio, b.reads - a.reads AS dr, a.st = b.st AS same FROM b LEFT JOIN a ON a.user_id = b.user_id)
SELECT j.user_id AS session_id, 'app' || (j.user_id % 7) AS program_name, lpad(format('{{:,}}', io), CAST(MAX(length(format('{{:,}}', io))) OVER () AS INTEGER), ' ') AS physical_io,
  COALESCE(CASE WHEN same THEN dr END, -1) AS reads_delta, COALESCE(CASE WHEN same THEN dio END, -1) AS physical_io_delta,
  wait_info, locks, COALESCE(n, 0) AS blocked_session_count
FROM j LEFT JOIN d ON d.user_id = j.user_id LEFT JOIN l ON l.user_id = j.user_id LEFT JOIN bc ON bc.anc = j.user_id
WHERE 'login' || (j.user_id % 10) LIKE 'login%' AND NOT ('app' || (j.user_id % 7)) LIKE 'app3'""")
def activity(t: Tables):
    """Two captures, waits, locks and blocking, filtered, chosen and laid out."""
    waits = t.events.select(
        F.col("user_id").alias("session_id"), F.lit(0).alias("request_id"), F.col("event_type").alias("wait_type"),
        F.round(F.col("value") * 100).cast("bigint").alias("wait_duration_ms"))
    locks = t.events.select(
        F.col("user_id").alias("session_id"), F.lit("events").alias("database_name"), F.col("event_type").alias("request_mode"))
    options = ActivityOptions(
        include="login%", include_by="login", exclude="app3", exclude_by="program", find_block_leaders=True,
        columns="[session_id][program%][physical_io%][reads_delta][wait%][locks][blocked%]", order="[blocked%] DESC, [session_id] ASC",
        metrics=("reads", "physical_io"), format_output={"physical_io": 0})
    out = activity_report(sessions_at(t, "2024-01-12"), options, sessions_at(t, "2024-01-10"), waits, None, locks)
    return out.fillna(-1, ["reads_delta", "physical_io_delta"])
