"""Alert rules with repeat delays.

A rule fires on its first hit, and again on the first hit at least its delay
after it last fired; a delay of zero fires on every hit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from setwise.functions.times import from_micros, micros
from setwise.operators.graph import reached_forward
from setwise.operators.ordered import ordered_rows
from setwise.session import materialize

def match_rules(events: DataFrame, rules: DataFrame, message: str, severity: str, time: str, event_id: str) -> DataFrame:
    """Hits (rule, delay, us, event_id): events whose message or severity a rule names."""
    seen = events.select(
        F.col(message).alias("__message"), F.col(severity).alias("__severity"), micros(time).alias("us"),
        F.col(event_id).alias("event_id"))
    delay = (F.col("delay_seconds").cast("bigint") * 1_000_000).alias("delay")
    by_message = seen.join(rules.where("message_id is not null"), F.col("__message") == F.col("message_id"))
    by_severity = seen.join(
        rules.where("message_id is null and severity is not null"), F.col("__severity") == F.col("severity"))
    pick = lambda df: df.select(F.col("name").alias("rule"), delay, "us", "event_id")
    return pick(by_message).unionByName(pick(by_severity))


def fire_alerts(hits: DataFrame, last_fired: DataFrame | None = None) -> DataFrame:
    """The hits that fire: rule, us, event_id. ``last_fired`` (rule, us) carries on from earlier hits.

    A hit that comes a whole delay after the one before fires whatever came
    earlier, so the runs between such hits are chased apart; within a run every
    hit points to the next one that its delay lets through.
    """
    if last_fired is not None:
        earlier = last_fired.select(F.col("rule").alias("__r"), F.col("us").alias("__last"))
        hits = hits.join(earlier, F.col("rule") == F.col("__r"), "left").where(
            (F.col("delay") == 0) | F.col("__last").isNull() | (F.col("us") >= F.col("__last") + F.col("delay"))
        ).drop("__r", "__last")
    always = hits.where("delay = 0").select("rule", "us", "event_id")
    # Of hits at the same moment only one can fire: the one with the smallest id.
    times = hits.where("delay > 0").groupBy("rule", "delay", "us").agg(F.min("event_id").alias("event_id"))
    return always.unionByName(_double(materialize(_runs(times), "hits")))


def _runs(times: DataFrame) -> DataFrame:
    """Number the runs of hits less than a delay apart by their first moment."""
    order = [F.col("us").asc()]
    gaps = ordered_rows(times, order, ["rule"], previous={"__before": "us"}).drop("row_no")
    starts = F.col("__before").isNull() | (F.col("us") - F.col("__before") >= F.col("delay"))
    marked = gaps.withColumn("__start", F.when(starts, F.col("us"))).drop("__before")
    return ordered_rows(marked, order, ["rule"], carried={"run": "__start"}).drop("row_no", "__start")


def _double(times: DataFrame) -> DataFrame:
    """The same by pointers: each hit points to the first one of its run that its delay lets through."""
    hits = times.select("rule", "run", "us", F.col("us").alias("at"), F.lit(0).alias("asks"), F.col("us").alias("hit"))
    asks = times.select(
        "rule", "run", "us", (F.col("us") + F.col("delay")).alias("at"), F.lit(1).alias("asks"),
        F.lit(None).cast("bigint").alias("hit"))
    # From the latest moment back, the last hit passed is the next one in time.
    seen = ordered_rows(
        hits.unionByName(asks), [F.col("at").desc(), F.col("asks").asc(), F.col("us").asc()], ["rule", "run"],
        carried={"next": "hit"})
    node = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col("rule"), F.col(c).alias("us")))
    pointers = seen.where("asks = 1").select(node("us").alias("node"), node("next").alias("after"))
    first = times.groupBy("rule", "run").agg(F.min("us").alias("us")).select(node("us").alias("node"))
    fired = reached_forward(first, pointers.select("node", F.col("after").alias("up"))).select("node.rule", "node.us")
    return times.join(fired, ["rule", "us"], "left_semi").select("rule", "us", "event_id")


def alert_times(fired: DataFrame) -> DataFrame:
    return fired.select("rule", from_micros("us").alias("fired_at"), "event_id")
