"""Streams over arriving files. Each job repeats a batch without changing its result.

Every micro-batch writes folders named after its number and replaces them when
it runs again after a failure; nothing depends on how often a batch ran.

Rows may arrive late. A job then writes what changes from the late moment on
under the number of the present batch, and reading takes the newest version:
``current_captures`` and ``current_alerts``. No stored batch is rewritten.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from setwise.functions.times import col
from setwise.operators.alerts import fire_alerts
from setwise.operators.incremental import snapshot_series_delta
from setwise.operators.ranking import latest_per_group
from setwise.session import Scratch, materialize
from setwise.sources.sinks import replace_partitions


def run_batches(source: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    def run(df: DataFrame, batch: int) -> None:
        with Scratch(df.sparkSession):  # what operators store in a batch goes with it
            work(df, batch)

    writer = source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _put(df: DataFrame, folder: str, batch: int, by: str = "batch") -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{by}={batch}")


class BatchHistory:
    """All rows of earlier batches, read only for keys with late rows and only from the late moment on."""

    def __init__(self, folder: str, schema: StructType):
        self.folder, self.schema = folder, schema

    def before(self, spark: SparkSession, batch: int) -> DataFrame:
        held = spark.read.schema(StructType([*self.schema.fields, StructField("__batch", LongType())])).parquet(self.folder)
        return held.where(F.col("__batch") < batch).drop("__batch")

    def store(self, df: DataFrame, batch: int) -> None:
        _put(df.select(*self.schema.names), self.folder, batch, "__batch")


class BatchState:
    """What earlier batches left behind, one row per key.

    A batch stores only the keys it touched; every ``compact_every`` batches
    the whole state is stored, so that reading never goes further back.
    """

    def __init__(self, folder: str, schema: StructType, keys: Sequence[str], order: Sequence[str], compact_every: int = 10):
        self.folder, self.schema, self.keys, self.order = folder, schema, list(keys), list(order)
        self.compact_every = compact_every

    def before(self, spark: SparkSession, batch: int) -> DataFrame | None:
        if batch == 0:
            return None
        last = batch - 1
        base = last // self.compact_every * self.compact_every
        paths = [f"{self.folder}/batch={b}" for b in range(base, last + 1)]
        return self._newest(spark.read.schema(self.schema).parquet(*paths))

    def store(self, touched: DataFrame, before: DataFrame | None, batch: int) -> None:
        if batch % self.compact_every == 0 and before is not None:
            touched = self._newest(before.unionByName(touched))
        _put(touched.select(*self.schema.names), self.folder, batch)

    def _newest(self, df: DataFrame) -> DataFrame:
        return latest_per_group(df, self.keys, self.order[0], self.order[1:])


def stream_rollup(
    source: DataFrame, target: str, checkpoint: str, keys: Sequence[str], time: str, width: str = "1 hour",
) -> StreamingQuery:
    """Max/min/count per window and key, as partials per batch; merge them when reading.

    No state and no watermark: late rows land in a later partial of the same
    window and are merged like all others.
    """
    def work(df: DataFrame, batch: int) -> None:
        per = df.groupBy(F.window(col(time).cast("timestamp"), width).alias("w"), *keys).agg(
            F.max(time).alias("latest"), F.min(time).alias("earliest"), F.count(F.lit(1)).alias("n"))
        _put(per.select(F.col("w.start").alias("window_start"), *keys, "latest", "earliest", "n"), target, batch)

    return run_batches(source, work, checkpoint)


def windowed_rollup(source: DataFrame, keys: Sequence[str], time: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """The same as a streaming aggregation: final rows once the watermark passes a window; later rows are dropped."""
    zoned = source.withColumn("__t", col(time).cast("timestamp")).withWatermark("__t", delay)
    return zoned.groupBy(F.window("__t", width).alias("w"), *keys).agg(
        F.max(time).alias("latest"), F.min(time).alias("earliest"), F.count(F.lit(1)).alias("n")
    ).select(F.col("w.start").alias("window_start"), *keys, "latest", "earliest", "n")


def stream_windowed_rollup(
    source: DataFrame, target: str, checkpoint: str, keys: Sequence[str], time: str, width: str = "1 hour", delay: str = "1 hour",
) -> tuple[StreamingQuery, StreamingQuery]:
    """Final rows of closed windows from Spark's keyed state, and beside them partials of all rows, late ones too.

    A window is closed, and its state dropped, once the watermark passes its
    end; rows that come later do not change it. ``closed_windows`` reads both
    and counts the late rows apart. Each query keeps its own checkpoint, so a
    restart goes on where it stood and a repeated batch replaces its output.
    """
    closed = windowed_rollup(source, keys, time, width, delay).writeStream.format("parquet").outputMode("append").option(
        "path", f"{target}/closed").option("checkpointLocation", f"{checkpoint}/closed").trigger(availableNow=True).start()
    return closed, stream_rollup(source, f"{target}/all", f"{checkpoint}/all", keys, time, width)


def closed_windows(spark: SparkSession, target: str, keys: Sequence[str], schema: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(window_start, keys, latest, earliest, n, n_late) of every window that the watermark has passed.

    ``n_late`` rows came after their window was closed and are in none of the
    other columns; a window that only late rows fell into has NULL times.
    ``schema`` declares the keys and ``latest`` and ``earliest``.
    """
    columns = f"window_start timestamp, {schema}, n bigint"
    final = spark.read.schema(columns).parquet(f"{target}/closed")
    seen = spark.read.schema(columns).parquet(f"{target}/all").groupBy("window_start", *keys).agg(
        F.sum("n").alias("__all"), F.max("latest").alias("__latest"))
    passed = seen.agg((F.max("__latest").cast("timestamp") - F.expr(f"interval {delay}")).alias("__watermark"))
    over = seen.join(F.broadcast(passed), F.col("window_start") + F.expr(f"interval {width}") <= F.col("__watermark"))  # one row
    return over.join(final, ["window_start", *keys], "left").select(
        "window_start", *keys, "latest", "earliest", F.coalesce("n", F.lit(0)).alias("n"),
        (F.col("__all") - F.coalesce("n", F.lit(0))).alias("n_late"))


def stream_alerts(
    source: DataFrame, hits: Callable[[DataFrame], DataFrame], target: str, state: str, checkpoint: str,
) -> StreamingQuery:
    """Alerts as they are due, whatever the order in which hits arrive; ``current_alerts`` reads them.

    The state is the last firing of each rule and the hits. A hit no later than
    its rule's last firing reopens the rule from that moment on: its hits since
    are folded again, after the firing that stood before them, and what had
    fired since is withdrawn on reading.
    """
    fired_last = BatchState(f"{state}/last", StructType.fromDDL("rule string, us bigint, batch bigint"), ["rule"], ["batch"])
    seen = BatchHistory(f"{state}/hits", StructType.fromDDL("rule string, delay bigint, us bigint, event_id bigint"))

    def work(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        before = fired_last.before(spark, batch)
        fresh = materialize(hits(df).select(*seen.schema.names), "fresh")
        timed = fresh.where("delay > 0").groupBy("rule", "delay", "us").agg(F.min("event_id").alias("event_id"))
        seen.store(timed, batch)
        since = timed.groupBy("rule").agg(F.min("us").alias("since"))
        due, carried = fresh, before
        if before is not None:
            late = materialize(before.join(since, "rule").where("since <= us").select("rule", "since"), "late")
            first = late.agg(F.min("since")).first()[0]
            if first is not None:
                held = seen.before(spark, batch).where(F.col("us") >= first).join(late, "rule").where("us >= since")
                due = fresh.unionByName(held.drop("since"))
                stood = current_alerts(spark, target, batch).join(late, "rule").where("us < since").groupBy("rule").agg(F.max("us").alias("us"))
                carried = before.select("rule", "us").join(late, "rule", "left_anti").unionByName(stood)
        fired = materialize(fire_alerts(due, carried), "fired")
        _put(fired, f"{target}/fired", batch)
        _put(since, f"{target}/since", batch)
        last = fired.join(since, "rule", "left_semi").groupBy("rule").agg(F.max("us").alias("us"))
        fired_last.store(last.withColumn("batch", F.lit(batch).cast("bigint")), before, batch)

    return run_batches(source, work, checkpoint)


def current_alerts(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """(rule, us, event_id): the firings that no later batch has reopened, of batches before ``before`` if given.

    Per rule and batch there is one moment since which the batch has folded again.
    """
    read = lambda part, ddl: spark.read.schema(f"{ddl}, batch bigint").parquet(f"{target}/{part}")
    fired, since = read("fired", "rule string, us bigint, event_id bigint"), read("since", "rule string, since bigint")
    if before is not None:
        fired, since = (x.where(F.col("batch") < before) for x in (fired, since))
    later = Window.partitionBy("rule").orderBy(F.col("batch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    reopened = since.select("rule", "batch", F.min("since").over(later).alias("again"))
    return fired.join(reopened, ["rule", "batch"], "left").where("again IS NULL OR us < again").select("rule", "us", "event_id")


def stream_delta(
    source: DataFrame, target: str, state: str, checkpoint: str, entity: Sequence[str], time: str,
    metrics: Sequence[str], started: str, tiebreak: Sequence[str],
) -> StreamingQuery:
    """Differences between consecutive captures of each entity, across batches and in any order of arrival.

    The state is the last capture of each entity, and all captures for entities
    with late ones. A late capture gets its own difference, and the one after it
    a new version; ``current_captures`` reads the newest. ``tiebreak`` tells
    captures of one moment apart.
    """
    columns, order = source.schema, [time, *tiebreak]
    last = BatchState(f"{state}/last", columns, entity, order)
    seen = BatchHistory(f"{state}/rows", columns)
    moment = F.struct(*order)

    def work(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        before = last.before(spark, batch)
        seen.store(df, batch)
        rows = df.withColumn("__new", F.lit(True))
        if before is not None:
            first = df.groupBy(*entity).agg(F.min(moment).alias("__first"))
            known = before.join(first, list(entity))
            late = materialize(known.where(F.col("__first") < moment).select(*entity, "__first"), "late")
            earlier = known.where(F.col("__first") >= moment).drop("__first")
            if not late.isEmpty():
                held = seen.before(spark, batch).join(late, list(entity))
                after = held.where(moment >= F.col("__first")).drop("__first")
                just_before = latest_per_group(held.where(moment < F.col("__first")).drop("__first"), entity, time, tiebreak)
                earlier = earlier.unionByName(after).unionByName(just_before)
            rows = rows.unionByName(earlier.withColumn("__new", F.lit(False)))
        out = snapshot_series_delta(rows, entity, time, metrics, started, tiebreak, before={"__after_new": "__new"})
        changed = F.col("__new") | F.coalesce(F.col("__after_new"), F.lit(False))
        _put(out.where(changed).drop("__new", "__after_new", "capture_no"), target, batch)
        last.store(latest_per_group(df, entity, time, tiebreak), before, batch)

    return run_batches(source, work, checkpoint)


def current_captures(captures: DataFrame, entity: Sequence[str], time: str, tiebreak: Sequence[str]) -> DataFrame:
    """The newest version of each capture that ``stream_delta`` wrote."""
    return latest_per_group(captures, [*entity, time, *tiebreak], "batch").drop("batch")


def _runs(days: Sequence[date]) -> list[tuple[date, date]]:
    """First day and the day after the last of each run of consecutive days."""
    starts = [d for i, d in enumerate(days) if not i or days[i - 1] + timedelta(1) < d]
    ends = [d + timedelta(1) for i, d in enumerate(days) if i + 1 == len(days) or d + timedelta(1) < days[i + 1]]
    return list(zip(starts, ends, strict=True))


def stream_daily_snapshot(
    source: DataFrame, reread: Callable[[], DataFrame], target: str, checkpoint: str, time: str,
    summarise: Callable[[DataFrame], DataFrame], day: str = "snapshot_date",
) -> StreamingQuery:
    """Reload the days a batch touches from the whole source, replacing their partitions.

    ``summarise`` gets rows with the ``day`` column and keeps it. A day that
    arrives in pieces is complete after its last piece, however often it is reloaded.
    """
    with_day = lambda df: df.withColumn(day, col(time).cast("date"))
    at = lambda d: F.lit(d).cast("timestamp_ntz")

    def work(df: DataFrame, batch: int) -> None:
        days = with_day(df).select(day).where(F.col(day).isNotNull()).distinct()
        touched = sorted(r[0] for r in days.collect())  # a row a day
        if not touched:
            return
        # Runs of touched days reach the file scan; days between them are not read.
        wanted = reduce(Column.__or__, [(F.col(time) >= at(lo)) & (F.col(time) < at(hi)) for lo, hi in _runs(touched)])
        rows = with_day(reread().where(wanted))
        replace_partitions(summarise(rows), target, [day])

    return run_batches(source, work, checkpoint)
