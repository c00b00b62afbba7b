"""Prioritised work queues."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from setwise.functions.times import boundaries
from setwise.operators.ordered import ordered_rows

QUEUE_KEYS = ["database_id", "object_id", "index_id", "partition_number"]
_INDEX = QUEUE_KEYS[:3]
# Columns the queue may be ordered by.
ORDER_COLUMNS = ("range_scan_count", "fragmentation", "page_count")


@dataclass(frozen=True)
class QueueOptions:
    """Thresholds of the queue; values out of range fall back to the defaults."""

    min_fragmentation: float = 10.0
    rebuild_threshold: float = 30.0
    min_pages: int = 8
    max_pages: int | None = None
    exclude_max_partition: bool = False
    order_column: str = "range_scan_count"
    descending: bool = True

    def checked(self) -> "QueueOptions":
        percent = lambda x, default: x if x is not None and 0 <= x <= 100 else default
        return QueueOptions(
            percent(self.min_fragmentation, 10.0), percent(self.rebuild_threshold, 30.0), self.min_pages,
            self.max_pages, self.exclude_max_partition,
            self.order_column if self.order_column in ORDER_COLUMNS else "range_scan_count", self.descending)


def maintenance_queue(
    metrics: DataFrame, exclusions: DataFrame | None = None, weekday: int = 1, options: QueueOptions = QueueOptions(),
) -> DataFrame:
    """What to maintain on a weekday (Sunday 1), with the action each item needs.

    ``metrics`` has the queue keys, fragmentation, page_count,
    range_scan_count, index_level, rows, contains_lob, allow_page_locks.
    ``exclusions`` has database_id, object_id, index_id and a bit mask of
    weekdays (Sunday 1 .. Saturday 64) the item must be left alone on.
    """
    o = options.checked()
    wanted = metrics.where(
        (F.col("fragmentation") >= o.min_fragmentation) & (F.col("index_id") > 0)
        & (F.col("page_count") > o.min_pages) & (F.col("index_level") == 0))
    queue = wanted.groupBy(*QUEUE_KEYS, "range_scan_count").agg(
        F.sum("fragmentation").alias("fragmentation"), F.sum("page_count").alias("page_count"),
        F.bool_or("contains_lob").alias("contains_lob"), F.bool_and("allow_page_locks").alias("allow_page_locks"))
    # One row per index: how many partitions it has and its last populated one.
    shape = metrics.groupBy(*_INDEX).agg(
        F.max("partition_number").alias("__partitions"),
        F.max(F.when((F.col("partition_number") > 1) & (F.col("rows") > 0), F.col("partition_number"))).alias("__last"))
    queue = queue.join(shape, _INDEX)
    if o.exclude_max_partition:
        queue = queue.where(F.col("__last").isNull() | (F.col("partition_number") != F.col("__last")))
    if exclusions is None:
        queue = queue.withColumn("exclusion_mask", F.lit(0))
    else:
        queue = queue.join(exclusions.select(*_INDEX, "exclusion_mask"), _INDEX, "left").withColumn(
            "exclusion_mask", F.coalesce("exclusion_mask", F.lit(0)))
    top = F.lit(o.max_pages) if o.max_pages is not None else F.col("page_count")
    queue = queue.where(
        (F.col("exclusion_mask").bitwiseAND(1 << (weekday - 1)) == 0) & F.col("page_count").between(F.lit(o.min_pages), top))
    light = F.col("fragmentation") < o.rebuild_threshold
    whole = ~F.col("contains_lob") & (F.col("__partitions") <= 1)
    action = (
        F.when((light | ~whole) & F.col("allow_page_locks"), "REORGANIZE")
        .when((~light | ~F.col("allow_page_locks")) & whole, "REBUILD")
        .otherwise("NONE")
    )
    return queue.withColumn("action", action).drop("__partitions", "__last")


def queue_order(options: QueueOptions = QueueOptions()) -> list:
    """Sort columns of the queue, with its keys as tiebreak."""
    o = options.checked()
    first = F.col(o.order_column)
    rest = [F.col(c).asc() for c in [*QUEUE_KEYS, "range_scan_count"]]
    return [first.desc() if o.descending else first.asc(), *rest]


def budgeted_queue(queue: DataFrame, order: list, cost: str, budget: float) -> DataFrame:
    """Work started before the budget runs out: an item starts if what was spent before it is below.

    Adds ``queue_no``, ``start_at`` and ``end_at`` in cost units.
    """
    rows = ordered_rows(queue, order, number="queue_no", running={"end_at": cost})
    return rows.withColumn("start_at", F.col("end_at") - F.col(cost)).where(F.col("start_at") < budget)


def work_log(queue: DataFrame, outcomes: DataFrame, keys: list[str], started: str, finished: str, error: str) -> DataFrame:
    """What became of the queued items: start, end, seconds taken and error.

    A failed item has -1 seconds; one not started yet has NULL for all.
    """
    seconds = boundaries("second", started, finished)
    taken = F.when(F.col(error).isNotNull(), F.lit(-1)).otherwise(seconds)
    return queue.join(outcomes.select(*keys, started, finished, error), keys, "left").withColumn("duration_seconds", taken)
