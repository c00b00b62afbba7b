"""Row numbers, running sums and previous rows without one-task groups.

A window partitioned by a key sorts all rows of that key in one task, and a
window without a key sorts the whole table in one. Here rows are
range-partitioned by (key, order) into slices, each slice is worked on its
own, and what earlier slices hold of the same key is added afterwards.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from setwise.session import materialize

_SLICE = "__slice"


def ordered_rows(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    number: str = "row_no",
    running: Mapping[str, str] | None = None,
    carried: Mapping[str, str] | None = None,
    previous: Mapping[str, str] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Add columns that depend on the rows before, per ``by`` group in ``order``.

    ``number``: 1-based ordinal. The other arguments map new columns to source
    columns: ``running`` sums up to the current row, ``carried`` the last
    non-NULL value up to the current row, ``previous`` the value one row
    before. ``order`` must end in a tiebreak for a repeatable result.
    ``slices`` fixes the number of slices, which else follows their size.
    """
    by, running, carried, previous = list(by), dict(running or {}), dict(carried or {}), dict(previous or {})
    keys = [*[F.col(k).asc() for k in by], *order]
    # Without a number, AQE joins small slices by their size; the session's shuffle partitions are the most there can be.
    ranged = df.repartitionByRange(slices, *keys) if slices else df.repartitionByRange(*keys)
    sliced = ranged.withColumn(_SLICE, F.spark_partition_id())
    local = Window.partitionBy(_SLICE, *by).orderBy(*order)
    so_far = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Stored once: the slice a row falls into must not be drawn again when the
    # passes below read it, nor when an executor is lost.
    if not by and not (running or carried or previous):
        # Numbers of the whole table need no window: a row's place in its sorted slice is its number there.
        placed = ranged.sortWithinPartitions(*keys).select(*df.columns, F.monotonically_increasing_id().alias("__at"))
        stored = materialize(placed.select(
            *df.columns, F.shiftright("__at", 33).cast("int").alias(_SLICE), (F.col("__at").bitwiseAND((1 << 33) - 1) + 1).alias(number)), "ordered")
    else:
        stored = materialize(
            sliced.select(
                *df.columns, _SLICE, F.row_number().over(local).cast("bigint").alias(number),
                *[F.sum(c).over(so_far).alias(new) for new, c in running.items()],
                *[F.last(c, ignorenulls=True).over(so_far).alias(new) for new, c in carried.items()],
                *[F.lag(c).over(local).alias(new) for new, c in previous.items()],
            ), "ordered")

    at_end = lambda c: F.max_by(c, number)
    held = stored.groupBy(_SLICE, *by).agg(
        F.max(number).alias("__rows"),
        *[at_end(new).alias(f"__run_{new}") for new in running],
        *[at_end(new).alias(f"__car_{new}") for new in carried],
        *[at_end(c).alias(f"__prev_{new}") for new, c in previous.items()],
    )
    earlier = Window.partitionBy(*by).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    before = held.select(
        F.col(_SLICE).alias("__b_slice"), *[F.col(k).alias(f"__k_{k}") for k in by],
        F.sum("__rows").over(earlier).alias("__b_rows"),
        *[F.sum(f"__run_{new}").over(earlier).alias(f"__b_{new}") for new in running],
        *[F.last(f"__car_{new}", ignorenulls=True).over(earlier).alias(f"__b_{new}") for new in carried],
        *[F.last(f"__prev_{new}").over(earlier).alias(f"__b_{new}") for new in previous],
    ).where("__b_rows is not null")
    # Slices are ranges of (key, order), so only the first key of a slice can
    # have started earlier: `before` has fewer rows than there are slices.
    same = stored[_SLICE] == F.col("__b_slice")
    for k in by:
        same = same & stored[k].eqNullSafe(F.col(f"__k_{k}"))
    first_here = F.col(number) == 1
    return stored.join(F.broadcast(before), same, "left").select(
        *df.columns,
        (F.col(number) + F.coalesce("__b_rows", F.lit(0))).alias(number),
        *[F.when(F.col(new).isNull() | F.col(f"__b_{new}").isNull(), F.coalesce(new, f"__b_{new}"))
          .otherwise(F.col(new) + F.col(f"__b_{new}")).alias(new) for new in running],
        *[F.coalesce(new, f"__b_{new}").alias(new) for new in carried],
        *[F.when(first_here, F.col(f"__b_{new}")).otherwise(F.col(new)).alias(new) for new in previous],
    )
