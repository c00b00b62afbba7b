"""Grouped, conditional and share-of-total reports."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from setwise.functions.measures import floor_zero
from setwise.functions.times import int_div
from setwise.operators.ordered import ordered_rows


def literal_text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ordered_list(value: str, delimiter: str, order: str) -> Column:
    """String aggregate of ``value`` in ``order`` (a SQL sort list)."""
    return F.expr(f"listagg({value}, {literal_text(delimiter)}) within group (order by {order})")


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def rollup_total(
    df: DataFrame, group: str, item: str, measures: Mapping[str, Column], total_label: str = "*** Total ***",
) -> DataFrame:
    """Detail rows plus one grand total; the per-group subtotals are dropped.

    ``sort_group`` is 0 for detail and 1 for the total, so that ordering by it
    puts the total last.
    """
    level = F.grouping_id()
    return (
        df.rollup(group, item)
        .agg(*[c.alias(n) for n, c in measures.items()], level.alias("__level"))
        .where(F.col("__level").isin(0, 3))
        .select(
            F.col(group),
            F.when(F.col("__level") == 3, F.lit(total_label)).otherwise(F.col(item)).alias(item),
            *measures, F.when(F.col("__level") == 3, 1).otherwise(0).alias("sort_group"),
        )
    )


def share_of_total(df: DataFrame, measure: str, name: str = "pct", type_: str = "decimal(10,2)") -> DataFrame:
    """Each row's percentage of the sum over all rows.

    The total is a one-value subquery over the (already aggregated) input, not
    an unpartitioned window.
    """
    total = df.agg(F.sum(measure)).scalar()
    return df.withColumn(name, (F.lit(100) * F.col(measure) / F.nullif(total, F.lit(0))).cast(type_))


def share_of_capacity(df: DataFrame, part: str, capacity: str, name: str = "pct", type_: str = "decimal(18,2)") -> DataFrame:
    """Each row's part as a percentage of its own capacity; a capacity of zero counts as 0.001, so nothing divides by it."""
    return df.withColumn(name, (F.lit(100) * F.col(part) / floor_zero(capacity)).cast(type_))


def pareto(
    df: DataFrame, item: str, measure: str, coverage: float = 95, exclude: Sequence[str] = (),
) -> DataFrame:
    """Largest items first until the share before an item reaches ``coverage`` percent.

    Input has one row per item. Adds ``total``, ``running`` and ``row_no``.
    Comparing ``100 * before < coverage * total`` keeps everything exact.
    """
    if exclude:
        df = df.where(~F.col(item).isin(*exclude))
    ranked = ordered_rows(
        df, [F.col(measure).desc(), F.col(item).asc()], running={"running": measure}
    )
    # Summed from the stored ranks, so that the input is read once.
    total = ranked.agg(F.sum(measure)).scalar()
    before = F.col("running") - F.col(measure)
    return ranked.withColumn("total", total).where(before * 100 < F.col("total") * F.lit(coverage))


def status_summary(df: DataFrame, keys: Sequence[Column], status: str, labels: Mapping[str, Sequence]) -> DataFrame:
    """Executions per key with one conditional count per label."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("executions"),
        *[F.count_if(F.col(status).isin(*values)).alias(label) for label, values in labels.items()],
    )


def bucket_profile(
    df: DataFrame, group: str, duration: Column, measure: Column, edges: Sequence[float],
    closed: str = "both", prefix: str = "bucket",
) -> DataFrame:
    """Per group: touches, average and total duration, average measure, counts per bucket.

    ``closed='both'`` counts a value on an inner edge in both neighbours;
    ``closed='left'`` counts it once, in the bucket that begins there, and the
    last edge in the last bucket.
    """
    if closed not in ("both", "left"):
        raise ValueError(f"closed must be 'both' or 'left', not {closed!r}")
    counts = []
    for lo, hi in zip(edges, edges[1:]):
        whole = closed == "both" or hi == edges[-1]
        inside = measure.between(lo, hi) if whole else (measure >= lo) & (measure < hi)
        counts.append(F.count_if(inside).alias(f"{prefix}{hi:g}"))
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("touches"), F.avg(duration).alias("avg_duration"),
        F.sum(duration).alias("total_duration"), F.avg(measure).alias("avg_measure"), *counts,
    )


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: its name and row count."""
    parts = [df.selectExpr(f"{literal_text(n)} as table_name", "count(1) as rows") for n, df in tables.items()]
    return functools.reduce(DataFrame.union, parts)


def group_concat(
    df: DataFrame, by: Sequence[str], value: str, delimiter: str = ",", descending: bool = False,
    distinct: bool = False, name: str = "joined",
) -> DataFrame:
    """Join the values of each group into one string, sorted by value; NULLs are skipped.

    Equal values are counted before the shuffle, so what travels and what one
    task holds is the distinct values of a group. A cell must be able to hold
    the text: for groups without such a bound use ``group_concat_parts``.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    text = F.col(value).cast("string")
    if not distinct:
        more = F.repeat(F.concat(F.lit(delimiter), text), (F.col("__n") - 1).cast("int"))
        text = F.concat(text, more)
    ready = counted.withColumn("__text", text)
    order = f"`{value}` {'desc' if descending else 'asc'}"
    return ready.groupBy(*by).agg(ordered_list("__text", delimiter, order).alias(name))


def group_concat_parts(
    df: DataFrame, by: Sequence[str], value: str, order: Sequence[Column], delimiter: str = ",",
    rows_per_part: int = 1000, name: str = "joined",
) -> DataFrame:
    """Group strings of any length, as numbered parts of at most ``rows_per_part`` values.

    The parts of a group in ``part_no`` order, joined by the delimiter, are the
    group's whole string; no task or cell ever holds more than one part.
    """
    rows = ordered_rows(df.where(F.col(value).isNotNull()), order, by)
    parted = rows.withColumn("part_no", int_div(F.col("row_no") - 1, rows_per_part) + 1)
    return parted.withColumn("__text", F.col(value).cast("string")).groupBy(*by, "part_no").agg(
        F.count(F.lit(1)).alias("n"), ordered_list("__text", delimiter, "row_no").alias(name)
    )


def rollup_strings(
    df: DataFrame, outer: Sequence[str], inner: str, value: str, inner_delimiter: str = ",",
    outer_delimiter: str = "; ", rows_per_part: int | None = None, name: str = "joined",
) -> DataFrame:
    """Two-level string rollup: distinct values per inner key, then ``inner=values`` per outer key.

    With ``rows_per_part`` an outer key's text comes as numbered parts of at most so many inner keys.
    """
    first = group_concat(df, [*outer, inner], value, inner_delimiter, distinct=True, name="__inner")
    labelled = first.withColumn("__item", F.concat(F.col(inner).cast("string"), F.lit("="), F.col("__inner")))
    if rows_per_part:
        return group_concat_parts(labelled, outer, "__item", [F.col(inner).asc()], outer_delimiter, rows_per_part, name)
    return labelled.groupBy(*outer).agg(ordered_list("__item", outer_delimiter, f"`{inner}`").alias(name))


def accumulate_list(
    df: DataFrame, value: str, delimiter: str = ", ", strip_chars: int = 0, quote: str = '"', name: str = "joined",
) -> DataFrame:
    """Distinct values of the whole set in one string, optionally cut at the front and quoted.

    One cell holds them all: for sets without a bound use ``accumulate_parts``.
    """
    return _items(df, value, strip_chars, quote).agg(ordered_list("__item", delimiter, "__item").alias(name))


def accumulate_parts(
    df: DataFrame, value: str, delimiter: str = ", ", strip_chars: int = 0, quote: str = '"', rows_per_part: int = 1000, name: str = "joined",
) -> DataFrame:
    """The same as numbered parts (part_no, n, ``name``) of at most ``rows_per_part`` values, in order; no task holds more than its range of them."""
    return group_concat_parts(_items(df, value, strip_chars, quote), [], "__item", [F.col("__item").asc()], delimiter, rows_per_part, name)


def _items(df: DataFrame, value: str, strip_chars: int, quote: str) -> DataFrame:
    item = F.substring(value, F.lit(1 + strip_chars), F.length(value))
    return df.where(F.col(value).isNotNull()).select(F.concat(F.lit(quote), item, F.lit(quote)).alias("__item")).distinct()


def wait_digest(df: DataFrame, entity: Sequence[str], kind: str, wait_ms: str, name: str = "digest") -> DataFrame:
    """Per entity: ``(2x: 5/9ms)KIND`` per kind of wait, most frequent first.

    One wait shows its time, two show both, more show minimum/average/maximum;
    equal extremes collapse to one number. The average is truncated.
    """
    per_kind = df.groupBy(*entity, kind).agg(
        F.count(F.lit(1)).alias("__n"), F.min(wait_ms).alias("__lo"), F.max(wait_ms).alias("__hi"),
        F.sum(wait_ms).alias("__sum"),
    )
    lo, hi = F.col("__lo").cast("string"), F.col("__hi").cast("string")
    mid = int_div("__sum", F.col("__n")).cast("string")
    times = (
        F.when(F.col("__lo") == F.col("__hi"), lo)
        .when(F.col("__n") == 2, F.concat_ws("/", lo, hi))
        .otherwise(F.concat_ws("/", lo, mid, hi))
    )
    text = F.concat(F.lit("("), F.col("__n").cast("string"), F.lit("x: "), times, F.lit("ms)"), F.col(kind))
    return per_kind.withColumn("__text", text).groupBy(*entity).agg(
        ordered_list("__text", ", ", f"__n desc, `{kind}`").alias(name)
    )


def txn_digest(
    df: DataFrame, entity: Sequence[str], database: str, records: str, size_bytes: str, begin: str,
    name: str = "digest",
) -> DataFrame:
    """Per entity: ``db: n (k kB)`` per database, and the earliest begin over all of them."""
    per_db = df.groupBy(*entity, database).agg(
        F.sum(records).alias("__n"), F.sum(size_bytes).alias("__bytes"), F.min(begin).alias("__begin")
    )
    kb = int_div("__bytes", 1024).cast("string")
    text = F.concat(F.col(database), F.lit(": "), F.col("__n").cast("string"), F.lit(" ("), kb, F.lit(" kB)"))
    return per_db.withColumn("__text", text).groupBy(*entity).agg(
        ordered_list("__text", ", ", f"`{database}`").alias(name), F.min("__begin").alias("first_begin"),
    )


def merge_partials(
    df: DataFrame, keys: Sequence[str], maxima: Sequence[str] = (), minima: Sequence[str] = (), sums: Sequence[str] = (),
) -> DataFrame:
    """Second-level aggregation of stored partials: max of max, min of min, sum of counts."""
    aggs = [F.max(c).alias(c) for c in maxima] + [F.min(c).alias(c) for c in minima] + [F.sum(c).alias(c) for c in sums]
    return df.groupBy(*keys).agg(*aggs)


def two_level_count(
    df: DataFrame, inner: Sequence[str], outer: Sequence[str], measure: Callable[[], Column], keep: Column,
    name: str = "total",
) -> DataFrame:
    """Aggregate per inner key, then per outer key, keeping groups past a threshold."""
    per_inner = df.groupBy(*inner).agg(measure().alias("__part"))
    return per_inner.groupBy(*outer).agg(
        F.sum("__part").alias(name), F.count(F.lit(1)).alias("parts")
    ).where(keep)
