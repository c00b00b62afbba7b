"""Top rows, latest rows, numbering and order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import takewhile

from pyspark.sql import Column, DataFrame, functions as F

from setwise.operators.ordered import ordered_rows


def row_number_by(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "row_no") -> DataFrame:
    """Ordinal within each group, or over the whole set when ``by`` is empty."""
    return ordered_rows(df, order, by, number=name)


def keep_first(df: DataFrame, by: Sequence[str], order: Mapping[str, bool]) -> DataFrame:
    """One row per group: the first in ``order`` (column -> descending?).

    A reduction, not a window: partial results merge before the shuffle, so a
    key with a third of all rows costs one row per task. NULL order values
    come first when ascending and last when descending.
    """
    return best_row(df, by, order)


_WHOLE = ("byte", "short", "integer", "long")


def _descending(df: DataFrame, c: str) -> list[Column] | None:
    """Columns whose descending order is the ascending one of ``c``, NULL first; None for texts."""
    kind = df.schema[c].dataType.typeName()
    turned = {
        **dict.fromkeys(_WHOLE, lambda x: F.bitwise_not(x)), **dict.fromkeys(("float", "double", "decimal"), lambda x: -x),
        "date": lambda x: -F.unix_date(x), "timestamp": lambda x: -F.unix_micros(x),
        "timestamp_ntz": lambda x: -F.unix_micros(x.cast("timestamp")), "boolean": lambda x: ~x}.get(kind)
    return [F.isnull(c).alias(f"{c}_none"), turned(F.col(c)).alias(c)] if turned else None


def best_row(df: DataFrame, by: Sequence[str], order: Mapping[str, bool]) -> DataFrame:
    """One row per group by a multi-column priority (column -> descending?).

    All-descending and all-ascending priorities reduce with ``max_by`` and
    ``min_by``; in mixed ones ascending columns are turned round. Text cannot
    be: there the columns before a change of direction are decided first, and
    only the rows that tie in them go on.
    """
    turned = {c: _descending(df, c) for c, desc in order.items() if not desc}
    mixed = len(set(order.values())) > 1
    if mixed and None in turned.values():
        first = next(iter(order.values()))
        head = list(takewhile(lambda c: order[c] == first, order))
        best = (F.max if first else F.min)(F.struct(*head)).alias("__best")
        tied = with_group_totals(df, by, {"__best": best}).where(F.struct(*head).eqNullSafe(F.col("__best"))).drop("__best")
        return best_row(tied, by, {c: desc for c, desc in order.items() if c not in head})
    whole = F.struct(*df.columns)
    if mixed:
        keys = [x for c, desc in order.items() for x in ([F.col(c)] if desc else turned[c])]
        pick = F.max_by(whole, F.struct(*keys))
    else:
        pick = (F.max_by if set(order.values()) == {True} else F.min_by)(whole, F.struct(*order))
    return df.groupBy(*by).agg(pick.alias("__row")).select(
        *[F.col("__row")[c].alias(c) for c in df.columns]
    )


def latest_per_group(df: DataFrame, by: Sequence[str], time: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The whole latest row of each group."""
    return best_row(df, by, {c: True for c in (time, *tiebreak)})


def latest_or_none(
    entities: DataFrame, rows: DataFrame, key: str, time: str, tiebreak: Sequence[str],
    label: str, missing: str = " none",
) -> DataFrame:
    """Latest row per entity, entities without any kept and labelled ``missing``."""
    latest = latest_per_group(rows, [key], time, tiebreak)
    joined = entities.join(latest, key, "left")
    return joined.withColumn(label, F.coalesce(F.col(label).cast("string"), F.lit(missing)))


def dense_ids(df: DataFrame, key: str, name: str = "dense_id") -> DataFrame:
    """Dense surrogate numbers for the distinct keys, in key order, beside each row."""
    ids = ordered_rows(df.select(key).distinct(), [F.col(key).asc()], number=name).withColumnRenamed(key, "__key")
    return df.join(ids, df[key].eqNullSafe(ids["__key"])).drop("__key")  # NULL has a number as well


def with_group_totals(df: DataFrame, by: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Group-wide aggregates beside each row.

    Aggregate and join back instead of a window: the aggregate merges before
    the shuffle and the join can split a hot key at run time.
    """
    grouped = df.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()])
    renamed = grouped.select(*[F.col(k).alias(f"__k_{k}") for k in by], *totals)
    same = F.lit(True)
    for k in by:
        same = same & df[k].eqNullSafe(renamed[f"__k_{k}"])
    return df.join(renamed, same).select(*df.columns, *totals)


def top_n(df: DataFrame, score: Column, n: int, tiebreak: Sequence[Column], name: str = "score") -> DataFrame:
    """The ``n`` best rows by a derived score: per-task heaps, no full sort."""
    return df.withColumn(name, score).orderBy(F.col(name).desc(), *tiebreak).limit(n)


def ordered_report(df: DataFrame, *order: Column) -> DataFrame:
    return df.orderBy(*order)
