"""Interval, proximity, OR and set joins, each as equality joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from setwise.functions.times import int_div, micros, slot_of

TASK_ROWS = 500_000  # about so many rows of a large table in one task


def active_at(df: DataFrame, start: Column, end: Column, moment: Column, state: str | None = None, running=4) -> DataFrame:
    """Rows whose [start, end] contains ``moment``, both ends included.

    Rows still running (``state`` equal to ``running``) and rows without a
    state are left out when a state column is named.
    """
    out = df.where((start <= moment) & (end >= moment))
    return out if state is None else out.where(F.col(state).isNotNull() & (F.col(state) != F.lit(running)))


def active_at_many(
    intervals: DataFrame, start: str, end: str, probes: DataFrame, probe: str, width_us: int = 3_600_000_000,
) -> DataFrame:
    """Every (interval, probe) with start <= probe <= end.

    An interval goes to the one width, ``width_us`` doubled ``level`` times,
    that is at least its length: there it touches at most two buckets however
    long it is. A probe goes to its bucket at each level that occurs, which a
    narrow pass over the intervals finds. The equality join on (level, bucket)
    can then split hot buckets at run time.
    """
    lo, hi = micros(start), micros(end)
    length = F.greatest(hi - lo, F.lit(0))
    # Widths spanned, rounded up; the level is the number of bits of one less.
    spans = int_div(length + (width_us - 1), width_us)
    level = F.when(spans <= 1, F.lit(0)).otherwise(F.length(F.bin(spans - 1)))
    size = F.lit(width_us).cast("bigint") * F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("__level"))
    bucket = lambda t: int_div(t - F.pmod(t, size), size)
    left = intervals.where(F.col(start) <= F.col(end)).withColumn("__level", level).withColumn(
        "__bucket", F.explode(F.sequence(bucket(lo), bucket(hi))))
    levels = intervals.where(F.col(start) <= F.col(end)).agg(F.collect_set(level)).scalar()  # a few dozen at most
    right = probes.withColumn("__level", F.explode(levels)).withColumn("__bucket", bucket(micros(probe)))
    inside = (F.col(probe) >= F.col(start)) & (F.col(probe) <= F.col(end))
    return left.join(right, ["__level", "__bucket"]).where(inside).drop("__level", "__bucket")


def near_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, tolerance_us: int,
    right_attrs: Sequence[str] = (), inclusive: bool = True,
) -> DataFrame:
    """Distinct (left row, right attributes) whose times lie within a tolerance.

    Without ``right_attrs`` it answers which left rows have a neighbour. Times
    are cut into buckets of the tolerance's width. Right rows of the same
    bucket always match; of the bucket before only the latest can decide, of
    the one after only the earliest. So the right side shrinks to one row per
    (keys, attributes, bucket) and no pairs of rows are formed.
    """
    lt, rt = micros(left_time), micros(right_time)
    near = right.select(*keys, *right_attrs, slot_of(right_time, tolerance_us).alias("__b"), rt.alias("__t")).groupBy(
        *keys, *right_attrs, "__b").agg(F.min("__t").alias("__first"), F.max("__t").alias("__last"))
    # Each summary row serves the left rows of its own and both next buckets.
    offered = near.select("*", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])).alias("__d")).select(
        *keys, *right_attrs, (F.col("__b") + F.col("__d")).alias("__b"),
        F.when(F.col("__d") == 1, F.col("__last")).when(F.col("__d") == -1, F.col("__first")).alias("__t"),
    )
    # One row per (keys, attributes, left bucket): whether any time is in the
    # bucket itself, the latest before it and the earliest after it.
    offered = offered.groupBy(*keys, *right_attrs, "__b").agg(
        F.bool_or(F.col("__t").isNull()).alias("__same"),
        F.max(F.when(slot_of(F.timestamp_micros("__t"), tolerance_us) < F.col("__b"), F.col("__t"))).alias("__before"),
        F.min(F.when(slot_of(F.timestamp_micros("__t"), tolerance_us) > F.col("__b"), F.col("__t"))).alias("__after"),
    )
    slack = F.lit(tolerance_us if inclusive else tolerance_us - 1)
    hit = F.col("__same") | (F.col("__lt") - F.col("__before") <= slack) | (F.col("__after") - F.col("__lt") <= slack)
    marked = left.distinct().withColumns({"__b": slot_of(left_time, tolerance_us), "__lt": lt})
    how = "inner" if right_attrs else "left_semi"
    if not right_attrs:
        same = [marked[k] == offered[k] for k in keys] + [marked["__b"] == offered["__b"], hit]
        cond = same[0]
        for c in same[1:]:
            cond = cond & c
        return marked.join(offered, cond, how).drop("__b", "__lt")
    joined = marked.join(offered, [*keys, "__b"], how).where(hit)
    return joined.select(*left.columns, *right_attrs)


def orphans(left: DataFrame, right: DataFrame, on: Sequence[str] | Column) -> DataFrame:
    """Left rows with no match."""
    return left.join(right, on, "left_anti")


def except_then_in(rows: DataFrame, keys: DataFrame, minus: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``keys`` but not in ``minus``."""
    wanted = keys.select(key).subtract(minus.select(key))
    return rows.join(wanted, key, "left_semi")


def union_distinct(*frames: DataFrame) -> DataFrame:
    return union_all(*frames).distinct()


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def effective_grants(
    grants: DataFrame, members: DataFrame, principal: str, role: str, columns: Sequence[str], role_name: str = "role_name",
) -> DataFrame:
    """Direct grants plus those reached through a role; members of roles without grants stay.

    ``grants`` has ``principal`` and ``columns``; ``members`` has ``principal``
    (the member) and ``role`` (the principal it belongs to). A role's own
    grants are not direct grants of anyone.
    """
    roles = members.select(F.col(role).alias(principal)).distinct()
    direct = grants.join(roles, principal, "left_anti").select(
        principal, *columns, F.lit(None).cast("string").alias(role_name))
    granted = grants.select(F.col(principal).alias("__role"), *columns)
    via = members.join(granted, members[role] == granted["__role"], "left").select(
        members[principal], *columns, members[role].cast("string").alias(role_name))
    return union_distinct(direct, via)


def null_safe_diff(
    left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], null_aware: bool = True,
) -> DataFrame:
    """Left rows whose ``columns`` differ from the right row with the same key.

    The NULL-blind form loses rows where either value is NULL, as a plain
    inequality does.
    """
    renamed = right.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[F.col(c).alias(f"__r_{c}") for c in columns])
    same = F.lit(True)
    for k in keys:
        same = same & (left[k] == renamed[f"__k_{k}"])
    differs = F.lit(False)
    for c in columns:
        a, b = F.col(c), F.col(f"__r_{c}")
        differs = differs | (~a.eqNullSafe(b) if null_aware else a != b)
    return left.join(renamed, same).where(differs).select(
        *left.columns, *[F.col(f"__r_{c}").alias(f"other_{c}") for c in columns])


def or_join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_key: str, how: str = "inner") -> DataFrame:
    """Join where any of ``left_keys`` equals ``right_key``, each pair once.

    The keys of a row are unnested and made distinct first: one equality join
    then does it, with no nested loop and no de-duplication of the result.
    """
    probe = F.array_distinct(F.array_compact(F.array(*left_keys)))
    unnest = F.explode_outer if how == "left" else F.explode
    if how == "left":
        # A row is kept unmatched only if none of its keys match.
        hits = left.withColumn("__key", F.explode(probe)).join(right, F.col("__key") == right[right_key])
        none = left
        for k in left_keys:
            none = none.join(right.select(F.col(right_key).alias("__rk")), F.col(k) == F.col("__rk"), "left_anti")
        return hits.drop("__key").unionByName(none, allowMissingColumns=True)
    return left.withColumn("__key", unnest(probe)).join(right, F.col("__key") == right[right_key], how).drop("__key")


def above_average(df: DataFrame, measure: str, name: str = "average", where: Column | None = None) -> DataFrame:
    """Detail rows above a one-row aggregate of the whole set, the aggregate beside them."""
    base = df if where is None else df.where(where)
    mean = base.agg(F.avg(measure)).scalar()
    return df.withColumn(name, mean).where(F.col(measure) > F.col(name))


def first_non_null(df: DataFrame, sides: Sequence[tuple[DataFrame, str]], key: str, name: str, default) -> DataFrame:
    """The first value any of the optional sides has for a row's key, else ``default``."""
    values = []
    for i, (side, column) in enumerate(sides):
        alias = f"__v{i}"
        df = df.join(side.select(key, F.col(column).alias(alias)), key, "left")
        values.append(alias)
    return df.withColumn(name, F.coalesce(*values, F.lit(default))).drop(*values)


def parts_for(df: DataFrame) -> int | None:
    """How many partitions keep a task at about ``TASK_ROWS`` rows of ``df``; None where every core has fewer anyway."""
    parts = -(-df.count() // TASK_ROWS)
    spark = df.sparkSession
    return max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))) if parts > spark.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``df`` in ``parts`` partitions by its keys; as it is without a number."""
    return df.repartition(parts, *keys) if parts else df


def chained_lookup(
    df: DataFrame, links: Sequence[tuple[DataFrame, str, str, Sequence[str]]], dataset: str | None = None, failed: DataFrame | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Left-join a chain of lookups: each link is (table, table key, key expression, columns to bring).

    A key expression may use columns earlier links brought in. With
    ``dataset`` the tables carry that column too and it is part of each key,
    so rows of many datasets resolve in one pass. ``failed`` (dataset,
    query_error) are datasets whose tables could not be had: their rows find
    nothing and get that ``query_error``, all others NULL. With ``parts``
    tables that are not broadcast are joined in so many partitions; rows
    without a key, which find nothing, are spread over all of them.
    """
    for i, (table, table_key, key_expr, bring) in enumerate(links):
        k, d, spread = f"__k{i}", f"__d{i}", f"__s{i}"
        picked = table.select(F.col(table_key).alias(k), *bring, *([F.col(dataset).alias(d)] if dataset else []))
        cond = F.expr(key_expr) == F.col(k)
        if dataset:
            cond = cond & (F.col(dataset) == F.col(d))
        if parts:
            plain = [F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct", "variant"))]
            keyless = F.when(F.expr(key_expr).isNull(), F.xxhash64(*plain))
            picked = picked.withColumn(spread, F.when(F.col(k).isNull(), F.lit(1)).otherwise(0).cast("bigint"))
            picked = picked.repartition(parts, k, *([d] if dataset else []), spread)
            cond = cond & (F.coalesce(keyless, F.lit(0).cast("bigint")) == F.col(spread))
        df = df.join(picked, cond, "left").drop(k, d, spread)
    if failed is None:
        return df
    if not dataset:
        raise ValueError("failed datasets need the name of the dataset column")
    return df.join(failed.groupBy(dataset).agg(F.min("query_error").alias("query_error")), dataset, "left").select(*df.columns, "query_error")
