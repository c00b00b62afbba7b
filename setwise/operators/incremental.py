"""Snapshots, high-water-mark rollups, keyed changes and restore chains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from setwise.operators.aggregates import group_concat
from setwise.operators.ordered import ordered_rows


def _delta(now: Column, then: Column, same: Column) -> Column:
    """The difference, or NULL when the pair is not comparable or went down."""
    return F.when(same & (now - then >= 0), now - then)


def snapshot_delta(
    first: DataFrame, second: DataFrame, entity: Sequence[str], started: str, metrics: Sequence[str],
    larger_of: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Entities of the second snapshot with ``<metric>_delta`` since the first.

    NULL unless the entity is in both with the same start and the metric did
    not shrink. ``larger_of`` names deltas that take the larger of two metrics'
    differences.
    """
    larger_of = dict(larger_of or {})
    needed = list(dict.fromkeys([*metrics, *[m for pair in larger_of.values() for m in pair]]))
    then = first.select(*entity, F.col(started).alias("__started"), *[F.col(m).alias(f"__{m}") for m in needed])
    joined = second.join(then, list(entity), "left")
    same = F.col(started).eqNullSafe(F.col("__started")) & F.col("__started").isNotNull()
    delta = lambda m: _delta(F.col(m), F.col(f"__{m}"), same)
    return joined.select(
        *second.columns, *[delta(m).alias(f"{m}_delta") for m in metrics],
        *[F.greatest(*[delta(m) for m in pair]).alias(f"{new}_delta") for new, pair in larger_of.items()],
    )


def snapshot_series_delta(
    series: DataFrame, entity: Sequence[str], time: str, metrics: Sequence[str], started: str | None = None,
    tiebreak: Sequence[str] = (), before: Mapping[str, str] | None = None,
) -> DataFrame:
    """Differences between consecutive captures of each entity in a whole series.

    ``before`` names new columns with the value that a column had in the capture before.
    """
    watched = [*metrics, *([started] if started else [])]
    rows = ordered_rows(
        series, [F.col(time).asc(), *[F.col(c).asc() for c in tiebreak]], entity, number="capture_no",
        previous={f"__{c}": c for c in watched} | dict(before or {}))
    same = F.col("capture_no") > 1
    if started:
        same = same & F.col(started).eqNullSafe(F.col(f"__{started}"))
    return rows.select(
        *series.columns, "capture_no", *[_delta(F.col(m), F.col(f"__{m}"), same).alias(f"{m}_delta") for m in metrics], *(before or {}))


def rollup_since(
    events: DataFrame, mark, keys: Sequence[str], time: str, latest: str = "latest", earliest: str = "earliest", count: str = "n",
) -> DataFrame:
    """Grouped max/min/count of the events newer than ``mark``; of all when it is None.

    The mark is a plain value, so the filter reaches the file scan.
    """
    fresh = events if mark is None else events.where(F.col(time) > F.lit(mark))
    return fresh.groupBy(*keys).agg(
        F.max(time).alias(latest), F.min(time).alias(earliest), F.count(F.lit(1)).alias(count))


def rollup_unread(
    events: DataFrame, read: DataFrame | None, batch: str, keys: Sequence[str], time: str, latest: str = "latest",
    earliest: str = "earliest", count: str = "n",
) -> DataFrame:
    """The same of the events whose ``batch`` (a file or load number) is not among those ``read``.

    What has been read is remembered, not how far time had come: events that
    are late, or tie with the newest one, are counted with their own batch.
    """
    fresh = events if read is None else events.join(read.select(batch).distinct(), batch, "left_anti")
    return rollup_since(fresh, None, keys, time, latest, earliest, count)


def high_water_mark(store: DataFrame, latest: str = "latest"):
    """The newest time the store has seen; None when it is empty. One value reaches the driver."""
    return store.agg(F.max(latest)).first()[0]


def capacity_snapshot(
    files: DataFrame, entity: str, kind: str, kinds: Mapping[str, str], size: str, used: str,
    latest: DataFrame | None = None, per_unit: int = 128, also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Per entity: size and free space by kind (pages over ``per_unit``), and columns of its latest row.

    ``latest`` is another table by entity; what comes from the same rows is an aggregate in ``also``, in the same pass.
    """
    total = lambda c, k: F.sum(F.when(F.col(kind) == k, F.col(c)))
    out = files.groupBy(entity).agg(
        *[(total(size, k) / per_unit).cast("decimal(20,4)").alias(f"{label}_size") for label, k in kinds.items()],
        *[((total(size, k) - total(used, k)) / per_unit).cast("decimal(20,4)").alias(f"{label}_free")
          for label, k in kinds.items()],
        *[c.alias(name) for name, c in (also or {}).items()],
    )
    return out if latest is None else out.join(latest, entity, "left")


def upsert(target: DataFrame, changes: DataFrame, key: str, empty=None, order: str | None = None) -> DataFrame:
    """Apply a change set: rows whose key is empty or NULL are inserted, others update existing rows.

    A change for a key that does not exist changes nothing. Of several changes
    for one key the last by ``order`` holds; without it they are an error when
    the result is read. ``empty`` is 0 for numbers and '' for texts. New
    integer keys follow the largest present one in the order of the change
    set's columns; text keys are taken as given.
    """
    type_ = target.schema[key].dataType
    text = type_.typeName() in ("string", "varchar", "char")
    is_new = F.col(key).isNull() | (F.col(key) == F.lit(("" if text else 0) if empty is None else empty))
    columns = target.columns
    wanted = changes.where(~is_new).join(target.select(key), key, "left_semi")
    row = F.struct(*columns)
    if order:
        picked = F.max_by(row, F.col(order))
    else:
        repeated = F.raise_error(F.concat(F.lit(f"several changes for {key} "), F.col(key).cast("string")))
        picked = F.when(F.count(F.lit(1)) == 1, F.first(row)).otherwise(repeated)
    updates = wanted.groupBy(key).agg(picked.alias("__row")).select(*[F.col("__row")[c].alias(c) for c in columns])
    kept = target.join(changes.where(~is_new).select(key), key, "left_anti")
    fresh = changes.where(is_new).select(*columns)
    if text:
        inserts = fresh
    else:
        others = [F.col(c).asc() for c in columns if c != key]
        numbered = ordered_rows(fresh.drop(key), others, number="__new")
        base = target.agg(F.coalesce(F.max(key), F.lit(0))).scalar()
        inserts = numbered.withColumn(key, (base + F.col("__new")).cast(type_)).select(*columns)
    return kept.select(*columns).unionByName(updates).unionByName(inserts)


def get_by_key(target: DataFrame, key: str, value) -> DataFrame:
    return target.where(F.col(key) == F.lit(value))


def delete_keys(target: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return target.join(gone.select(key), key, "left_anti")


def delete_from(target: DataFrame, matched: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows not matched by the other table."""
    return target.join(matched.select(*on), list(on), "left_anti")


def update_from(target: DataFrame, source: DataFrame, key: str, columns: Mapping[str, str]) -> DataFrame:
    """Set target columns from a joined table where it has a value; others stay."""
    new = source.select(key, *[F.col(s).alias(f"__new_{t}") for t, s in columns.items()])
    joined = target.join(new, key, "left")
    set_ = {t: F.coalesce(F.col(f"__new_{t}"), F.col(t)) for t in columns}
    return joined.select(*[set_.get(c, F.col(c)).alias(c) for c in target.columns])


def restore_chain(
    backups: DataFrame, entity: str, kind: str, started: str, lsn: str, set_id: str, copy_only: Column,
    full="D", diff="I", log="L", media: DataFrame | None = None, media_set: str = "media_set_id", device: str = "physical_device_name",
) -> DataFrame:
    """Per entity what to restore: newest full, newest later differential, then every log from there on.

    All entities at once: two reductions per entity, joined back to the rows.
    Adds ``step`` 1 (full), 2 (differential), 3 (log). With ``media`` (media
    set and device, joined by ``media_set``) also ``devices``: the set's device
    names in order, as one text; NULL for a set without any.
    """
    rows = backups.withColumn("__copy", copy_only)
    newest = lambda cond: F.max_by(
        F.struct(F.col(started), F.col(set_id), F.col(lsn)), F.when(cond, F.struct(F.col(started), F.col(set_id))))
    is_full = (F.col(kind) == full) & ~F.col("__copy")
    fulls = rows.groupBy(entity).agg(newest(is_full).alias("__full"))
    is_diff = ~F.col("__copy") & (F.col(started) > F.col("__full")[started])
    diffs = rows.where(F.col(kind) == diff).join(fulls, entity).groupBy(entity).agg(newest(is_diff).alias("__diff"))
    bases = fulls.join(diffs, entity, "left")
    from_lsn = F.coalesce(F.col("__diff")[lsn], F.col("__full")[lsn], F.lit(0))
    joined = rows.join(bases, entity)
    step = (
        F.when(F.col(set_id) == F.col("__full")[set_id], 1)
        .when(F.col(set_id) == F.col("__diff")[set_id], 2)
        .when((F.col(kind) == log) & (F.col(lsn) >= from_lsn), 3)
    )
    chain = joined.withColumn("step", step).where("step is not null").select(*backups.columns, "step")
    if media is None:
        return chain
    return chain.join(group_concat(media, [media_set], device, ", ", distinct=True, name="devices"), media_set, "left")
