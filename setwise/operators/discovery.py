"""Keys and references found from the data: unique column combinations and inclusion dependencies.

Everything is exact. What reaches the driver is metadata: counts by column or
combination, and a bounded number of rows per table in which two equal ones
prove that a combination is no key. What these leave is looked for repeats among
the values of one slice of hashes, and only what has none there is counted whole.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField

WITNESSES = 1000  # rows per table in which equal ones are looked for
SLICE = 64  # one in so many values is looked at for repeats before all are counted; a power of two
PASS = 32  # combinations looked at in one reading of a table
_INTEGERS = ("byte", "short", "integer", "long")
_REALS = ("float", "double")
_TIMES = ("date", "timestamp", "timestamp_ntz")


def _fixed(f: StructField) -> str:
    """A value's equality in a fixed number of bytes: integers and times in eight, all else by digest."""
    t, c = f.dataType.typeName(), f"`{f.name}`"
    if t in _INTEGERS:
        return f"unhex(lpad(hex(cast({c} as bigint)), 16, '0'))"
    if t in _TIMES:
        return f"unhex(lpad(hex(unix_micros(cast({c} as timestamp))), 16, '0'))"
    text = f"cast(cast({c} as double) + 0.0D as string)" if t in _REALS else f"cast({c} as string)" if t in ("string", "decimal", "boolean", "binary") else f"to_json({c})"
    return f"unhex(sha2({text}, 256))"


def _hashed(f: StructField, salt: int) -> str:
    """A hash by which values are dealt to slices, another one for each column."""
    c = f"`{f.name}`"
    return f"xxhash64({salt}, {c if f.dataType.typeName() in (*_INTEGERS, *_REALS, *_TIMES, 'string', 'decimal', 'boolean', 'binary') else f'to_json({c})'})"


def _class(f: StructField) -> str:
    """Columns of one class may hold the same values."""
    t = f.dataType.typeName()
    return "integer" if t in _INTEGERS else "real" if t in _REALS else t


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _union(parts) -> DataFrame:
    return functools.reduce(DataFrame.union, parts)


@dataclass
class _Table:
    df: DataFrame
    fields: list[StructField]
    rows: int = 0
    full: list[int] = field(default_factory=list)  # columns without a NULL
    seen: list[tuple] = field(default_factory=list)  # a few rows of fixed values

    def repeated(self, combination: Sequence[int]) -> bool:
        """Whether two of the rows at hand are equal in these columns."""
        return len({tuple(r[i] for i in combination) for r in self.seen}) < len(self.seen)


def _examined(tables: Mapping[str, DataFrame], witnesses: int) -> dict[str, _Table]:
    """Rows, columns without a NULL, and some rows of each table; one job counts them all."""
    held = {name: _Table(df, df.schema.fields) for name, df in tables.items()}
    counts = []
    for name, t in held.items():
        one = t.df.selectExpr("count(1) as n", *[f"count(`{f.name}`) as c{i}" for i, f in enumerate(t.fields)])
        counts.append(one.selectExpr(f"{_quoted(name)} as t", "n", f"array({', '.join(f'c{i}' for i in range(len(t.fields)))}) as c"))
    for r in _union(counts).collect():
        held[r.t].rows, held[r.t].full = r.n, [i for i, c in enumerate(r.c) if c == r.n]
    for t in held.values():
        rows = t.df.selectExpr(*[f"{_fixed(f)} as h{i}" for i, f in enumerate(t.fields)]).take(witnesses)
        t.seen = [tuple(None if x is None else bytes(x) for x in r) for r in rows]
    return held


def _distinct(held: Mapping[str, _Table], wanted: Mapping[str, Sequence[tuple[int, ...]]]) -> dict[tuple[str, tuple[int, ...]], int]:
    """Exact number of different rows in each wanted combination, all of them in one pass and one shuffle."""
    parts, places = [], []
    for name, combinations in wanted.items():
        if not combinations:
            continue
        t = held[name]
        used = sorted({i for c in combinations for i in c})
        values = t.df.selectExpr(*[f"{_fixed(t.fields[i])} as h{i}" for i in used])
        keys = []
        for c in combinations:
            keys.append(f"named_struct('p', {len(places)}, 'k', concat({', '.join(f'h{i}' for i in c)}))")
            places.append((name, c))
        parts.append(values.selectExpr(f"inline(array({', '.join(keys)}))"))
    if not parts:
        return {}
    counted = _union(parts).distinct().groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()
    found = dict.fromkeys(places, 0)
    return found | {places[r.p]: r.n for r in counted}


def _repeats(held: Mapping[str, _Table], wanted: Mapping[str, Sequence[tuple[int, ...]]]) -> set[tuple[str, tuple[int, ...]]]:
    """Wanted combinations that two rows are equal in, looked for in a slice of their values; such are no keys, the others may be."""
    parts, places = [], []
    for name, combinations in wanted.items():
        t = held[name]
        for some in (combinations[i : i + PASS] for i in range(0, len(combinations), PASS)):
            used = sorted({i for c in some for i in c})
            values = t.df.selectExpr(*[f"`{t.fields[i].name}` as v{i}" for i in used], *[f"{_hashed(t.fields[i], i)} as x{i}" for i in used])
            at = range(len(places), len(places) + len(some))
            taken = [f"if((({' ^ '.join(f'x{i}' for i in c)}) & {SLICE - 1}L) = 0L, {p}, -1)" for p, c in zip(at, some)]
            # Values are only written out for the rows of a slice.
            key = [f"if(p in ({', '.join(str(p) for p, c in zip(at, some) if i in c)}), {_fixed(StructField(f'v{i}', t.fields[i].dataType))}, x'')" for i in used]
            sliced = values.selectExpr(*[f"v{i}" for i in used], f"explode(array_remove(array({', '.join(taken)}), -1)) as p")
            parts.append(sliced.selectExpr("p", f"concat({', '.join(key)}) as k"))
            places += [(name, c) for c in some]
    if not parts:
        return set()
    equal = _union(parts).groupBy("p", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return {places[r.p] for r in equal.select("p").distinct().collect()}


def _keys(held: Mapping[str, _Table], wanted: Mapping[str, Sequence[tuple[int, ...]]]) -> dict[str, list[tuple[int, ...]]]:
    """Of the wanted combinations, columns without a NULL, those that no two rows are equal in."""
    left = {name: [c for c in combinations if not held[name].repeated(c)] for name, combinations in wanted.items()}
    repeated = _repeats(held, left)
    left = {name: [c for c in combinations if (name, c) not in repeated] for name, combinations in left.items()}
    counts = _distinct(held, left)
    return {name: [c for c in combinations if counts[name, c] == held[name].rows] for name, combinations in left.items()}


def unique_columns(tables: Mapping[str, DataFrame], witnesses: int = WITNESSES) -> dict[str, list[str]]:
    """Per table the columns that are never NULL and never repeat; in a table without rows all of them.

    A repeated value among the rows at hand or in a slice of the values rules a column out; what is left is counted exactly.
    """
    held = _examined(tables, witnesses)
    found = _keys(held, {name: [(i,) for i in t.full] for name, t in held.items()})
    return {name: [t.fields[i].name for i, in found[name]] for name, t in held.items()}


def candidate_key_sets(tables: Mapping[str, DataFrame], widest: int = 3, witnesses: int = WITNESSES) -> DataFrame:
    """(table_name, key_columns, n_columns): the minimal sets of at most ``widest`` columns that identify a row.

    Only columns without a NULL can be in a key. Combinations grow level by
    level from those that are no key. One is out without a scan when two of the
    rows at hand are equal in it, and without a count when two rows of a slice
    of its values are; the rest of a level, of all tables, is counted in one
    pass. In a table without rows every column is a key.
    """
    held = _examined(tables, witnesses)
    keys = _keys(held, {n: [(i,) for i in t.full] for n, t in held.items()})
    open_sets = {n: {(i,) for i in t.full} - set(keys[n]) for n, t in held.items()}
    for width in range(2, widest + 1):
        wanted: dict[str, list[tuple[int, ...]]] = {}
        for n in held:
            single = sorted({i for c in open_sets[n] for i in c})
            wanted[n] = [c for c in itertools.combinations(single, width) if all(s in open_sets[n] for s in itertools.combinations(c, width - 1))]
        found = _keys(held, wanted)
        for n in held:
            keys[n] += found[n]
            open_sets[n] = set(wanted[n]) - set(found[n])
    rows = [(n, ",".join(t.fields[i].name for i in c), len(c)) for n, t in held.items() for c in keys[n]]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, key_columns string, n_columns int")


def inclusions(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(child, child_column, parent, parent_column, child_values, parent_values, parent_is_key): columns whose values all stand in another.

    No names are used: a value knows the set of columns it stands in, the sets
    are counted, and a column is included where it shares as many values with
    the other as it has. Values are merged into those sets before the one
    shuffle of them, whatever the number of column pairs; what comes after has
    a row per set of columns. Columns of one class of type are compared, NULLs
    are no values, and a column without values is in none.
    """
    columns = [(name, f) for name, df in tables.items() for f in df.schema.fields]
    words = -(-len(columns) // 63)
    parts, rows_of, at = [], [], 0
    for name, df in tables.items():
        entries = []
        for f in df.schema.fields:
            bits = ", ".join(f"'m{w}', {1 << at % 63 if at // 63 == w else 0}L" for w in range(words))
            entries.append(f"named_struct('kind', {_quoted(_class(f))}, 'v', {_fixed(f)}, {bits})")
            at += 1
        parts.append(df.selectExpr(f"inline(array({', '.join(entries)}))").where("v is not null"))
        rows_of.append(df.selectExpr(f"{_quoted(name)} as parent", "count(1) as parent_rows"))
    masks = [f"m{w}" for w in range(words)]
    sets = _union(parts).groupBy("kind", "v").agg(*[F.bit_or(m).alias(m) for m in masks]).groupBy(*masks).agg(F.count(F.lit(1)).alias("n"))
    inside = F.concat(*[F.expr(
        f"filter(sequence({63 * w}, {min(63 * w + 62, len(columns) - 1)}), i -> (m{w} & shiftleft(1L, i - {63 * w})) <> 0)") for w in range(words)])
    members = sets.select("n", inside.alias("held"))
    shared = members.select("n", "held", F.explode("held").alias("a")).select("n", "a", F.explode("held").alias("b")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    own = shared.where("a = b").select(F.col("a").alias("c"), F.col("n").alias("values"))
    named = lambda i, part: F.element_at(F.array(*[F.lit(x) for x in part]), F.col(i) + 1)
    whole = shared.where("a <> b").join(own.select(F.col("c").alias("a"), F.col("values").alias("child_values")), "a").where("n = child_values")
    found = whole.join(own.select(F.col("c").alias("b"), F.col("values").alias("parent_values")), "b").select(
        named("a", [n for n, _ in columns]).alias("child"), named("a", [f.name for _, f in columns]).alias("child_column"),
        named("b", [n for n, _ in columns]).alias("parent"), named("b", [f.name for _, f in columns]).alias("parent_column"),
        "child_values", "parent_values")
    return found.join(_union(rows_of), "parent").select(
        "child", "child_column", "parent", "parent_column", "child_values", "parent_values", (F.col("parent_values") == F.col("parent_rows")).alias("parent_is_key"))
