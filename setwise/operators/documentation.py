"""Facts about tables and columns, taken from the data."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, StructField

from setwise.operators.discovery import unique_columns

_INTEGERS = ("byte", "short", "integer", "long")
_NUMBERS = (*_INTEGERS, "float", "double", "decimal")
_TIMES = ("date", "timestamp", "timestamp_ntz")


def _kind(t: DataType) -> str:
    name = t.typeName()
    return "number" if name in _NUMBERS else "time" if name in _TIMES else "text" if name == "string" else "other"


def _comparable(f: StructField) -> tuple[str, str]:
    """A value whose equality is the column's, in one of three types that many columns share.

    Texts, short or long, are compared by digest: what is shuffled does not
    grow with the texts.
    """
    t, c = f.dataType.typeName(), f"`{f.name}`"
    if t in _INTEGERS:
        return "bigint", f"cast({c} as bigint)"
    if t in ("float", "double"):
        return "double", f"cast({c} as double)"
    if t in ("timestamp", "timestamp_ntz"):
        return "bigint", f"unix_micros(cast({c} as timestamp))"
    return "binary", f"unhex(sha2({f'to_json({c})' if _kind(f.dataType) == 'other' else f'cast({c} as string)'}, 256))"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "\\'") + "'"


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.union, parts)


def _dictionary(f: StructField) -> list[str]:
    """Type, nullable, precision, scale, comment and default of a column, as SQL."""
    t = f.dataType
    precision, scale = (t.precision, t.scale) if isinstance(t, DecimalType) else (getattr(t, "length", None), None)
    said = [(f.metadata or {}).get(k) for k in ("comment", "CURRENT_DEFAULT")]
    return [
        _quoted(t.simpleString()), str(f.nullable).lower(), *[f"cast({'null' if x is None else x} as int)" for x in (precision, scale)],
        *["cast(null as string)" if x is None else _quoted(x) for x in said]]


def column_profile(df: DataFrame, table: str, distinct: str = "exact") -> DataFrame:
    """One row per column: position, type, rows, nulls, distinct, extremes, longest text.

    One scan with one-row partial results. ``distinct='approx'`` stays in that
    scan; ``'exact'`` adds a second one, for a count over (column, value) pairs
    merged before the shuffle, so a frequent value costs one row per task.
    Length, precision and scale follow the type; comment and default are what
    the table's metadata says.
    """
    if distinct not in ("exact", "approx"):
        raise ValueError(f"distinct must be 'exact' or 'approx', not {distinct!r}")
    aggs, rows = ["count(1) as n"], []
    for i, f in enumerate(df.schema.fields):
        kind, c = _kind(f.dataType), f"`{f.name}`"
        aggs.append(f"count({c}) as c{i}")
        if kind != "other":
            aggs += [f"min({c}) as lo{i}", f"max({c}) as hi{i}"]
        if kind == "text":
            aggs.append(f"max(length({c})) as len{i}")
        if distinct == "approx":
            aggs.append(f"approx_count_distinct({_comparable(f)[1]}) as d{i}")
        number = [f"cast({x}{i} as double)" if kind == "number" else "cast(null as double)" for x in ("lo", "hi")]
        text = [{"text": f"{x}{i}", "time": f"date_format({x}{i}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"}.get(
            kind, "cast(null as string)") for x in ("lo", "hi")]
        rows.append(", ".join([
            str(i + 1), _quoted(f.name), *_dictionary(f), "n", f"n - c{i}",
            f"d{i}" if distinct == "approx" else "cast(null as bigint)", *number, *text,
            f"cast(len{i} as bigint)" if kind == "text" else "cast(null as bigint)"]))
    profile = df.selectExpr(*aggs).selectExpr(
        f"{_quoted(table)} as table_name",
        f"stack({len(rows)}, {', '.join(rows)}) as (ordinal, column_name, type, nullable, type_precision, type_scale, "
        "comment, default_value, rows, nulls, distinct, "
        "min_number, max_number, min_text, max_text, max_length)")
    if distinct == "approx":
        return profile
    counts = distinct_counts(df).withColumnRenamed("distinct", "__d")
    return profile.join(counts, "column_name", "left").selectExpr(
        *[c if c != "distinct" else "coalesce(__d, 0) as distinct" for c in profile.columns])


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact number of different non-NULL values per column, in one pass over the table.

    Every value stands in the column of its type class beside the name of its
    column; duplicates are merged before the shuffle.
    """
    classes = ("bigint", "double", "binary")
    rows = []
    for f in df.schema.fields:
        if columns is None or f.name in columns:
            type_, value = _comparable(f)
            rows.append(", ".join([_quoted(f.name), *[value if c == type_ else f"cast(null as {c})" for c in classes]]))
    values = df.selectExpr(f"stack({len(rows)}, {', '.join(rows)}) as (column_name, v1, v2, v3)")
    return values.where("v1 is not null or v2 is not null or v3 is not null").distinct().groupBy("column_name").agg(
        F.count(F.lit(1)).alias("distinct"))


def large_columns(df: DataFrame, table: str, threshold: int = 8000) -> DataFrame:
    """Columns holding a value of more than ``threshold`` bytes: texts (XML among them) and binary."""
    wide = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary", "varchar", "char")]
    if not wide:
        return df.sparkSession.createDataFrame([], "table_name string, column_name string, max_bytes bigint")
    one = df.selectExpr(*[f"cast(max(octet_length(`{c}`)) as bigint) as b{i}" for i, c in enumerate(wide)])
    rows = ", ".join(f"{_quoted(c)}, b{i}" for i, c in enumerate(wide))
    return one.selectExpr(
        f"{_quoted(table)} as table_name", f"stack({len(wide)}, {rows}) as (column_name, max_bytes)"
    ).where(F.col("max_bytes") > threshold)


def keyless_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Tables in which no single column identifies a row. A column is ruled out by a NULL, by two equal values, or by its exact count."""
    names = [name for name, columns in unique_columns(tables).items() if not columns and tables[name].columns]
    return next(iter(tables.values())).sparkSession.createDataFrame([(n,) for n in names], "table_name string")


def staleness(
    then: DataFrame, now: DataFrame, key: str, columns: Sequence[str], group: str, updated: str | None = None,
) -> DataFrame:
    """Per group: rows now, rows known then, share known, rows new or changed since; most modified first."""
    old = then.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__o_{c}") for c in columns])
    changed = F.col("__k").isNull()
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"__o_{c}"))
    joined = now.join(old, F.col(key) == F.col("__k"), "left")
    aggs = [F.count(F.lit(1)).alias("rows"), F.count("__k").alias("rows_known"),
            F.count_if(changed).alias("modifications")]
    if updated:
        aggs.append(F.max(updated).alias("last_updated"))
    share = (F.col("rows_known") * F.lit(100).cast("decimal(5,1)") / F.nullif(F.col("rows"), F.lit(0))).cast("decimal(5,2)")
    return joined.groupBy(group).agg(*aggs).withColumn("known_percent", share).orderBy(
        F.col("modifications").desc(), *([F.col("last_updated").asc()] if updated else []), group)


def key_suffix(column: str) -> str:
    return column.split("_", 1)[-1]


def key_entity(column: str, suffixes: Sequence[str]) -> str:
    """What a key column names: ``o_custkey`` and ``cust_id`` are both ``cust``; empty if it is no key."""
    for suffix in suffixes:
        if column.endswith(suffix) and column != suffix:
            stem = column[: -len(suffix)].rstrip("_")
            return stem.split("_", 1)[-1]
    return ""


def fk_candidates(tables: Mapping[str, DataFrame], suffixes: Sequence[str] = ("key", "id")) -> list[tuple[str, str, str, str]]:
    """(child, column, parent, column) pairs that name the same thing in the same type, from metadata.

    A column can be a parent if its table's name starts with what it names.
    """
    cols = [(t, f.name, f.dataType, e) for t, df in tables.items() for f in df.schema.fields if (e := key_entity(f.name, suffixes))]
    return [
        (ct, cc, pt, pc) for ct, cc, ctype, ce in cols for pt, pc, ptype, pe in cols
        if (ct, cc) != (pt, pc) and ctype == ptype and ce.endswith(pe) and pt.startswith(pe)
    ]


def fk_edges(tables: Mapping[str, DataFrame], candidates: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Child to parent edges with the number of child values that have no parent.

    Child values are made distinct first, so a frequent key is looked up once.
    """
    def tested(child: str, child_col: str, parent: str, parent_col: str) -> DataFrame:
        values = tables[child].selectExpr(f"`{child_col}` as v").where("v is not null").distinct()
        missing = values.join(tables[parent].selectExpr(f"`{parent_col}` as v"), "v", "left_anti")
        return missing.agg(F.count("v").alias("missing_values")).selectExpr(
            f"{_quoted(child)} as child", f"{_quoted(child_col)} as child_column", f"{_quoted(parent)} as parent",
            f"{_quoted(parent_col)} as parent_column", "missing_values", "missing_values = 0 as is_edge")

    return _union(tested(*c) for c in candidates)


# Bytes of a value by type.
_WIDTHS = {"byte": 1, "short": 2, "integer": 4, "long": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8,
           "timestamp_ntz": 8, "boolean": 1}


def data_bytes(df: DataFrame) -> str:
    """SQL expression for the bytes of a row's values: fixed widths, texts by length."""
    def size(f: StructField) -> str:
        c, kind = f"`{f.name}`", f.dataType.typeName()
        if isinstance(f.dataType, ArrayType):
            return f"coalesce(size({c}) * {_WIDTHS.get(f.dataType.elementType.typeName(), 8)}, 0)"
        if kind in ("string", "binary"):
            return f"coalesce(octet_length({c}), 0)"
        return f"if({c} is null, 0, {_WIDTHS.get(kind, 8)})"

    return "cast(" + " + ".join(size(f) for f in df.schema.fields) + " as bigint)"


def space_report(sizes: DataFrame, table: str = "table_name", rows: str = "rows", size: str = "bytes") -> DataFrame:
    """Rows, bytes, MB, GB and average bytes per row (NULL without rows), largest first."""
    b = F.col(size).cast("decimal(25,0)")
    per_row = F.round(b / F.nullif(F.col(rows), F.lit(0)).cast("decimal(25,0)"), 5)
    return sizes.select(
        table, rows, size, F.round(b / F.lit(1024 * 1024), 4).alias("mb"),
        F.round(b / F.lit(1024 * 1024 * 1024), 4).alias("gb"), per_row.alias("avg_bytes_per_row"),
    ).orderBy(F.col("mb").desc(), table)


def table_space(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Size report from the data itself."""
    return space_report(_union(
        df.selectExpr(f"{_quoted(name)} as table_name", "count(1) as rows", f"sum({data_bytes(df)}) as bytes")
        for name, df in tables.items()))
