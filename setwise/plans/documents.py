"""Table and column documentation queries."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame, functions as F

from setwise.operators import discovery, documentation as doc, profiles
from setwise.plans.aggregation import TABLE_NAMES
from setwise.plans.registry import number, query
from setwise.session import scratch_path
from setwise.sources.tables import Tables

# The columns of the given tables, for the SQL checks below.
COLUMNS = {
    "region": "r_regionkey:n r_name:s",
    "nation": "n_nationkey:n n_name:s n_regionkey:n",
    "customer": "c_custkey:n c_name:s c_nationkey:n c_acctbal:n c_mktsegment:s",
    "supplier": "s_suppkey:n s_name:s s_nationkey:n s_acctbal:n",
    "part": "p_partkey:n p_name:s p_brand:s p_type:s p_size:n p_retailprice:n",
    "orders": "o_orderkey:n o_custkey:n o_orderstatus:s o_totalprice:n o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:n l_partkey:n l_suppkey:n l_linenumber:n l_quantity:n l_extendedprice:n l_discount:n l_tax:n "
                "l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:n ts:t user_id:n event_type:s value:n props:s",
    "documents": "doc_id:n text:s lang:s source:s n_chars:n",
    "embeddings": "vec_id:n embedding:a label:n",
    "pages": "page_id:n url:s html:s",
    "benchmark": "item_id:n text:s",
    "labels": "doc_id:n quality:n toxic:n",
    "conversations": "conv_id:n turn:n role:s text:s",
}


def column_kinds(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in COLUMNS[table].split()]


def all_tables(t: Tables) -> dict[str, DataFrame]:
    return {n: t.read(n) for n in TABLE_NAMES}


# Types of the columns that are not of their kind's usual type.
_TYPES = {
    "int": "r_regionkey n_nationkey n_regionkey c_nationkey s_nationkey p_size l_linenumber label quality toxic".split(),
    "double": "c_acctbal s_acctbal p_retailprice o_totalprice l_quantity l_extendedprice l_discount l_tax value".split(),
}


def _sql_type(kind: str, column: str) -> str:
    usual = {"n": "bigint", "s": "string", "t": "timestamp_ntz", "a": "array<float>"}[kind]
    name = next((n for n, columns in _TYPES.items() if column in columns), usual)
    return (f"'{name}' AS type, true AS nullable, NULL::INT AS type_precision, NULL::INT AS type_scale, NULL::VARCHAR AS comment, "
            "NULL::VARCHAR AS default_value")


def _profile_sql(table: str) -> str:
    parts = []
    for i, (c, k) in enumerate(column_kinds(table)):
        text = {"s": c, "t": f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"}.get(k)
        parts.append(
            f"SELECT '{table}' AS table_name, {i + 1} AS ordinal, '{c}' AS column_name, {_sql_type(k, c)}, COUNT(*) AS rows, COUNT(*) - COUNT({c}) AS nulls, "
            f"COUNT(DISTINCT {c}) AS distinct_values, COALESCE({f'MIN({c})::DOUBLE' if k == 'n' else 'NULL'}, 0) AS min_number, "
            f"COALESCE({f'MAX({c})::DOUBLE' if k == 'n' else 'NULL'}, 0) AS max_number, COALESCE({f'MIN({text})' if text else 'NULL'}, '') AS min_text, "
            f"COALESCE({f'MAX({text})' if text else 'NULL'}, '') AS max_text, COALESCE({f'MAX(length({c}))' if k == 's' else 'NULL'}, 0) AS max_length FROM {table}")
    return " UNION ALL ".join(parts)


def _stack(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


@query("column_profile", sql=" UNION ALL ".join(_profile_sql(n) for n in TABLE_NAMES))
def column_profile(t: Tables):
    """Every column of every table with facts from its data."""
    out = _stack([doc.column_profile(df, n) for n, df in all_tables(t).items()])
    return out.select(
        "table_name", "ordinal", "column_name", "type", "nullable", "type_precision", "type_scale", "comment", "default_value", "rows", "nulls", F.col("distinct").alias("distinct_values"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("min_number", "max_number", "max_length")],
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("min_text", "max_text")])


@query("large_columns", sql=" UNION ALL ".join(
    f"SELECT '{n}' AS table_name, '{c}' AS column_name, MAX(strlen({c}))::BIGINT AS max_bytes FROM {n} HAVING MAX(strlen({c})) > 8000"
    for n in TABLE_NAMES for c, k in column_kinds(n) if k == "s"))
def large_columns(t: Tables):
    return _stack([doc.large_columns(df, n) for n, df in all_tables(t).items()])


@query("keyless_tables", sql=" UNION ALL ".join(
    f"SELECT '{n}' AS table_name FROM {n} HAVING NOT (" + " OR ".join(
        f"COUNT(DISTINCT {c}) = COUNT(*)" for c, _ in column_kinds(n)) + ")" for n in TABLE_NAMES))
def keyless_tables(t: Tables):
    return doc.keyless_tables(all_tables(t))


def _key_sets_sql() -> str:
    parts = []
    for n in TABLE_NAMES:
        usable = [c for c, _ in column_kinds(n)]
        unique = {c: f"(COUNT(DISTINCT {c}) = COUNT(*))" for c in usable}
        parts += [f"SELECT '{n}' AS table_name, '{c}' AS key_columns, 1 AS n_columns FROM {n} HAVING {unique[c]}" for c in usable]
        parts += [
            f"SELECT '{n}', '{a},{b}', 2 FROM {n} HAVING NOT {unique[a]} AND NOT {unique[b]} AND COUNT({a}) = COUNT(*) AND COUNT({b}) = COUNT(*) "
            f"AND COUNT(DISTINCT ({a}, {b})) = COUNT(*)" for a, b in itertools.combinations(usable, 2)]
    return " UNION ALL ".join(parts)


@query("candidate_key_sets", sql=_key_sets_sql())
def candidate_key_sets(t: Tables):
    """Every minimal key of one or two columns, of all tables."""
    return discovery.candidate_key_sets(all_tables(t), widest=2)


# The class of each kind of column, real where the type says so.
_CLASS = {"n": "integer", "s": "string", "t": "timestamp_ntz", "a": "array"}

@query("fk_edges_by_value", sql="WITH v AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT '{n}' AS t, '{c}' AS c, '{'real' if c in _TYPES['double'] else _CLASS[k]}' AS kind, {c}::VARCHAR AS v FROM {n} WHERE {c} IS NOT NULL"
    for n in TABLE_NAMES for c, k in column_kinds(n)) + "), r AS (" + " UNION ALL ".join(f"SELECT '{n}' AS t, COUNT(*) AS n FROM {n}" for n in TABLE_NAMES) + """),
o AS (SELECT t, c, COUNT(*) AS n FROM v GROUP BY ALL),
p AS (SELECT a.t AS child, a.c AS child_column, b.t AS parent, b.c AS parent_column, COUNT(*) AS n FROM v a JOIN v b USING (kind, v) WHERE (a.t, a.c) <> (b.t, b.c) GROUP BY ALL)
SELECT child, child_column, parent, parent_column, x.n AS child_values, y.n AS parent_values, y.n = r.n AS parent_is_key
FROM p JOIN o x ON x.t = child AND x.c = child_column AND x.n = p.n JOIN o y ON y.t = parent AND y.c = parent_column JOIN r ON r.t = parent""")
def fk_edges_by_value(t: Tables):
    """References of all columns to all columns, found from their values alone."""
    return discovery.inclusions(all_tables(t))


# The column by whose time each of these tables grows, and when its second and third batch begin.
_GROWS = {"orders": ("o_orderdate", "1995-01-01", "1997-01-01"), "events": ("ts", "2024-01-10", "2024-01-20")}


def profiled(t: Tables) -> DataFrame:
    """Profiles of two tables, stored in three batches each."""
    folder = scratch_path(t.spark, "profiles")
    for name, (time, second, third) in _GROWS.items():
        at = [F.lit(x).cast("timestamp_ntz") for x in (second, third)]
        c = F.col(time).cast("timestamp_ntz")
        for batch, part in enumerate((c < at[0], (c >= at[0]) & (c < at[1]), c >= at[1])):
            profiles.store_batch(t.read(name).where(part), name, batch, folder)
    return profiles.stored_batches(t.spark, folder)


@query("profile_merged", sql=" UNION ALL ".join(
    f"SELECT '{n}' AS table_name, '{c}' AS column_name, COUNT(*) AS rows, COUNT(*) - COUNT({c}) AS nulls, "
    f"{f'MIN({c})::DOUBLE' if k == 'n' else f'epoch_us(MIN({c}))::DOUBLE / 1e6' if k == 't' else 'NULL::DOUBLE'} AS low, "
    f"{f'MAX({c})::DOUBLE' if k == 'n' else f'epoch_us(MAX({c}))::DOUBLE / 1e6' if k == 't' else 'NULL::DOUBLE'} AS high, "
    f"{f'MIN({c})' if k == 's' else 'NULL::VARCHAR'} AS low_text, {f'MAX({c})' if k == 's' else 'NULL::VARCHAR'} AS high_text, "
    f"true AS distinct_within, {'NULL::BOOLEAN' if k == 's' else 'true'} AS median_within FROM {n}"
    for n in _GROWS for c, k in column_kinds(n)))
def profile_merged(t: Tables):
    """Profiles of three batches merged; estimates held against exact counts and ranks within their stated error."""
    merged = profiles.merged_profile(profiled(t))
    exact = _stack([doc.distinct_counts(t.read(n)).select(F.lit(n).alias("table_name"), "column_name", F.col("distinct").alias("exact")) for n in _GROWS])
    medians = {(r.table_name, r.column_name): r.quantile for r in merged.where("quantile IS NOT NULL").select("table_name", "column_name", "quantile").collect()}
    ranks = []
    for n in _GROWS:
        of = [(f, medians[n, f.name]) for f in t.read(n).schema.fields if (n, f.name) in medians]
        pairs = ", ".join(f"'{f.name}', avg(if({profiles._number(f)} < {m!r}D, 1, 0)), avg(if({profiles._number(f)} <= {m!r}D, 1, 0))" for f, m in of)
        ranks.append(t.read(n).selectExpr(f"stack({len(of)}, {pairs}) as (column_name, below, upto)").select(F.lit(n).alias("table_name"), "*"))
    error = profiles.RANK_ERROR * 2
    held = merged.join(exact, ["table_name", "column_name"], "left").join(_stack(ranks), ["table_name", "column_name"], "left")
    return held.select(
        "table_name", "column_name", "rows", "nulls", "low", "high", "low_text", "high_text",
        (F.abs(F.col("distinct") - F.col("exact")) <= 5 * profiles.DISTINCT_ERROR * F.col("exact")).alias("distinct_within"),
        ((F.col("below") - error <= 0.5) & (F.col("upto") + error >= 0.5)).alias("median_within"))


def _widened_sql(n: str) -> str:
    time, _, third = _GROWS[n]
    known = f"FILTER ({time} < TIMESTAMP '{third}')"
    moved = " + ".join(f"(MIN({c}) IS DISTINCT FROM MIN({c}) {known} OR MAX({c}) IS DISTINCT FROM MAX({c}) {known})::INT" for c, _ in column_kinds(n))
    return (f"SELECT '{n}' AS table_name, COUNT(*) AS rows, COUNT(*) {known} AS rows_known, ({moved})::BIGINT AS columns_widened, "
            f"ROUND(100.0 * COUNT(*) {known} / COUNT(*), 2) AS known_percent FROM {n}")


@query("staleness_profiled", sql=" UNION ALL ".join(_widened_sql(n) for n in _GROWS))
def staleness_profiled(t: Tables):
    """What two batches of three knew of each table, from the stored profiles alone."""
    return profiles.profile_staleness(profiled(t), 2).withColumn("known_percent", number("known_percent"))


@query("staleness", sql="""
WITH o AS (SELECT d.*, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT source, COUNT(*) AS rows, COUNT(quality) AS rows_known, COUNT(*) FILTER (quality IS NULL OR quality <> CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) AS modifications,
  ROUND(100.0 * COUNT(quality) / COUNT(*), 2) AS known_percent FROM o GROUP BY source""")
def staleness(t: Tables):
    """Labels as an older profile of the documents: what is unknown or has changed since, by source."""
    now = t.documents.select("doc_id", "source", F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("quality"))
    return doc.staleness(t.labels, now, "doc_id", ["quality"], "source").withColumn("known_percent", number("known_percent"))


_EDGES = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"),
]


@query("fk_edges", sql=" UNION ALL ".join(
    f"SELECT '{a}' AS child, '{b}' AS child_column, '{c}' AS parent, '{d}' AS parent_column, COUNT(DISTINCT {b}) AS missing_values, "
    f"COUNT(*) = 0 AS is_edge FROM {a} WHERE {b} IS NOT NULL AND {b} NOT IN (SELECT {d} FROM {c})" for a, b, c, d in _EDGES))
def fk_edges(t: Tables):
    """Candidate references found in the metadata, tested on the data."""
    tables = all_tables(t)
    return doc.fk_edges(tables, doc.fk_candidates(tables))


_WIDTH = {"region": "4", "nation": "8", "customer": "20", "supplier": "20", "part": "20", "orders": "32", "lineitem": "68",
          "events": "32", "documents": "16", "embeddings": "12 + 4 * len(embedding)", "pages": "8", "benchmark": "8", "labels": "16", "conversations": "16"}


@query("table_space", sql="WITH s AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, COUNT(*) AS rows, SUM({_WIDTH[n]}" + "".join(
        f" + strlen({c})" for c, k in column_kinds(n) if k == "s") + f")::BIGINT AS bytes FROM {n}" for n in TABLE_NAMES)
    + ") SELECT table_name, rows, bytes, ROUND(bytes / 1048576, 4) AS mb, ROUND(bytes / 1073741824, 4) AS gb, ROUND(bytes / rows, 5) AS avg_bytes_per_row FROM s")
def table_space(t: Tables):
    """Size report of every table, from the data."""
    out = doc.table_space(all_tables(t))
    return out.withColumns({c: number(c) for c in ("mb", "gb", "avg_bytes_per_row")})
