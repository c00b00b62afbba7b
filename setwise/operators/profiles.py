"""Column profiles that grow with their table: one small row per column and batch, merged on reading.

Counts and extremes merge exactly. Distinct values and quantiles are kept as
sketches, which merge to what one sketch over all batches would say: distinct
counts are off by DISTINCT_ERROR (one standard deviation), a quantile's rank by
RANK_ERROR of the rows (99 of 100 times). A batch is profiled in one scan and
replaced when it is profiled again; no batch is read a second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField

LOG_SLOTS = 14  # a distinct sketch has 2**14 slots
DISTINCT_ERROR = 1.04 / 2 ** (LOG_SLOTS / 2)
RANK_K, RANK_ERROR = 400, 0.007
_NUMBERS = ("byte", "short", "integer", "long", "float", "double", "decimal")
_TIMES = ("date", "timestamp", "timestamp_ntz")


def _number(f: StructField) -> str | None:
    """A column's values as doubles, times as seconds."""
    t, c = f.dataType.typeName(), f"`{f.name}`"
    if t in _NUMBERS:
        return f"cast({c} as double)"
    return f"unix_micros(cast({c} as timestamp)) / 1e6D" if t in _TIMES else None


def _hashed(f: StructField) -> str:
    t, c = f.dataType.typeName(), f"`{f.name}`"
    return f"cast({c} as string)" if t in ("string", "binary", "boolean", *_NUMBERS, *_TIMES) else f"to_json({c})"


def batch_profile(df: DataFrame, table: str) -> DataFrame:
    """(table_name, column_name, rows, nulls, low, high, low_text, high_text, values, quantiles): one row per column, from one scan."""
    aggs, rows = ["count(1) as n"], []
    for i, f in enumerate(df.schema.fields):
        number, text = _number(f), f.dataType.typeName() == "string"
        aggs += [f"count(`{f.name}`) as c{i}", f"hll_sketch_agg({_hashed(f)}, {LOG_SLOTS}) as v{i}"]
        if number:
            aggs += [f"min({number}) as lo{i}", f"max({number}) as hi{i}", f"kll_sketch_agg_double({number}, {RANK_K}) as q{i}"]
        if text:
            aggs += [f"min(`{f.name}`) as lo{i}", f"max(`{f.name}`) as hi{i}"]
        none = "cast(null as {})".format
        name = "'" + f.name.replace("\\", "\\\\").replace("'", "\\'") + "'"
        rows.append(", ".join([
            name, "n", f"n - c{i}", *([f"lo{i}", f"hi{i}"] if number else [none("double")] * 2),
            *([f"lo{i}", f"hi{i}"] if text else [none("string")] * 2), f"v{i}",
            f"if(c{i} > 0, q{i}, null)" if number else none("binary")]))
    return df.selectExpr(*aggs).selectExpr(
        f"stack({len(rows)}, {', '.join(rows)}) as (column_name, rows, nulls, low, high, low_text, high_text, values, quantiles)").select(
        F.lit(table).alias("table_name"), "*")


def store_batch(df: DataFrame, table: str, batch: int, folder: str) -> None:
    """Add the profile of a table's next batch, or replace that of the same number."""
    batch_profile(df, table).coalesce(1).write.mode("overwrite").parquet(f"{folder}/table={table}/batch={batch}")


def stored_batches(spark: SparkSession, folder: str) -> DataFrame:
    ddl = ("table_name string, column_name string, rows bigint, nulls bigint, low double, high double, low_text string, high_text string, "
           "values binary, quantiles binary, batch int")
    return spark.read.schema(ddl).option("basePath", folder).parquet(f"{folder}/table=*")


def merged_profile(batches: DataFrame, quantile: float = 0.5) -> DataFrame:
    """One row per column over all the given batches, with an estimate of its distinct values and of one quantile."""
    quantiles = F.call_function("kll_merge_agg_double", F.col("quantiles"))
    return batches.groupBy("table_name", "column_name").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("low_text").alias("low_text"), F.max("high_text").alias("high_text"),
        F.hll_sketch_estimate(F.hll_union_agg("values")).alias("distinct"), F.count("quantiles").alias("__held"), quantiles.alias("__q"),
    ).withColumn("quantile", F.when(F.col("__held") > 0, F.call_function("kll_sketch_get_quantile_double", F.col("__q"), F.lit(quantile)))).drop("__held", "__q")


def profile_staleness(batches: DataFrame, known: int) -> DataFrame:
    """Per table: rows now, rows when ``known`` batches were there, share known, and columns whose extremes have widened since.

    Only profiles are read, neither the old table nor the new one.
    """
    then = merged_profile(batches.where(F.col("batch") < known)).select(
        "table_name", "column_name", F.col("rows").alias("rows_then"), *[F.col(c).alias(f"then_{c}") for c in ("low", "high", "low_text", "high_text")])
    both = merged_profile(batches).join(then, ["table_name", "column_name"], "left")
    moved = F.lit(False)
    for c in ("low", "high", "low_text", "high_text"):
        moved = moved | ~F.col(c).eqNullSafe(F.col(f"then_{c}"))
    known_rows = F.coalesce(F.max("rows_then"), F.lit(0))
    return both.groupBy("table_name").agg(
        F.max("rows").alias("rows"), known_rows.alias("rows_known"), F.count_if(moved).alias("columns_widened")).withColumn(
        "known_percent", F.round(F.col("rows_known") * 100.0 / F.nullif(F.col("rows"), F.lit(0)), 2))
