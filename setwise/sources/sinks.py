"""Sinks: append, replace by date, named destinations, dated archives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from setwise.session import exists, remove, rename


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace exactly the partitions ``df`` has rows for: running it twice changes nothing.

    The rebalance hint gathers a partition's rows into few files and splits
    those that are too large for one.
    """
    df.hint("rebalance", *partition_by).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def save_as(df: DataFrame, destination: str, schema_only: bool = False, mode: str = "append") -> str:
    """Append to a caller-named table; ``schema_only`` just returns its column definitions."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    if not schema_only:
        df.write.mode(mode).saveAsTable(destination)
    return ddl


def replace_and_archive(df: DataFrame, path: str, as_of: str) -> str:
    """Write a table anew and keep what stood there under its dated path, which is returned.

    The old version is moved, not copied; a version of the same date is replaced.
    """
    spark, old = df.sparkSession, dated_path(path, as_of)
    if exists(spark, path):
        remove(spark, old)
        rename(spark, path, old)
    df.write.parquet(path)
    return old


def dated_path(path: str, as_of: str) -> str:
    """Where a table's old version goes: its path with a date suffix."""
    return f"{path.rstrip('/')}_{as_of.replace('-', '')}"
