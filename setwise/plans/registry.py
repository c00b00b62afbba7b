"""Where queries and the SQL that checks them are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from setwise.functions.times import col
from setwise.session import configure
from setwise.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(configure(spark), folder))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def number(x: Column | str, name: str | None = None) -> Column:
    """Results leave as doubles, so that both engines' decimals compare."""
    c = col(x).cast("double")
    return c.alias(name) if name else c.alias(x) if isinstance(x, str) else c


def day_text(x: Column | str, name: str) -> Column:
    return F.date_format(col(x), "yyyy-MM-dd").alias(name)


def time_text(x: Column | str, name: str) -> Column:
    return F.date_format(col(x), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)
