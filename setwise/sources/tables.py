"""Sources: table folders, event files, literal rows, and one query over many datasets."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import quote

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from setwise.session import exists


class Tables:
    """Lazy access to ``<folder>/<name>.parquet``: ``Tables(spark, d).orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(self.path(name))
        return self._frames[name]

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"


def event_files(
    spark: SparkSession, path: str, schema: StructType | str, fmt: str = "json", modified_after: str | None = None,
) -> DataFrame:
    """Event files as rows with a declared schema; optionally only files newer than a time."""
    reader = spark.read.format(fmt).schema(schema)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return reader.load(path)


def event_stream(
    spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", glob: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """The same files as a stream: each file is read once, as it appears."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def jdbc_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None, **options: str) -> DataFrame:
    """A database table; with ``partition_column`` (and its bounds) read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    return (reader.option("partitionColumn", partition_column) if partition_column else reader).load()


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows written in the program, as part of the plan: its size is known, so a join broadcasts these and not the data."""
    fields = StructType.fromDDL(schema).fields
    if not rows:
        return spark.createDataFrame([], schema)
    table = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows])
    return spark.range(1).select(F.inline(table))


def file_bytes(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its size; contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


@dataclass(frozen=True)
class Dataset:
    """Something a query can run over: a reader plus the facts it is chosen by."""

    name: str
    read: Callable[[], DataFrame]
    system: bool = False
    facts: Mapping[str, object] = field(default_factory=dict)


def choose_datasets(
    datasets: Iterable[Dataset], names: Sequence[str] | str | None = None, pattern: str = "*",
    system_only: bool = False, user_only: bool = False, **facts: object,
) -> list[Dataset]:
    """Datasets by explicit list (or comma string), name pattern, kind and facts; all must hold."""
    if isinstance(names, str):
        names = [n.strip() for n in names.split(",")]
    return [
        d for d in datasets
        if (names is None or d.name in names)
        and fnmatch.fnmatch(d.name.lower(), pattern.lower())
        and (not system_only or d.system) and (not user_only or not d.system)
        and all(v is None or d.facts.get(k) == v for k, v in facts.items())
    ]


def for_each_dataset(
    spark: SparkSession, datasets: Sequence[Dataset], query: Callable[[DataFrame], DataFrame],
    name: str = "dataset", dry_run: bool = False, keep_errors: bool = False,
) -> DataFrame:
    """One query over every dataset, results stacked with the dataset's name.

    The loop only builds plans; the union runs as one job. ``dry_run`` lists
    the datasets instead. With ``keep_errors`` a dataset that cannot be read or
    resolved yields one row with ``query_error`` set instead of failing all.
    """
    if dry_run:
        return spark.createDataFrame([(d.name,) for d in datasets], f"`{name}` string")
    out: DataFrame | None = None
    for d in datasets:
        try:
            part = query(d.read()).select(F.lit(d.name).alias(name), "*")
            if keep_errors:
                part = part.withColumn("query_error", F.lit(None).cast("string"))
        except PySparkException as error:
            if not keep_errors:
                raise
            text = error.getCondition() or type(error).__name__
            part = spark.range(1).select(F.lit(d.name).alias(name), F.lit(text).alias("query_error"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no dataset chosen")
    return out


def _error_text(error: Exception) -> str:
    """The error's condition, or that of what caused it, or else the kind of error."""
    if isinstance(error, PySparkException):
        return error.getCondition() or type(error).__name__
    cause = error.java_exception
    while cause is not None:
        try:
            if condition := cause.getCondition():
                return condition
        except Py4JError:  # not one of Spark's
            pass
        cause = cause.getCause()
    return error.java_exception.getClass().getSimpleName()


def run_each_dataset(
    spark: SparkSession, datasets: Sequence[Dataset], query: Callable[[DataFrame], DataFrame], target: str,
    name: str = "dataset", at_once: int = 4,
) -> DataFrame:
    """One query over every dataset, each run and kept apart under ``target``; results stacked with the dataset's name.

    A dataset that fails while it is planned or while it runs (a value that
    cannot be cast, a file that cannot be read) gives one row with
    ``query_error``, and the others complete. A part counts once its outcome is
    stored after its rows: run again over the same ``target``, as after a
    restart, complete parts are read, failed and unfinished ones run again.
    ``at_once`` datasets run side by side.
    """
    if not datasets:
        raise ValueError("no dataset chosen")
    folders = {d.name: f"{target.rstrip('/')}/{quote(d.name, safe='')}" for d in datasets}

    def done(d: Dataset) -> bool:
        return exists(spark, f"{folders[d.name]}/complete/_SUCCESS")

    def run(d: Dataset) -> str | None:
        if done(d):
            return None
        try:
            query(d.read()).write.mode("overwrite").parquet(f"{folders[d.name]}/rows")
            spark.range(1).select(F.lit(d.name).alias(name)).write.mode("overwrite").parquet(f"{folders[d.name]}/complete")
        except (PySparkException, Py4JJavaError) as error:
            return _error_text(error)
        return None

    with ThreadPoolExecutor(at_once) as pool:
        errors = dict(zip(folders, pool.map(run, datasets), strict=True))
    out: DataFrame | None = None
    for d in datasets:
        if errors[d.name] is None:
            part = spark.read.parquet(f"{folders[d.name]}/rows").select(F.lit(d.name).alias(name), "*", F.lit(None).cast("string").alias("query_error"))
        else:
            part = spark.range(1).select(F.lit(d.name).alias(name), F.lit(errors[d.name]).alias("query_error"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
