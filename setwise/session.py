"""Session settings and the shared scratch folder, in one place."""

from __future__ import annotations

import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every operator relies on. Results depend on the first one
# (naive timestamps are read as UTC); the rest only shape the physical plan.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def builder(app: str = "setwise", master: str | None = None) -> SparkSession.Builder:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for key, value in RUNTIME_CONF.items():
        b = b.config(key, value)
    return b


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, else one under the warehouse, which executors share too."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root.rstrip("/") if root else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


class Scratch:
    """Everything that operators store between its beginning and its end: ``with Scratch(spark): report.collect()``.

    What is stored is removed at the end. Without one, intermediate tables stay
    until the caller clears the shared folder, since a lazy result may read them.
    """

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        Scratch._open.append(self)
        return self

    def __exit__(self, *_) -> None:
        Scratch._open.remove(self)
        for path in self.paths:
            remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def rename(spark: SparkSession, path: str, to: str) -> None:
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    if not source.getFileSystem(spark._jsc.hadoopConfiguration()).rename(source, target):
        raise OSError(f"{path} cannot be moved to {to}")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    if Scratch._open:
        Scratch._open[-1].paths.append(path)
    return path


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    and a lost executor costs a re-read instead of a re-run."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[stored] = path
    return stored


def release(df: DataFrame) -> None:
    """Remove what ``materialize`` stored; nothing may read it any more."""
    if path := _paths.pop(df, None):
        remove(df.sparkSession, path)
