"""Tables written to the shared folder in the middle of an operator: lineage is cut, executors may be lost."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from setwise import session


# Most rows of an Arrow batch: a batch is held whole, and texts may be long.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches of this session, and let Python workers import this package from where it stands."""
    if not 0 < int(spark.conf.get(*map(str, ARROW_ROWS))) <= ARROW_ROWS[1]:
        spark.conf.set(*ARROW_ROWS)
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside gets Arrow batches of the bounded rows, also in a session that has set no bound; its setting is put back."""
    name, most = ARROW_ROWS
    was = spark.conf.get(name, None)
    if was is None or not 0 < int(was) <= most:
        spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


class Scratch:
    """A folder of its own under ``spark.checkpoint.dir`` (or the warehouse where that is unset).

    Inside ``with setwise.session.Scratch(spark):`` it is removed at the end with all else that was stored.
    """

    def __init__(self, spark: SparkSession):
        self.spark = prepare(spark)
        self.folder = session.scratch_path(spark, "llm")
        self._held: list[tuple[DataFrame, str]] = []

    def table(self, df: DataFrame, name: str, **options) -> DataFrame:
        """``df`` written, with the writer's ``options``, and read back."""
        path = f"{self.folder}/{len(self._held)}-{name}"
        df.write.options(**options).parquet(path)
        self._held.append((self.spark.read.schema(df.schema).parquet(path), path))
        return self._held[-1][0]

    def drop(self, df: DataFrame) -> None:
        """Remove a table that ``table`` gave and that nothing reads any more."""
        for held, path in self._held:
            if held is df:
                session.remove(self.spark, path)


def scratch(spark: SparkSession) -> Scratch:
    return Scratch(spark)
