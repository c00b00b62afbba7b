"""Every registered query against its SQL on the smallest tables."""

import pytest
from check import compare

import __spark_entry__ as entry
from setwise.plans.registry import ORACLES, QUERIES
from setwise.session import Scratch, scratch_root

FOLDER = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def stored(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {str(f.getPath()) for f in files.listStatus(path)} if files.exists(path) else set()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    before = stored(spark)
    with Scratch(spark):
        found = compare(spark, FOLDER, name)
    assert found.startswith("ok"), found
    assert stored(spark) == before  # a scope leaves nothing behind
