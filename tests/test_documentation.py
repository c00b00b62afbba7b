import pytest
from pyspark.sql import functions as F

from setwise.operators import documentation as doc
from setwise.session import scratch_path, scratch_root
from setwise.sources import sinks
from setwise.sources import tables as src


@pytest.fixture
def table(make):
    return make([(1, "a", [1]), (2, "it's", [1]), (3, None, None)], "id int, s string, xs array<int>")


def test_profile(table):
    got = {r.column_name: r for r in doc.column_profile(table, "t").collect()}
    assert (got["id"].rows, got["id"].distinct, got["id"].min_number, got["id"].max_number) == (3, 3, 1.0, 3.0)
    assert (got["s"].nulls, got["s"].distinct, got["s"].max_text, got["s"].max_length) == (1, 2, "it's", 4)
    assert (got["xs"].type, got["xs"].distinct, got["xs"].min_text) == ("array<int>", 1, None)
    approx = {r.column_name: r.distinct for r in doc.column_profile(table, "t", "approx").collect()}
    assert approx == {"id": 3, "s": 2, "xs": 1}
    with pytest.raises(ValueError):
        doc.column_profile(table, "t", "guess")


def test_long_texts_count_as_wholes(make):
    df = make([("x" * 5000 + "a",), ("x" * 5000 + "b",), ("x" * 5000 + "b",)], "s string")
    assert doc.distinct_counts(df).first().distinct == 2
    assert [tuple(r) for r in doc.large_columns(df, "t", 5000).collect()] == [("t", "s", 5001)]
    assert doc.large_columns(df, "t", 5001).isEmpty()


def test_keyless(make):
    tables = {"keyed": make([(1, 1), (2, 1)], "a int, b int"), "none": make([(1, 1), (1, 2), (2, 2)], "a int, b int"),
              "nulls": make([(1,), (None,)], "a int")}
    assert sorted(r[0] for r in doc.keyless_tables(tables).collect()) == ["none", "nulls"]


def test_fk(make):
    tables = {"orders": make([(1, 5), (2, 6), (3, None)], "o_orderkey int, o_custkey int"), "customer": make([(5,), (7,)], "c_custkey int")}
    found = doc.fk_candidates(tables)
    assert found == [("orders", "o_custkey", "customer", "c_custkey")]
    row = doc.fk_edges(tables, found).first()
    assert (row.missing_values, row.is_edge) == (1, False)


def test_staleness(make):
    then = make([(1, "a"), (2, "b")], "id int, v string")
    now = make([(1, "a", "g", 5), (2, "B", "g", 7), (3, "c", "g", 6), (4, "d", "h", 1)], "id int, v string, grp string, t int")
    got = [tuple(r) for r in doc.staleness(then, now, "id", ["v"], "grp", "t").collect()]
    assert [(g[0], g[1], g[2], g[3], g[4], float(g[5])) for g in got] == [("g", 3, 2, 2, 7, 66.67), ("h", 1, 0, 1, 1, 0.0)]


def test_space(make, spark):
    report = doc.table_space({"t": make([(1, "abc")] * 2, "i int, s string"), "e": make([], "i int")}).collect()
    assert [(r.table_name, r.rows, r.bytes) for r in report] == [("t", 2, 14), ("e", 0, None)]
    assert float(report[0].avg_bytes_per_row) == 7.0 and report[1].avg_bytes_per_row is None


def test_file_sizes(make, spark):
    path = scratch_path(spark, "files")
    sinks.append(make([(1,)], "i int"), path)
    sinks.append(make([(2,)], "i int"), path)
    files = src.file_bytes(spark, path + "/*.parquet")
    assert files.agg(F.count_if(F.col("length") > 0)).first()[0] >= 2


def test_datasets(make, spark):
    sets = [src.Dataset("Sales", lambda: make([(1,)], "a int"), facts={"state": "ONLINE"}),
            src.Dataset("Stock", lambda: make([(1,), (2,)], "b int"), facts={"state": "ONLINE"}),
            src.Dataset("master", lambda: make([(9,)], "a int"), system=True, facts={"state": "ONLINE"})]
    names = lambda **kw: [d.name for d in src.choose_datasets(sets, **kw)]
    assert names(names=" Sales , master ") == ["Sales", "master"]
    assert names(pattern="s*") == ["Sales", "Stock"] and names(system_only=True) == ["master"]
    assert names(user_only=True, state="OFFLINE") == []
    query = lambda df: df.agg(F.sum("a").alias("total"))
    out = src.for_each_dataset(spark, sets, query, keep_errors=True)
    got = {r.dataset: (r.total, r.query_error is not None) for r in out.collect()}
    assert got == {"Sales": (1, False), "Stock": (None, True), "master": (9, False)}
    with pytest.raises(Exception):
        src.for_each_dataset(spark, sets, query).collect()
    assert [r[0] for r in src.for_each_dataset(spark, sets, query, dry_run=True).collect()] == ["Sales", "Stock", "master"]
    with pytest.raises(ValueError):
        src.for_each_dataset(spark, [], query)


def test_datasets_that_fail_while_running(make, spark):
    bad_file = scratch_path(spark, "bad-file")
    make([("no parquet",)], "t string").write.text(bad_file)
    runs, target = [], scratch_path(spark, "apart")
    sets = [src.Dataset("good", lambda: runs.append("good") or make([("1",), ("2",)], "a string")), src.Dataset("a/b c", lambda: make([("5",)], "a string")),
            src.Dataset("cast", lambda: make([("3",), ("x",)], "a string")), src.Dataset("file", lambda: spark.read.schema("a string").parquet(bad_file)),
            src.Dataset("column", lambda: make([(1,)], "b int")), src.Dataset("empty", lambda: make([], "a string"))]
    query = lambda df: df.select(F.col("a").cast("int").alias("a"))
    got = src.run_each_dataset(spark, sets, query, target).collect()
    assert sorted((r.dataset, r.a) for r in got if r.query_error is None) == [("a/b c", 5), ("good", 1), ("good", 2)]
    errors = {r.dataset: r.query_error for r in got if r.query_error}
    assert set(errors) == {"cast", "file", "column"} and errors["cast"] == "CAST_INVALID_INPUT" and errors["column"].startswith("UNRESOLVED_COLUMN")
    # After a restart complete parts are read, failed ones run again.
    mended = [src.Dataset("cast", lambda: make([("3",)], "a string")) if d.name == "cast" else d for d in sets]
    again = src.run_each_dataset(spark, mended, query, target).collect()
    assert sorted((r.dataset, r.a) for r in again if r.query_error is None) == [("a/b c", 5), ("cast", 3), ("good", 1), ("good", 2)]
    assert runs == ["good"]
    with pytest.raises(ValueError):
        src.run_each_dataset(spark, [], query, target)


def test_sources_and_sinks(make, spark):
    path = scratch_path(spark, "events")
    make([(1, "x")], "id int, kind string").write.json(path)
    assert [tuple(r) for r in src.event_files(spark, path, "id int, kind string").collect()] == [(1, "x")]
    assert src.event_files(spark, path, "id int", modified_after="2999-01-01T00:00:00").isEmpty()
    ddl = sinks.save_as(make([(1, "x")], "id int, kind string"), "saved_rows", schema_only=True)
    assert ddl == "`id` int, `kind` string" and not spark.catalog.tableExists("saved_rows")
    sinks.save_as(make([(1, "x")], "id int, kind string"), "saved_rows")
    assert spark.table("saved_rows").count() == 1
    assert sinks.dated_path("/data/log/", "2024-01-31") == "/data/log_20240131"


def test_scratch_is_the_shared_folder(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
