import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from setwise.operators import joins as jn
from setwise.plans import joining  # noqa: F401  (it registers)
from setwise.plans.registry import QUERIES

T0 = datetime(2024, 1, 1)
LOOPS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_null_diff_example(make, rows):
    left = make([(1, "A"), (2, "B"), (3, "C")], "id int, c string")
    right = make([(1, "A"), (2, "R"), (3, None)], "id int, c string")
    ids = lambda aware: [r[0] for r in rows(jn.null_safe_diff(left, right, ["id"], ["c"], aware).select("id"))]
    assert ids(False) == [2]
    assert ids(True) == [2, 3]


def test_active_at_ends_and_state(make, rows):
    df = make([(1, at(0), at(60), 1), (2, at(60), at(90), 1), (3, at(61), at(90), 1), (4, at(0), at(90), 4), (5, at(0), at(90), None)],
              "id int, s timestamp_ntz, e timestamp_ntz, st int")
    out = jn.active_at(df, F.col("s"), F.col("e"), F.lit(at(60)).cast("timestamp_ntz"), "st")
    assert [r[0] for r in rows(out.select("id"))] == [1, 2]


def test_active_at_many_brute_force(make, rows):
    rnd = random.Random(1)
    spans = [(i, s := rnd.randrange(100_000), s + rnd.choice([0, 1, 59, 3600, 90_000, 5_000_000])) for i in range(150)] + [(999, 50, 40)]
    moments = [0, 50, 3600, 7200, 99_999, 4_000_000]
    intervals = make([(i, at(s), at(e)) for i, s, e in spans], "id int, s timestamp_ntz, e timestamp_ntz")
    probes = make([(at(m),) for m in moments], "p timestamp_ntz")
    out = jn.active_at_many(intervals, "s", "e", probes, "p", 60_000_000)
    want = sorted((i, at(m)) for i, s, e in spans for m in moments if s <= m <= e)
    assert rows(out.select("id", "p")) == want


@pytest.mark.parametrize("inclusive", [True, False])
def test_near_join_brute_force(make, rows, inclusive):
    rnd = random.Random(2)
    left = [(i, rnd.choice([1, 1, 2]), rnd.randrange(4000)) for i in range(120)]
    right = [(rnd.choice([1, 1, 2, 3]), rnd.randrange(4000), rnd.choice("ab")) for _ in range(60)]
    ok = lambda d: d <= 50 if inclusive else d < 50
    l = make([(i, k, at(s)) for i, k, s in left], "id int, k int, t timestamp_ntz")
    r = make([(k, at(s), x) for k, s, x in right], "k int, t timestamp_ntz, x string")
    semi = {i for i, k, s in left if any(k == k2 and ok(abs(s - s2)) for k2, s2, _ in right)}
    assert {x.id for x in jn.near_join(l, r, ["k"], "t", "t", 50_000_000, inclusive=inclusive).collect()} == semi
    pairs = {(i, x) for (i, k, s), (k2, s2, x) in itertools.product(left, right) if k == k2 and ok(abs(s - s2))}
    got = jn.near_join(l, r, ["k"], "t", "t", 50_000_000, ["x"], inclusive).select("id", "x").collect()
    assert len(got) == len(pairs) and {tuple(g) for g in got} == pairs


def test_or_join_pairs_once(make, rows):
    left = make([(1, 10, 20), (2, 10, 10), (3, None, 20), (4, 99, None)], "id int, a int, b int")
    right = make([(10, "x"), (20, "y"), (20, "z")], "k int, v string")
    assert rows(jn.or_join(left, right, ["a", "b"], "k").select("id", "v")) == [(1, "x"), (1, "y"), (1, "z"), (2, "x"), (3, "y"), (3, "z")]
    kept = rows(jn.or_join(left, right, ["a", "b"], "k", "left").select("id", "v"))
    assert kept == [(1, "x"), (1, "y"), (1, "z"), (2, "x"), (3, "y"), (3, "z"), (4, None)]


def test_no_nested_loops(make, plan_of):
    t = make([(1, at(0), at(1))], "k int, s timestamp_ntz, e timestamp_ntz")
    p = make([(at(0),)], "p timestamp_ntz")
    plans = [
        jn.active_at_many(t, "s", "e", p, "p"), jn.near_join(t, t.toDF("k", "s2", "e2"), ["k"], "s", "s2", 1000),
        jn.or_join(t.withColumn("k2", F.col("k") + 1), t.select(F.col("k").alias("rk")), ["k", "k2"], "rk"),
    ]
    for plan in map(plan_of, plans):
        assert not any(loop in plan for loop in LOOPS)
        assert "Python" not in plan


def test_effective_grants(make, rows):
    grants = make([("u", "read"), ("r", "write")], "p string, perm string")
    members = make([("u", "r"), ("v", "r"), ("w", "empty")], "p string, role string")
    out = jn.effective_grants(grants, members, "p", "role", ["perm"])
    assert rows(out) == [("u", "read", None), ("u", "write", "r"), ("v", "write", "r"), ("w", None, "empty")]


def test_except_then_in_keeps_duplicate_rows(make, rows):
    df = make([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert rows(jn.except_then_in(df, df, make([(2,)], "k int"), "k")) == [(1, "a"), (1, "b")]


def test_above_average_and_first_non_null(make, rows):
    df = make([(1, 1), (2, 5), (3, 9)], "k int, v int")
    assert rows(jn.above_average(df, "v")) == [(3, 9, 5.0)]
    a, b = make([(1, None), (2, "a2")], "k int, x string"), make([(1, "b1"), (2, "b2")], "k int, y string")
    assert rows(jn.first_non_null(df.select("k"), [(a, "x"), (b, "y")], "k", "z", "-")) == [(1, "b1"), (2, "a2"), (3, "-")]


def test_chained_lookup_by_dataset(make, rows):
    locks = make([("d1", 7, None), ("d2", 7, None), ("d1", None, 3)], "db string, hobt int, obj int")
    hobts = make([("d1", 7, 3), ("d2", 7, 4)], "db string, hobt_id int, hobt_obj int")
    objects = make([("d1", 3, "t3"), ("d2", 4, "t4")], "db string, object_id int, name string")
    out = jn.chained_lookup(locks, [(hobts, "hobt_id", "hobt", ["hobt_obj"]), (objects, "object_id", "coalesce(obj, hobt_obj)", ["name"])], "db")
    assert rows(out.select("db", "name")) == [("d1", "t3"), ("d1", "t3"), ("d2", "t4")]


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_chained_lookup_deals_many_rows_to_many_tasks(spark, make, rows, monkeypatch, tmp_path, broadcast):
    """Tasks hold about TASK_ROWS rows however many there are; repeated rows and rows without keys keep their place."""
    lines = [(i // 4, i % 4, None if i % 5 == 0 else i % 90, None if i % 3 == 0 else i % 70) for i in range(3000)] + [(None, None, 1, 1)] * 3 + [(0, 1, 1, 1)] * 2
    tables = {
        "lineitem": (lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint"),
        "part": ([(i, f"p{i % 40}", i % 50) for i in range(80)] + [(7, "p7", 1), (None, "none", 1)], "p_partkey bigint, p_name string, p_size int"),
        "supplier": ([(i, f"s{i}", i % 4, i - 5.0) for i in range(60)] + [(None, "none", 1, 1.0)], "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
        "nation": ([(i, f"n{i}", i % 2) for i in range(3)] + [(None, "none", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "r0"), (None, "none")], "r_regionkey int, r_name string"),
    }
    for name, (data, schema) in tables.items():
        make(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    want = rows(QUERIES["chained_lookup"](spark, str(tmp_path)))
    monkeypatch.setattr(jn, "TASK_ROWS", 100, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        out = QUERIES["chained_lookup"](spark, str(tmp_path))
        assert rows(out) == want
        sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(sizes) == len(want) and max(sizes) < 300


def test_chained_lookup_spreads_rows_without_a_key(spark, make, rows):
    df = make([(i, None if i % 2 else i % 10) for i in range(1000)], "id int, k int")
    table = make([(i, f"v{i}") for i in range(0, 10, 4)] + [(None, "none")], "key int, v string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = jn.chained_lookup(df, [(table, "key", "k", ["v"])], parts=10)
        assert rows(out) == rows(jn.chained_lookup(df, [(table, "key", "k", ["v"])]))
        parts = [r[0] for r in out.select(F.spark_partition_id(), "k").collect() if r[1] is None]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert max(parts.count(p) for p in parts) < 150
