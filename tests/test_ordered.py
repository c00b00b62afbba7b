"""Numbering, running sums and previous rows against plain Python, hot keys included."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from setwise.operators import aggregates as ag
from setwise.operators import maintenance as mt
from setwise.operators.ordered import ordered_rows


def expected(data):
    """data: (key, position, value) -> {(key, position): (number, running, carried, previous)}"""
    out = {}
    for key in {d[0] for d in data}:
        total, last, before = 0, None, None
        for n, (_, pos, v) in enumerate(sorted((d for d in data if d[0] == key), key=lambda d: d[1]), 1):
            total += v or 0
            last = v if v is not None else last
            out[key, pos] = (n, total, last, before)
            before = v
    return out


@pytest.mark.parametrize("slices, hot", [(1, 0.4), (3, 0.0), (8, 0.4), (8, 1.0)])
def test_matches_plain_loop(make, slices, hot):
    rnd = random.Random(slices * 10 + int(hot * 10))
    data = [(0 if rnd.random() < hot else rnd.choice([None, 1, 2, 3]), i, rnd.choice([None, 1, 5, 7])) for i in range(400)]
    df = make(data, "k int, pos int, v int")
    got = ordered_rows(df, [F.col("pos").asc()], ["k"], running={"total": "v"}, carried={"last": "v"}, previous={"before": "v"}, slices=slices)
    want = expected(data)
    seen = {(r.k, r.pos): (r.row_no, r.total or 0, r.last, r.before) for r in got.collect()}
    assert seen == want


def test_hot_key_is_spread(make, plan_of, spark):
    """A single key's rows are worked on in several slices of like size."""
    df = make([(1, i) for i in range(4000)], "k int, pos int")
    out = ordered_rows(df, [F.col("pos").asc()], ["k"], slices=4)
    sizes = [r[1] for r in spark.read.parquet(*out.inputFiles()).groupBy("__slice").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000
    assert out.agg(F.max("row_no"), F.count_distinct("row_no")).first() == (4000, 4000)


def test_global_descending(make):
    df = make([(i,) for i in range(100)], "v int")
    out = ordered_rows(df, [F.col("v").desc()], running={"total": "v"}, slices=7)
    assert {r.v: (r.row_no, r.total) for r in out.collect()}[98] == (2, 99 + 98)


def test_empty(make):
    assert ordered_rows(make([], "k int, v int"), [F.col("v").asc()], ["k"], running={"t": "v"}).count() == 0


def test_pareto_example(make, rows):
    df = make([("a", 60), ("b", 30), ("c", 8), ("d", 2), ("idle", 900)], "item string, v int")
    out = ag.pareto(df, "item", "v", 95, exclude=["idle"])
    assert rows(out.select("row_no", "item", "running")) == [(1, "a", 60), (2, "b", 90), (3, "c", 98)]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 50), min_size=1, max_size=40), st.sampled_from([50, 80, 95]))
def test_pareto_property(make, values, coverage):
    items = [(f"i{n:03d}", v) for n, v in enumerate(values)]
    kept, before, total = [], 0, sum(values)
    for name, v in sorted(items, key=lambda x: (-x[1], x[0])):
        if before * 100 < coverage * total:
            kept.append(name)
        before += v
    out = ag.pareto(make(items, "item string, v int"), "item", "v", coverage)
    assert sorted(r.item for r in out.collect()) == sorted(kept)


def test_budget_stops_cleanly(make, rows):
    df = make([(i, 10) for i in range(10)], "id int, cost int")
    out = mt.budgeted_queue(df, [F.col("id").asc()], "cost", 25)
    assert rows(out.select("queue_no", "id", "start_at", "end_at")) == [(1, 0, 0, 10), (2, 1, 10, 20), (3, 2, 20, 30)]


def test_concat_parts_rejoin(make):
    df = make([("hot", i) for i in range(500)] + [("cold", 7), ("cold", None)], "k string, v int")
    parts = ag.group_concat_parts(df, ["k"], "v", [F.col("v").asc()], rows_per_part=64).collect()
    whole = {}
    for r in sorted(parts, key=lambda r: (r.k, r.part_no)):
        whole[r.k] = whole[r.k] + "," + r.joined if r.k in whole else r.joined
    assert whole == {"hot": ",".join(map(str, range(500))), "cold": "7"}
    assert max(r.n for r in parts) == 64
