from datetime import date

import pytest
from pyspark.sql import functions as F

from setwise.operators import aggregates as ag
from setwise.operators import ranking as rk


def test_rollup_keeps_detail_and_total(make, rows):
    df = make([("data", "a", 2), ("data", "b", 3), (None, "c", 5)], "g string, f string, mb int")
    out = ag.rollup_total(df, "g", "f", {"mb": F.sum("mb")}, "total")
    assert rows(out.select("sort_group", "f", "mb")) == [(0, "a", 2), (0, "b", 3), (0, "c", 5), (1, "total", 10)]


def test_shares_sum_to_hundred(make):
    df = make([(i, i * i + 1) for i in range(30)], "k int, v int")
    assert abs(float(ag.share_of_total(df, "v", type_="decimal(20,6)").agg(F.sum("pct")).first()[0]) - 100) < 1e-3


def test_share_of_nothing(make):
    assert ag.share_of_total(make([(1, 0)], "k int, v int"), "v").first().pct is None


def test_buckets_overlap_on_edges(make):
    df = make([("x", 5, 10.0), ("x", 7, 99.0), ("y", 1, 0.0)], "db string, s int, frag double")
    profile = lambda closed: {r.db: r.asDict() for r in ag.bucket_profile(
        df, "db", F.col("s"), F.col("frag"), range(0, 101, 10), closed, "frag").collect()}
    both, left = profile("both"), profile("left")
    assert (both["x"]["frag10"], both["x"]["frag20"], both["x"]["frag100"]) == (1, 1, 1)
    assert (left["x"]["frag10"], left["x"]["frag20"]) == (0, 1)
    assert both["x"]["touches"] == 2 and both["x"]["total_duration"] == 12 and both["x"]["avg_duration"] == 6
    with pytest.raises(ValueError):
        profile("right")


def test_group_concat_forms(make, rows):
    df = make([("g", "b"), ("g", "a"), ("g", "a"), ("g", None), ("h", "c")], "k string, v string")
    assert rows(ag.group_concat(df, ["k"], "v")) == [("g", "a,a,b"), ("h", "c")]
    assert rows(ag.group_concat(df, ["k"], "v", "; ", descending=True)) == [("g", "b; a; a"), ("h", "c")]
    assert rows(ag.group_concat(df, ["k"], "v", "'", distinct=True)) == [("g", "a'b"), ("h", "c")]


def test_group_concat_sorts_by_value_not_text(make, rows):
    assert rows(ag.group_concat(make([("g", 10), ("g", 9)], "k string, v int"), ["k"], "v")) == [("g", "9,10")]


def test_rollup_strings_has_no_entities(make, rows):
    df = make([("s1", "to", "a&b"), ("s1", "to", "<c>"), ("s1", "cc", "d"), ("s2", "to", "e")], "s string, p string, v string")
    assert rows(ag.rollup_strings(df, ["s"], "p", "v")) == [("s1", "cc=d; to=<c>,a&b"), ("s2", "to=e")]
    parts = ag.rollup_strings(df, ["s"], "p", "v", rows_per_part=1)
    assert rows(parts.select("s", "part_no", "joined")) == [("s1", 1, "cc=d"), ("s1", 2, "to=<c>,a&b"), ("s2", 1, "to=e")]
    long = make([("s", f"k{i:04d}", "v" * 30) for i in range(200)], "s string, p string, v string")
    assert len(ag.rollup_strings(long, ["s"], "p", "v").first().joined) > 7000


def test_bucket_profile_keeps_every_group_and_the_last_edge(make):
    df = make([(f"g{i:05d}", 1, 100) for i in range(1500)], "g string, d int, m int")
    out = ag.bucket_profile(df, "g", F.col("d"), F.col("m"), [0, 50, 100], closed="left").collect()
    assert len(out) == 1500 and all(r.bucket100 == 1 and r.bucket50 == 0 for r in out)


def test_share_of_capacity(make):
    df = make([(1.0, 4.0), (1.0, 0.0)], "part double, whole double")
    assert [float(r.pct) for r in ag.share_of_capacity(df, "part", "whole").collect()] == [25.0, 100000.0]


def test_accumulate_list(make):
    df = make([("DOM\\bob",), ("DOM\\al",), ("DOM\\bob",), (None,)], "u string")
    assert ag.accumulate_list(df, "u", strip_chars=4).first()[0] == '"al", "bob"'


@pytest.mark.parametrize("waits, text", [
    ([5], "(1x: 5ms)K"), ([5, 9], "(2x: 5/9ms)K"), ([5, 7, 9], "(3x: 5/7/9ms)K"), ([5, 5, 5], "(3x: 5ms)K"), ([1, 2, 2], "(3x: 1/1/2ms)K")])
def test_wait_digest(make, waits, text):
    assert ag.wait_digest(make([(1, "K", w) for w in waits], "s int, k string, ms long"), ["s"], "k", "ms").first().digest == text


def test_wait_digest_order(make):
    df = make([(1, "B", 1), (1, "A", 1), (1, "C", 1), (1, "C", 1)], "s int, k string, ms long")
    assert ag.wait_digest(df, ["s"], "k", "ms").first().digest == "(2x: 1ms)C, (1x: 1ms)A, (1x: 1ms)B"


def test_txn_digest(make):
    df = make([(1, "db", 2, 2048, 5), (1, "db", 1, 100, 3), (1, "a", 1, 0, 9)], "s int, d string, n long, b long, t int")
    assert tuple(ag.txn_digest(df, ["s"], "d", "n", "b", "t").first()) == (1, "a: 1 (0 kB), db: 3 (2 kB)", 3)


def test_partials_equal_one_shot(make, rows):
    raw = [(i % 3, i * 7 % 11) for i in range(60)]
    parts = make([(k, max(v for _, v in chunk), min(v for _, v in chunk), len(chunk)) for part in range(4) for k in range(3)
                  if (chunk := [r for i, r in enumerate(raw) if i % 4 == part and r[0] == k])], "k int, hi int, lo int, n int")
    whole = make(raw, "k int, v int").groupBy("k").agg(F.max("v"), F.min("v"), F.count("v"))
    assert rows(ag.merge_partials(parts, ["k"], ["hi"], ["lo"], ["n"])) == rows(whole)


def test_best_row_directions(make, rows):
    df = make([(1, 5, 2, "x"), (1, 5, 1, "y"), (1, 4, 0, "z"), (2, 1, 1, "w")], "k int, a int, b int, c string")
    assert rows(rk.best_row(df, ["k"], {"a": True, "b": False}).select("k", "c")) == [(1, "y"), (2, "w")]
    assert rows(rk.best_row(df, ["k"], {"a": True, "b": True}).select("k", "c")) == [(1, "x"), (2, "w")]
    assert rows(rk.best_row(df, ["k"], {"a": False}).select("k", "c")) == [(1, "z"), (2, "w")]
    assert rows(rk.best_row(df, ["k"], {"a": True, "c": False}).select("k", "c")) == [(1, "x"), (2, "w")]
    assert rows(rk.best_row(df, ["k"], {"c": False, "a": True}).select("k", "c")) == [(1, "x"), (2, "w")]


def test_best_row_null_and_dates_in_mixed_directions(make, rows):
    df = make([(1, 5, None, date(2024, 1, 2)), (1, 5, 3, date(2024, 1, 1)), (1, 4, 1, date(2020, 1, 1)), (None, 1, 1, None)],
              "k int, a int, b int, d date")
    assert rows(rk.keep_first(df, ["k"], {"a": True, "b": False}).select("k", "b")) == [(1, None), (None, 1)]
    assert rows(rk.keep_first(df, ["k"], {"a": True, "d": False}).select("k", "b")) == [(1, 3), (None, 1)]


def test_dense_ids_number_null(make, rows):
    df = make([("b",), (None,), ("a",), (None,)], "k string")
    assert sorted((r.dense_id, r.k) for r in rk.dense_ids(df, "k").collect()) == [(1, None), (1, None), (2, "a"), (3, "b")]


def test_reductions_use_no_window(make, plan_of):
    df = make([(1, 2)], "k int, v int")
    for out in (rk.latest_per_group(df, ["k"], "v"), rk.with_group_totals(df, ["k"], {"s": F.sum("v")}),
                ag.group_concat(df, ["k"], "v"), ag.share_of_total(df, "v")):
        assert "Window" not in plan_of(out)


def test_top_n_needs_no_full_sort(make, plan_of):
    out = rk.top_n(make([(1, 2)], "k int, v int"), F.col("v"), 5, [F.col("k").asc()])
    assert "TakeOrderedAndProject" in plan_of(out) and "rangepartitioning" not in plan_of(out)


def test_group_totals_keep_null_groups(make, rows):
    df = make([(None, 1), (None, 2), (3, 4)], "k int, v int")
    assert rows(rk.with_group_totals(df, ["k"], {"s": F.sum("v")})) == [(3, 4, 4), (None, 1, 3), (None, 2, 3)]


def test_latest_or_none(make, rows):
    entities = make([("a",), ("b",)], "k string")
    backups = make([("a", 1, "full"), ("a", 2, "log")], "k string, t int, kind string")
    assert rows(rk.latest_or_none(entities, backups, "k", "t", [], "kind", " No Backup").select("k", "kind")) == [("a", "log"), ("b", " No Backup")]
