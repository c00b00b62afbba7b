"""The trigram index finds what a scan finds."""

import random

import pytest
from pyspark.sql import functions as F

from setwise.operators import textindex as ti
from setwise.session import scratch_path

TEXTS = [(1, "Abcabcabc"), (2, None), (3, ""), (4, "ab"), (5, "xx <Shared Data> yy"), (6, "ABC"), (None, "abc"), (7, "Straße ÄÖ"), (8, "bca bca"), (6, "abc")]


def scan(texts, snippets):
    return {(s, k) for s in snippets for k, t in texts if k is not None and t is not None and s.lower() in t.lower()}


@pytest.mark.parametrize("most", [20_000, 2])
def test_search_against_scan(make, spark, plan_of, most):
    rnd = random.Random(1)
    texts = TEXTS + [(100 + i, "".join(rnd.choice("abcd ") for _ in range(rnd.randrange(40)))) for i in range(200)]
    snippets = ["abc", "ABCA", "", "b", "aß", "shared data", "zzz", "bca bca", "äö", "dab", "a b c"]
    df, index = make(texts, "k int, t string"), scratch_path(spark, "index")
    ti.build_index(df, "k", F.col("t"), index, most)
    found = ti.search(df, "k", F.col("t"), index, snippets)
    assert {(r.snippet, r.key) for r in found.collect()} == scan(texts, snippets)
    sizes = spark.read.parquet(f"{index}/lists").select(F.size("keys").alias("n"), "holders").agg(F.max("n"), F.max("holders")).first()
    assert sizes[0] <= sizes[1] and (most > 2 or sizes[0] < 30)


def test_reads_only_matching_lists(make, spark, plan_of):
    df, index = make(TEXTS, "k int, t string"), scratch_path(spark, "index")
    ti.build_index(df, "k", F.col("t"), index)
    plan = plan_of(ti.matching(spark, index, "lists", ["abc"]))
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(gram), EqualTo(gram,abc)" in plan


def test_binary_and_nothing(make, spark):
    df, index = make([(1, bytearray(b"A <Report>"))], "k int, c binary"), scratch_path(spark, "index")
    text = F.decode("c", "UTF-8")
    ti.build_index(df, "k", text, index)
    assert [tuple(r) for r in ti.search(df, "k", text, index, ["<report>"]).collect()] == [("<report>", 1)]
    assert ti.search(df, "k", text, index, []).collect() == []


def test_lists_are_stored_and_not_pairs(make, spark, monkeypatch):
    """What is stored while an index is built has a row for each trigram and part, however many texts hold it."""
    stored, store = [], ti.materialize

    def recorded(df, label="stage"):
        out = store(df, label)
        stored.append(out.count())
        return out

    monkeypatch.setattr(ti, "materialize", recorded)
    df, index = make([(i % 250, "abcdefgh") for i in range(300)], "k int, t string"), scratch_path(spark, "index")
    ti.build_index(df, "k", F.col("t"), index, 200)
    assert sum(stored) <= 6 * 2
    sizes = {r.gram: r.holders for r in spark.read.parquet(f"{index}/sizes").collect()}
    assert sizes == dict.fromkeys(("abc", "bcd", "cde", "def", "efg", "fgh"), 250)
