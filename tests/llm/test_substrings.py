"""Repeated passages that one document holds at several places."""

import random

import pytest
from test_against_force import spans_by_force

from setwise.llm import substrings


def several_places():
    rng = random.Random(8)
    fresh = lambda n: [f"u{rng.randrange(100_000)}" for _ in range(n)]
    # Another document has the passage in other surroundings; here its surroundings are the same at both places.
    p, a, b, other = fresh(60), fresh(40), fresh(55), fresh(90)
    passage = {3: other[:40] + p + other[40:], 5: a + p + b + a + p + b, 6: fresh(30) + p + a}
    # A run of one line, shorter than an anchor's surroundings in one document and very long in the next.
    line = fresh(9)
    run = {3: fresh(60) + (line * 9)[:70] + fresh(60), 7: line * 300, 8: fresh(20) + line * 40 + fresh(5)}
    word = {3: fresh(60) + ["x"] * 60 + fresh(60), 7: ["x"] * 700}
    return [sorted((i, " ".join(w)) for i, w in case.items()) for case in (passage, run, word)]


@pytest.mark.parametrize("group", [4000, 1])
def test_every_place_of_a_leaf(spark, group):
    for rows in several_places():
        found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), group=group).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in found} == spans_by_force(rows)


@pytest.mark.parametrize("group", [4000, 1])
def test_rows_that_repeat_a_key(spark, group):
    """Each row's surroundings are read in that row; spans found in one hold for all."""
    (rows, *_) = several_places()
    other = " ".join(f"z{i}" for i in range(300))
    docs = spark.createDataFrame([*rows, (5, other)], "doc_id bigint, text string")
    want = spans_by_force(rows)
    found = [r for r in substrings.remove_repeats(docs, group=group).collect() if r.kept_text.split()[0] != "z0"]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in found} == want
