"""The token-group join against all pairs."""

import random

import brute
import numpy as np
import pytest

from setwise.llm import group_join, minhash

SCHEMA = "doc_id bigint, text string, component string, rep int"


def edited(rng, words, share):
    return [f"x{rng.randrange(99)}" if rng.random() < share else w for w in words]


def clusters(seed, sizes=(60, 60, 12, 12, 3)):
    """Groups of copies of a text, of copies of copies, texts below the threshold, and texts of few words."""
    rng = random.Random(seed)
    rows = [["one"], ["one"], ["two", "words"], ["two", "words"], ["TWO", "words"], []]
    for size in sizes:
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(8, 220))]
        rows.append(base)
        for _ in range(size):
            rows.append(edited(rng, rng.choice((base, rows[-1])), rng.choice((0, 0.01, 0.02, 0.04, 0.1))))
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def found(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return group_join.similar_groups(docs, **options).collect()


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"chunk_bytes": 2000, "part_tokens": 500, "group": 2}), (3, {"percent": 60, "k": 2, "group": 4})])
def test_against_force(spark, seed, options):
    rows = clusters(seed)
    k, percent = options.get("k", 4), options.get("percent", 85)
    want = brute.components([i for i, _ in rows], brute.similar_pairs(rows, k, percent))
    got = found(spark, rows, **options)
    assert {r.doc_id: r.component for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(minhash.shingles(t, k)) for i, t in rows}


def test_edge_rows(spark):
    long = " ".join(f"word{i % 997} and{i % 13}" for i in range(60_000))
    words = [f"v{i}" for i in range(50)]
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (None, " ".join(words)), (9, " ".join(words)), (5, " ".join(words).upper()), (7, long), (6, long + " end"),
        (8, "alone"), (5, "second text under a key that other text has"), (4, "second text under a key that other text has"), (9, " ".join(words)), (2, "a b c d e f"),
    ]
    got = sorted(((r.doc_id, r.n_shingles, r.component) for r in found(spark, rows)), key=str)
    n_long = len(minhash.shingles(long, 4))
    assert got == sorted([
        (1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 47, None), (9, 47, 4), (5, 47, 4), (7, n_long, 6), (6, n_long + 1, 6), (8, 1, 8),
        (5, 6, 4), (4, 6, 4), (9, 47, 4), (2, 3, 2)], key=str)
    assert found(spark, []) == []


def test_sketches_hold_what_they_promise():
    rng = np.random.default_rng(3)
    for percent in (60, 80, 85, 95):
        for n in range(1, 60):
            for other in range(group_join.needed(n, percent), n + 1):
                overlap = -(-percent * (n + other) // (100 + percent))
                a = rng.permutation(10_000)[: n + other - overlap]
                x, y = np.sort(a[:n]), np.sort(a[n - overlap :])
                (size_x, sure_x), (size_y, sure_y) = (group_join.sketch_sizes(np.array([len(s)]), percent, 10) for s in (x, y))
                both = set(x[: size_x[0]].tolist()) & set(y[: size_y[0]].tolist())
                assert len(both) >= max(sure_x[0], sure_y[0])


def test_pages_of_a_template_below_the_threshold(spark, monkeypatch):
    """Alike, but never linked: no pairs are formed however many there are."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:90] + [f"own{rng.randrange(10**9)}" for _ in range(30)])) for i in range(400)]
    compared = []
    linked = group_join._linked
    monkeypatch.setattr(group_join, "_linked", lambda pairs, *a: compared.append(pairs.count()) or linked(pairs, *a))
    assert all(r.component == r.doc_id for r in found(spark, rows))
    assert sum(compared) == 0


def variants(seed, n, vocabulary, places, most=5):
    """Copies of a text of 150 words with up to ``most`` words replaced."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    rows = [base]
    for _ in range(n):
        words = base[:]
        for at in rng.sample(range(150), rng.randint(1, most)):
            words[at * places // 150 * 150 // places] = f"own{rng.randrange(vocabulary)}"
        rows.append(words)
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_near_copies_that_are_not_linked_are_compared_with_few(spark, monkeypatch):
    rows = variants(5, 500, 30, 150)
    compared = []
    linked = group_join._linked
    monkeypatch.setattr(group_join, "_linked", lambda pairs, *a: compared.append(pairs.count()) or linked(pairs, *a))
    want = brute.components([i for i, _ in rows], brute.similar_pairs(rows, 4, 85))
    assert {r.doc_id: r.component for r in found(spark, rows)} == want
    assert sum(compared) < 20 * len(rows)


@pytest.mark.parametrize(("seed", "vocabulary", "places", "options"), [(6, 3, 10, {}), (7, 2, 150, {"group": 3}), (8, 6, 6, {"percent": 80, "k": 3, "group": 4}), (9, 40, 20, {"percent": 90})])
def test_near_copies_with_edits_in_common(spark, seed, vocabulary, places, options):
    rows = variants(seed, 250, vocabulary, places, 9)
    want = brute.components([i for i, _ in rows], brute.similar_pairs(rows, options.get("k", 4), options.get("percent", 85)))
    assert {r.doc_id: r.component for r in found(spark, rows, **options)} == want
