"""Window search against plain Python, its memory, and items without an id."""

import hashlib
import random
import tracemalloc

import pytest

from setwise.llm import decontaminate


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_items_without_an_id(spark, block):
    items = spark.createDataFrame([(None, "one two three"), (None, "seven eight"), ("a", "four five"), ("b", None)], "item_id string, text string")
    docs = spark.createDataFrame(
        [(1, "x one two three y"), (2, "four five one two three seven eight"), (3, "one two"), (4, "four five")], "doc_id bigint, text string")
    got = sorted(decontaminate.find_contamination(docs, items, block_bytes=block).collect())
    assert [(r.n_hit, r["items"], r.n_items, r.contaminated) for r in got] == [
        (3, [], 1, True), (7, ["a"], 2, True), (0, [], 0, False), (2, ["a"], 1, True)]
    assert [r.items_sha256 for r in got] == [hashlib.sha256(x).hexdigest() for x in (b"", b"a", b"", b"a")]


def windows(words, length):
    n = min(length, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


@pytest.mark.parametrize("window", [1, 2, 3, 5, 13])
def test_search_against_force(window):
    """Every occurrence of every window, words that repeat, items of fewer words, and texts with words that no item has."""
    rng = random.Random(window)
    words = lambda n, most: [f"w{rng.randrange(most)}" for _ in range(n)]
    for most in (2, 4, 60):
        items = [(str(i) if i % 7 else None, " ".join(words(rng.randrange(0, 30), most))) for i in range(30)] + [("x", None), ("y", " ")]
        tables = decontaminate.searches(items, window)
        for _ in range(20):
            text = words(60, most + 1)
            if items[3][1]:
                text[20:20] = items[3][1].split()
            want = {(at, len(w), i) for i, t in items for w in windows((t or "").split(), window)
                    for at in range(len(text) - len(w) + 1) if tuple(text[at : at + len(w)]) == w}
            assert set(tables.find([w.encode() for w in text])) == want


def test_a_block_fits_a_worker():
    """Eight megabytes of item text, the size of a block."""
    rng = random.Random(1)
    words = [f"{rng.randrange(10**6):x}" for _ in range(200_000)]
    items = [(str(i), " ".join(rng.choices(words, k=4000))) for i in range(340)]
    assert sum(len(t) for _, t in items) > 7_000_000
    tracemalloc.start()
    tables = decontaminate.searches(items)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 400_000_000
    assert {i for _, _, i in tables.find([w.encode() for w in items[7][1].split()[100:120]])} == {"7"}


def test_repeated_items_are_one(spark):
    items = spark.createDataFrame([("a", "four five")] * 50, "item_id string, text string")
    docs = spark.createDataFrame([(1, "four five six")], "doc_id bigint, text string")
    assert [(r.n_hit, r["items"]) for r in decontaminate.find_contamination(docs, items).collect()] == [(2, ["a"])]
