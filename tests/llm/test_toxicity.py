"""A lexicon learned from a rich vocabulary."""

import random
import re

import pytest

from setwise.llm import toxicity


def test_every_word_of_a_rich_vocabulary_is_an_entry(spark):
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(800)]
    rows = [(i, " ".join(words) if i < 30 else "nothing but plain text", int(i < 30)) for i in range(230)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    lexicon = toxicity.fit(made.select("doc_id", "text"), made.select("doc_id", "toxic"))
    assert {(w, True) for w in words} <= set(lexicon.weights)


@pytest.mark.parametrize(("text", "want"), [
    ("b00000m", "booooom"), ("a55", "ass"), ("garbag3", "garbage"), ("idi0t5", "idiots"), ("(4ss", "(ass"), ('"1diot', '"idiot'), ("2024 was 100 %", "2024 was 100 %"),
    ("sh!t", "shit"), ("$tupid", "stupid"), ("x" + "0" * 500, "x" + "o" * 500), ("5 4 3", "5 4 3"),
])
def test_fold(text, want):
    assert toxicity.fold(text) == want


def test_signs_are_read_both_ways():
    lexicon = toxicity.Lexicon({("stupid", True): 2.0, ("shit", True): 1.0}, frozenset(), (0.0, 1.0, 1.0))
    found = lambda text: toxicity.hits_of(text, lexicon.automaton(), lexicon.exceptions)
    assert found("stupid! sh!t $tupid$") == [(0, 6, 2.0), (8, 12, 1.0)]
    assert found("stupid") == [(0, 6, 2.0)] and found(None) == found("") == []


def hits_by_force(folded, weights, exceptions):
    """Every entry tried at every word."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", folded)]
    out = []
    for i, (a, b) in enumerate(words):
        word = folded[a:b]
        best = max([w for (entry, whole), w in weights.items() if (word == entry if whole else word.startswith(entry))], default=0)
        before = folded[slice(*words[i - 1])] if i else ""
        after = folded[slice(*words[i + 1])] if i + 1 < len(words) else ""
        if best and (before, word) not in exceptions and (word, after) not in exceptions:
            out.append((a, b, best))
    return out


def test_hits_against_force():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 7)))
    for _ in range(60):
        weights = {(word(), rng.random() < 0.6): float(rng.randrange(1, 9)) for _ in range(25)}
        exceptions = frozenset((word(), word()) for _ in range(60))
        text = "".join(word() + rng.choice((" ", ", ", " " * 30, ".\n", "9")) for _ in range(80))
        lexicon = toxicity.Lexicon(weights, exceptions, (0.0, 0.0, 0.0))
        assert toxicity.hits(text, lexicon.automaton(), exceptions) == hits_by_force(text, weights, exceptions)


def test_all_exceptions_are_kept(spark):
    """More exception phrases than any fixed number would hold."""
    clean = [f"clown w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3500)]
    rows = [(i, "you clown", 1) for i in range(30)] + [(100 + i, " . ".join(clean), 0) for i in range(6)] + [(200 + i, "plain", 0) for i in range(2000)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    lexicon = toxicity.fit(made.select("doc_id", "text"), made.select("doc_id", "toxic"))
    assert len({p for p in lexicon.exceptions if p[0] == "clown"}) == 3500
