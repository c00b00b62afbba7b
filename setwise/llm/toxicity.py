"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length.

Folding maps case, accents, letters of other scripts that look Latin, and
digits or signs beside letters to the letters they stand for, one code point to
one. Signs that may be punctuation are read both ways.
Entries are whole words or beginnings of words; a word counts with the
heaviest entry that begins where it begins. Where an exception phrase starts
at the word (or ends with it), it does not count. The sum of weights, and that
sum per hundred words, enter a logistic curve.

Lexicon, exceptions and curve are learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from setwise.llm.store import scratch
from setwise.llm.texts import add_from_text

SAMPLE = 20_000  # most labelled rows to learn from
STEMS = range(4, 9)  # lengths of word beginnings that may be entries
SUPPORT, ODDS, SIGMAS = 3, 2.0, 3.5  # an entry's least toxic documents, log odds and standard deviations

# Look-alikes of Latin letters, and digits and signs used for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ү": "y", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}


@lru_cache(maxsize=1)
def _fold_table() -> dict[int, str]:
    table = {}
    for code in range(0x80, 0x2FFFF):
        c = chr(code)
        base = unicodedata.normalize("NFKD", c)[:1] if unicodedata.category(c)[0] == "L" else ""
        low = (base or c).lower()
        low = LOOKALIKES.get(low, low)
        if len(low) == 1 and low != c:
            table[code] = low
    return table | {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


_RUN = re.compile(f"[{re.escape(''.join(SUBSTITUTES))}]+")
_SIGNS = re.compile("[!$]")  # may be punctuation as well


def readings(text: str | None) -> list[str]:
    """Folded texts of the same length: one in which ``!`` and ``$`` beside letters are letters, and one in which they are signs if that differs.

    A run of substitutes is folded whole where a letter stands directly before or after it; numbers stay.
    """
    if not text:
        return [""]
    out = text.translate(_fold_table())
    chars, signs = None, False
    for m in _RUN.finditer(out):
        start, end = m.span()
        if (start and out[start - 1].isalpha()) or (end < len(out) and out[end].isalpha()):
            chars = chars or list(out)
            chars[start:end] = [SUBSTITUTES[c] for c in m.group()]
            signs = signs or _SIGNS.search(m.group()) is not None
    if chars is None:
        return [out]
    eager = "".join(chars)
    if not signs:
        return [eager]
    return [eager, "".join([c if c in "!$" else e for c, e in zip(out, eager, strict=True)])]


def fold(text: str | None) -> str:
    """The reading in which signs beside letters are letters."""
    return readings(text)[0]


def fold_words(text: str | None) -> set[str]:
    """Runs of letters of all readings."""
    return {w for folded in readings(text) for w in "".join([c if c.isalpha() else " " for c in folded]).split()}


@dataclass
class Lexicon:
    weights: dict[tuple[str, bool], float]  # (entry, whole word) -> weight
    exceptions: frozenset[tuple[str, str]]  # two words in a row of which one is in the lexicon
    curve: tuple[float, float, float]

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for (entry, whole), weight in self.weights.items():
            old = found.get(entry, (len(entry), 0.0, 0.0))
            found.add_word(entry, (len(entry), max(old[1], weight) if whole else old[1], max(old[2], 0 if whole else weight)))
        if not len(found):
            return None
        found.make_automaton()
        return found


def _word_at(text: str, start: int) -> int:
    end = start
    while end < len(text) and text[end].isalpha():
        end += 1
    return end


def _neighbours(text: str, start: int, end: int) -> tuple[str, str]:
    """The words before and after."""
    a = start - 1
    while a >= 0 and not text[a].isalpha():
        a -= 1
    b = a
    while b >= 0 and text[b].isalpha():
        b -= 1
    c = end
    while c < len(text) and not text[c].isalpha():
        c += 1
    return text[b + 1 : a + 1], text[c : _word_at(text, c)]


def hits(folded: str, automaton, exceptions: frozenset) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the words that count."""
    best: dict[int, tuple[int, float]] = {}
    for last, (size, whole, stem) in automaton.iter(folded) if automaton is not None else ():
        start = last - size + 1
        if start and folded[start - 1].isalpha():
            continue
        ends_here = last + 1 >= len(folded) or not folded[last + 1].isalpha()
        weight = max(whole if ends_here else 0.0, stem)
        if weight > best.get(start, (0, 0.0))[1]:
            best[start] = (last + 1, weight)
    found = []
    for start, (_, weight) in sorted(best.items()):
        end = _word_at(folded, start)
        if exceptions:
            word, (before, after) = folded[start:end], _neighbours(folded, start, end)
            if (before, word) in exceptions or (word, after) in exceptions:
                continue
        found.append((start, end, weight))
    return found


def hits_of(text: str | None, automaton, exceptions: frozenset) -> list[tuple[int, int, float]]:
    """``hits`` in all readings of a text; of words that overlap the heaviest, then the first."""
    read = readings(text)
    if len(read) == 1:
        return hits(read[0], automaton, exceptions)
    kept: list[tuple[int, int, float]] = []
    for start, end, weight in sorted({h for r in read for h in hits(r, automaton, exceptions)}, key=lambda h: (-h[2], h[0], h[1])):
        at = bisect(kept, (start,))
        if (not at or kept[at - 1][1] <= start) and (at == len(kept) or kept[at][0] >= end):
            kept.insert(at, (start, end, weight))
    return kept


def features(total: float, words: int) -> tuple[float, float]:
    return math.log1p(total), math.log1p(100 * total / max(words, 20))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic fit by Newton steps with a small penalty on the slopes."""
    a = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(3), np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> Lexicon:
    """Learn from at most ``sample`` labelled rows (those with the smallest digest of their key).

    Rows without a key or label are no examples; without examples of both kinds the lexicon is empty and
    every score is below 1e-8. Of rows that repeat a key the highest label counts; texts are read whole.
    """
    spark = docs.sparkSession
    chosen = labels.where(F.col(key).isNotNull() & F.col(toxic).isNotNull()).groupBy(F.col(key).alias("k")).agg(
        F.max(F.col(toxic)).cast("int").alias("toxic")).orderBy(F.xxhash64("k"), "k").limit(sample)
    # At most ``sample`` rows: safe to send everywhere.
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k").repartition(64, "k")
    rows = scratch(spark).table(rows, "labelled")
    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Lexicon({}, frozenset(), (-20.0, 0.0, 0.0))

    def entries(frames):
        for frame in frames:
            held: dict[tuple[str, bool], list[int]] = {}
            for body, label in zip(frame["text"], frame["toxic"], strict=True):
                seen = {(w, True) for w in fold_words(body)}
                seen |= {(w[:n], False) for w, _ in list(seen) for n in STEMS if n < len(w)}
                for entry in seen:
                    held.setdefault(entry, [0, 0])[label] += 1
            yield pd.DataFrame([(e, w, b, a) for (e, w), (a, b) in held.items()], columns=["entry", "whole", "bad", "good"])

    counted = rows.mapInPandas(entries, "entry string, whole boolean, bad bigint, good bigint").groupBy("entry", "whole").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    found = counted.where(F.col("bad") >= SUPPORT).select("entry", "whole", "bad", odds.alias("weight"), (odds / error).alias("sigmas"))
    # As many as the sample's words allow, no more.
    top = found.where((F.col("weight") >= ODDS) & (F.col("sigmas") >= SIGMAS)).orderBy(F.desc("sigmas"), "entry", "whole").collect()
    # A beginning that hardly occurs outside one longer entry says no more than that entry.
    longest: dict[str, int] = {}
    for r in top:
        for n in range(1, len(r.entry) + (1 if r.whole else 0)):
            longest[r.entry[:n]] = max(longest.get(r.entry[:n], 0), r.bad)
    kept = [r for r in top if r.whole or longest.get(r.entry, 0) < 0.9 * r.bad]
    lexicon = Lexicon({(r.entry, r.whole): r.weight for r in kept}, frozenset(), (-20.0, 0.0, 0.0))
    shared = spark.sparkContext.broadcast(lexicon)

    def pairs(frames):
        automaton = shared.value.automaton()
        for frame in frames:
            held: dict[tuple[str, str], list[int]] = {}
            for body, label in zip(frame["text"], frame["toxic"], strict=True):
                seen = set()
                for folded in readings(body):
                    for start, end, _ in hits(folded, automaton, frozenset()):
                        before, after = _neighbours(folded, start, end)
                        seen |= {p for p in ((before, folded[start:end]), (folded[start:end], after)) if all(p)}
                for pair in seen:
                    held.setdefault(pair, [0, 0])[label] += 1
            yield pd.DataFrame([(*p, b, a) for p, (a, b) in held.items()], columns=["one", "two", "bad", "good"])

    phrases = rows.mapInPandas(pairs, "one string, two string, bad bigint, good bigint").groupBy("one", "two").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("good >= 5 AND bad = 0")
    lexicon.exceptions = frozenset((r.one, r.two) for r in phrases.collect())  # as many as the sample has
    shared = spark.sparkContext.broadcast(lexicon)

    def measured(frames):
        automaton = shared.value.automaton()
        for frame in frames:
            yield pd.DataFrame([
                (*features(sum(h[2] for h in hits_of(b, automaton, shared.value.exceptions)), len((b or "").split())), t)
                for b, t in zip(frame["text"], frame["toxic"], strict=True)], columns=["total", "density", "toxic"])

    # Two numbers a sampled row.
    points = rows.mapInPandas(measured, "total double, density double, toxic int").toPandas()
    lexicon.curve = _curve(points[["total", "density"]].to_numpy(), points["toxic"].to_numpy(float))
    return lexicon


def rate(docs: DataFrame, lexicon: Lexicon, keep: Sequence[str] = ("doc_id",), text: str = "text", least: float = 0.7) -> DataFrame:
    """``keep`` columns with score (0 to 1), predicted (score >= ``least``) and toxic_spans (code points) of every whole text.

    NULL and empty texts have no hits and the curve's lowest score. Very long texts are read whole, rows that repeat
    get the same result each, scores equal to ``least`` are predicted, and an empty table stays empty.
    Columns of ``keep`` must not have the new names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def work():
        automaton = shared.value.automaton()
        a, b, c = shared.value.curve

        def run(texts):
            scores, spans = [], []
            for text in texts:
                found = hits_of(text, automaton, shared.value.exceptions)
                x, y = features(sum(h[2] for h in found), len((text or "").split()))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y)))))
                spans.append([{"start": s, "end": e} for s, e, _ in found])
            return scores, spans

        return run

    found = add_from_text(docs, work, "score double, toxic_spans array<struct<start:int,end:int>>", keep, text)
    return found.withColumn("predicted", (F.col("score") >= least).cast("int"))
