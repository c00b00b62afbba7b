"""Quality rules on the repetition inside a document, found by a suffix array over its words.

Suffixes are ranked by prefix doubling, many documents at once; a suffix that
is alone with its first k words leaves the doubling, so passes get short fast.
The ranks of all levels give the longest common prefix of neighbours in suffix
order; its intervals of depth ``min_repeat`` and more are the maximal repeats.
Their spans are united, and the covered fraction and the longest are limited.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from setwise.llm.texts import add_from_text, space_words

SYMBOLS = [bytes([b]) for b in b"#*$%&|<>"]
WHITE = [bytes([b]) for b in b" \t\n\x0b\x0c\r"]
FIELDS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "covered_chars bigint, longest_repeat bigint"
)


@dataclass(frozen=True)
class Rules:
    """A document is rejected when any limit is passed."""

    min_repeat: int = 8  # words that make a repeat
    min_words: int = 20
    repeat_percent: int = 30  # most words in repeats, of all words
    char_percent: int = 35  # most characters of words in repeats, of all characters of words
    longest: int = 200  # most words of one repeat


def suffix_ranks(ids: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words; the last ones are all different.

    Suffixes of different documents never compare equal. Only groups that are
    still tied are sorted again.
    """
    n = len(ids)
    at, rank, tied = np.arange(n), np.zeros(n, np.int64), doc * (int(ids.max(initial=0)) + 1) + ids
    levels: list[np.ndarray] = []
    k = 0
    while len(at):
        if k:
            on = np.minimum(at + k, n - 1)
            tied = rank[at] * (n + 2) + np.where((at + k < n) & (doc[at] == doc[on]), rank[on] + 1, 0)
        by = np.argsort(tied, kind="stable")
        at, tied, old = at[by], tied[by], rank[at[by]]
        here = np.arange(len(at))
        first = np.ones(len(at), bool)
        first[1:] = tied[1:] != tied[:-1]
        head = np.ones(len(at), bool)
        head[1:] = old[1:] != old[:-1]
        group = np.maximum.accumulate(np.where(first, here, 0))
        rank = rank.copy()
        rank[at] = old + group - np.maximum.accumulate(np.where(head, here, 0))
        levels.append(rank.astype(np.int32))
        alone = first & np.append(first[1:], True)
        at, k = at[~alone], max(1, 2 * k)
    return levels


def common_prefix(levels: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many words the suffixes p and q have in common, from the highest level down."""
    n, length = len(levels[0]), np.zeros(len(p), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = p + length, q + length
        inside = (a < n) & (b < n)
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        length += np.where(inside & (levels[level][a] == levels[level][b]), 1 << level, 0)
    return length


def repeats(ids: np.ndarray, doc: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the deepest repeat that begins at a word, where it has ``shortest`` words or more.

    That is the deepest common-prefix interval of the suffix: the larger common
    prefix with its two neighbours in suffix order.
    """
    levels = suffix_ranks(ids, doc)
    known = min(shortest.bit_length() - 1, len(levels) - 1)
    if known < 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = levels[known]
    at = np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)
    order = at[np.argsort(levels[-1][at])]
    length = np.zeros(len(order), np.int64)
    if len(order):
        near = common_prefix(levels, order[:-1], order[1:])
        length[1:] = near
        length[:-1] = np.maximum(length[:-1], near)
    long = length >= shortest
    return order[long], length[long]


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n words lie in a span."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.subtract.at(edges, starts + lengths, 1)
    return np.cumsum(edges[:-1]) > 0


def measure(texts: Sequence[str | None], shortest: int = 8) -> list[list[int]]:
    """The columns of FIELDS for some texts, all in one suffix array."""
    split = [space_words(t) for t in texts]
    vocabulary: dict[bytes, int] = {}
    ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for words in split for w in words], np.int64)
    ends = np.cumsum([len(w) for w in split], dtype=np.int64)
    doc = np.repeat(np.arange(len(split)), [len(w) for w in split])
    base = repeats(ids, doc, 8)
    own = base if shortest == 8 else repeats(ids, doc, shortest)
    in_base, in_own = covered(len(ids), *base), covered(len(ids), *own)
    longest = np.zeros(len(split), np.int64)
    np.maximum.at(longest, doc[own[0]], own[1])
    rows = []
    for i, (text, words) in enumerate(zip(texts, split, strict=True)):
        raw = (text or "").encode("utf-8", "surrogatepass")
        part = slice(ends[i] - len(words), ends[i])
        held = [words[j] for j in np.flatnonzero(in_own[part])]
        seen: set[bytes] = set()
        again = 0
        for line in raw.split(b"\n"):
            if line.split():
                again += line in seen
                seen.add(line)
        rows.append((
            len(words), len(text or "") - sum(map(raw.count, WHITE)), sum(map(raw.count, SYMBOLS)), again,
            int(in_base[part].sum()), len(b"".join(held).decode("utf-8", "surrogatepass")), int(longest[i])))
    return [list(c) for c in zip(*rows, strict=True)]


def quality(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``keep`` columns of every document with the columns of FIELDS, base_failed and kept.

    NULL and empty texts count zero everywhere and fail for having too few
    words. Repeated rows are judged one by one; the length of a text is not
    limited, a part of a task holds one whole text at least. Columns of
    ``keep`` must not have the new names.
    """
    found = add_from_text(docs, lambda: lambda texts: measure(texts, rules.min_repeat), FIELDS, keep, text, 2_000_000)
    failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.repeat_percent)
    over = (F.col("covered_chars") * 100 > F.col("word_chars") * rules.char_percent) | (F.col("longest_repeat") > rules.longest)
    return found.withColumns({"base_failed": failed, "kept": ~failed & ~over})
