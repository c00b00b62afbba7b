"""Language spans: scripts narrow the candidates, Viterbi over word scores labels stretches of a text.

A word is a run of letters. Its score in a language is the sum of log
frequencies of its letter trigrams (with the word's edges) among hashed
trigrams of that language. Languages whose training texts hardly use the
word's script are no candidates. The best path through the words, where every
change of language costs ``switch``, gives spans; a document is in the
language that has most of its letters.

The model has a fixed size (slots times languages), so the counts of any
amount of training text end in it; every training row is counted.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from setwise.llm.store import prepare
from setwise.llm.texts import add_from_text, parts_of

SLOTS = 1 << 14
MOST_LANGUAGES = 500
SWITCH = 12.0  # log units that a change of language must gain
RARE_SCRIPT = 0.01  # a language does not use a script with a smaller share of its letters
UNKNOWN = "und"

# First code point of script ranges, in order; code points before
# the first and after a gap belong to the range that begins before them.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"),
    (0x2C80, "other"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"),
    (0x20000, "han"),
)
NAMES = sorted({name for _, name in SCRIPTS})


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: lower case of letters (0 for all else), whether it is a letter, script."""
    lower, letter = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for code in range(0x110000):
        if unicodedata.category(chr(code))[0] == "L":
            low = chr(code).lower()
            lower[code], letter[code] = ord(low) if len(low) == 1 else code, True
    first = np.array([a for a, _ in SCRIPTS])
    index = np.array([NAMES.index(name) for _, name in SCRIPTS], np.uint8)
    return lower, letter, index[np.searchsorted(first, np.arange(0x110000), side="right") - 1]


@dataclass
class Words:
    """Letters and words of some joined texts."""

    slots: np.ndarray  # trigram slot of every letter
    starts: np.ndarray  # first letter of every word, among letters
    at: np.ndarray  # code point position of every letter, in the joined texts
    text: np.ndarray  # text of every word
    script: np.ndarray  # script of every word's first letter
    letter_script: np.ndarray


def read_words(texts: Sequence[str | None]) -> Words:
    lower, letter, script = _tables()
    lengths = np.array([len(t or "") + 1 for t in texts])
    codes = np.frombuffer("\n".join([t or "" for t in texts] + [""]).encode("utf-32-le"), np.uint32)
    is_letter = letter[codes]
    low = np.where(is_letter, lower[codes], 0).astype(np.uint64)
    at = np.flatnonzero(is_letter)
    before = np.where(at > 0, low[at - 1], 0)
    after = low[np.minimum(at + 1, len(low) - 1)] if len(low) else low
    mixed = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (low[at] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (after * np.uint64(0x165667B19E3779F9))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    starts = np.flatnonzero(before == 0)
    text = np.searchsorted(np.cumsum(lengths), at[starts], side="right")
    return Words((mixed >> np.uint64(50)).astype(np.int64) % SLOTS, starts, at, text, script[codes[at[starts]]], script[codes[at]])


def _counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, kind, slot, n): letters by trigram slot and by script, summed within each task first."""

    def run(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part in parts_of(batch, 0, 2_000_000):
                texts, langs = part.column(0).to_pylist(), part.column(1).to_pylist()
                for name in set(langs):
                    w = read_words([t for t, x in zip(texts, langs, strict=True) if x == name])
                    slots, scripts = held.setdefault(name, (np.zeros(SLOTS, np.int64), np.zeros(len(NAMES), np.int64)))
                    slots += np.bincount(w.slots, minlength=SLOTS)
                    scripts += np.bincount(w.letter_script, minlength=len(NAMES))
        for name, both in held.items():
            for kind, counts in enumerate(both):
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_pydict({"lang": [name] * len(at), "kind": [kind] * len(at), "slot": at, "n": counts[at]}, schema)

    schema = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("slot", pa.int64()), ("n", pa.int64())])
    rows = docs.select(text, lang).mapInArrow(run, "lang string, kind int, slot bigint, n bigint")
    return rows.groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # [language, slot]
    uses: np.ndarray  # [script, language]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST_LANGUAGES) -> Model:
    """Counts of all rows with a text and a language; ``most`` languages bound the model, and more are an error."""
    prepare(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    names = sorted(r[0] for r in known.select(lang).distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} languages: raise ``most``")
    slots, scripts = np.zeros((len(names), SLOTS)), np.zeros((len(names), len(NAMES)))
    for r in _counts(known, text, lang).toLocalIterator():
        (scripts if r.kind else slots)[names.index(r.lang), r.slot] = r.n
    scores = np.log((slots + 0.1) / (slots.sum(1, keepdims=True) + 0.1 * SLOTS))
    return Model(names, scores.astype(np.float32), (scripts / np.maximum(scripts.sum(1, keepdims=True), 1) >= RARE_SCRIPT).T)


def best_paths(scores: np.ndarray, text: np.ndarray, switch: float) -> np.ndarray:
    """State of every word on its text's best path; all texts advance in step, longest first."""
    n, k = scores.shape
    path = np.zeros(n, np.int64)
    if not n:
        return path
    heads = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    sizes = np.diff(np.append(heads, n))
    by = np.argsort(-sizes, kind="stable")
    heads, sizes = heads[by], sizes[by]
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # texts that have a word at each step
    best = scores[heads].copy()
    stays = np.ones((n, k), bool)
    came = np.zeros(n, np.int64)
    for t in range(1, sizes[0]):
        a = active[t]
        old, at = best[:a], heads[:a] + t
        top = old.argmax(1)
        jump = (old[np.arange(a), top] - switch)[:, None]
        stays[at], came[at] = old >= jump, top
        best[:a] = np.maximum(old, jump) + scores[at]
    state = best.argmax(1)
    for t in range(sizes[0] - 1, -1, -1):
        a = active[t]
        at = heads[:a] + t
        path[at] = state[:a]
        if t:
            state[:a] = np.where(stays[at, state[:a]], state[:a], came[at])
    return path


def label(texts: Sequence[str | None], model: Model, switch: float) -> tuple[list, list, list]:
    """Language, share of letters in it, and spans (start, end, language) in code points."""
    w = read_words(texts)
    k, n = len(model.languages), len(texts)
    pred, share, spans = [UNKNOWN] * n, [0.0] * n, [[] for _ in range(n)]
    if not k or not len(w.starts):
        return pred, share, spans
    scores = np.stack([np.add.reduceat(model.scores[i][w.slots], w.starts) for i in range(k)], axis=1)
    fits = model.uses[w.script]
    scores = np.where(fits | ~fits.any(1, keepdims=True), scores, scores - 1000)
    path = best_paths(scores, w.text, switch)
    ends = np.append(w.starts[1:], len(w.at)) - 1
    size = ends - w.starts + 1
    letters = np.bincount(w.text * k + path, weights=size, minlength=n * k).reshape(n, k)
    base = np.cumsum([0] + [len(t or "") + 1 for t in texts])
    for i in np.flatnonzero(letters.sum(1)):
        pred[i], share[i] = model.languages[letters[i].argmax()], float(letters[i].max() / letters[i].sum())
    edges = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (w.text[1:] != w.text[:-1])))
    for a, b in zip(edges, np.append(edges[1:], len(path)) - 1, strict=True):
        i = w.text[a]
        spans[i].append({"start": int(w.at[w.starts[a]] - base[i]), "end": int(w.at[ends[b]] - base[i]) + 1, "lang": model.languages[path[a]]})
    return pred, share, spans


def identify(
    docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), text: str = "text", switch: float = SWITCH,
) -> DataFrame:
    """``keep`` columns with lang_pred, score (share of letters) and lang_spans of every whole text.

    NULL texts, texts without a letter and models without a language give
    ``und``, score 0 and no spans. Very long texts are read whole, rows that repeat get the same result each, of
    languages with as many letters the first by name is predicted, and an empty table stays empty.
    Columns of ``keep`` must not have the new names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = "lang_pred string, score double, lang_spans array<struct<start:int,end:int,lang:string>>"
    return add_from_text(docs, lambda: lambda texts: label(texts, shared.value, switch), fields, keep, text)


def fold(key: str, parts: int) -> Column:
    """Fold of a row: crc32 of its key as text; rows without a key are in fold 0."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts
