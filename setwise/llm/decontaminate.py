"""Benchmark decontamination: word-level Wu-Manber search for windows of test items.

A window is 13 consecutive words of an item (a shorter item is one window).
Windows of one length share three tables: how far the search may jump for the
last two words it stands on, the windows that end in two words that allow no
jump, and among those the windows by first word. What is left is compared word
by word. Words are interned as numbers and a window is the place where it
starts, so a block's tables are a small multiple of its text.

The windows are a stated query set. They go to the tasks in blocks of a fixed
number of words, so neither driver nor tasks hold more than a block of them;
a benchmark of more than one block costs one pass over the documents a block.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from setwise.llm.store import prepare, scratch
from setwise.llm.texts import parts_of, plain_words

WINDOW = 13
BLOCK_BYTES = 8_000_000


class WordSearch:
    """Wu-Manber tables for the windows of some items: one length each for windows of ``window`` words and for items of fewer.

    Words are numbers, items lie behind each other in one array, and a window is
    the place where it starts. The table has, for a pair of words (or a single
    one, for windows of one word), how far it lets the search jump, or if not at
    all, where the windows that end in it begin among those sorted by their end
    and first word.
    """

    def __init__(self, length: int, words: np.ndarray, first: np.ndarray, size: np.ndarray, owner: np.ndarray):
        self.length, self.far, self.words = length, length - min(2, length) + 1, words
        codes = lambda ends: words[ends - 1] << 32 | words[ends] if length > 1 else words[ends]
        spread = lambda n: np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        n = size - length + 1
        starts = np.repeat(first, n) + spread(n)
        ends = codes(starts + length - 1)
        order = np.lexsort((words[starts], ends))
        starts, ends = starts[order], ends[order]
        self.starts, self.owners, self.first = (array("q", x.tobytes()) for x in (starts, np.repeat(owner, n)[order], words[starts]))
        begins = np.flatnonzero(np.diff(ends, prepend=-1))
        self.stops = array("q", np.append(begins[1:], len(ends)).tobytes())
        # A pair inside an item stands at some window's end unless it is too near to the item's beginning.
        step = min(2, length)
        place = spread(size - step + 1) + step - 1
        code, ahead = codes(np.repeat(first, size - step + 1) + place), np.maximum(length - 1 - place, 0)
        by = np.lexsort((ahead, code))
        code, ahead = code[by], ahead[by]
        least = np.flatnonzero(np.diff(code, prepend=-1))
        code, ahead = code[least], ahead[least]
        ahead[ahead == 0] = -1 - np.arange(len(begins))  # both are sorted by code
        self.table = dict(zip(code.tolist(), ahead.tolist(), strict=True))
        self.begins = array("q", begins.tobytes())

    def find(self, text: list[int]):
        """(start, owner) of every occurrence in a text's words; words that no item has are -1."""
        n, table, far, length = len(text), self.table, self.far, self.length
        held, at = self.words, length - 1
        while at < n:
            last, before = text[at], text[at - 1] if length > 1 else 0
            if last < 0 or before < 0:
                at += far if last >= 0 or length == 1 else length  # no window holds an unknown word
                continue
            jump = table.get(before << 32 | last if length > 1 else last, far)
            if jump > 0:
                at += jump
                continue
            start = at - length + 1
            if (first := text[start]) >= 0:
                inside, these = text[start : at + 1], (self.begins[-1 - jump], self.stops[-1 - jump])
                for k in range(bisect_left(self.first, first, *these), bisect_right(self.first, first, *these)):
                    if held[self.starts[k] : self.starts[k] + length].tolist() == inside:
                        yield start, self.owners[k]
            at += 1


@dataclass
class Searches:
    """All tables of a block of items, and the numbers of its words."""

    numbers: dict[bytes, int]
    names: list[str | None]
    tables: list[WordSearch]

    def find(self, words: list[bytes]):
        """(start, length, item) of every occurrence."""
        text = [self.numbers.get(w, -1) for w in words]
        for table in self.tables:
            for start, owner in table.find(text):
                yield start, table.length, self.names[owner]


def searches(items: list[tuple[str | None, str]], window: int = WINDOW) -> Searches:
    numbers: dict[bytes, int] = {}
    lists, names, spots = [], [], defaultdict(list)
    at = 0
    for item, text in items:
        words = [numbers.setdefault(w, len(numbers)) for w in plain_words(text)]
        if not words:
            continue
        length = min(window, len(words))
        spots[length].append((at, len(words), len(names)))
        names.append(item)
        lists.append(np.array(words, np.int64))
        at += len(words)
    held = np.concatenate([*lists, np.zeros(0, np.int64)])
    tables = []
    for length, here in sorted(spots.items()):
        tables.append(WordSearch(length, held, *np.array(here, np.int64).T))
    return Searches(numbers, names, tables)


# A worker keeps the tables of the block it has last searched for: a task of the same block builds none.
_BUILT: dict[str, Searches] = {}


def _built(shared, key: str, window: int) -> Searches:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = searches(shared.value, window)
    return _BUILT[key]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text",
    item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, percent: int = 5,
) -> DataFrame:
    """``keep`` columns of every document plus items, n_words, n_hit, n_items, items_sha256 and contaminated.

    ``hit`` words lie inside an occurrence of an item window; a document is
    contaminated when ``percent`` of its words or more are hit. NULL and empty
    texts (of either table) have no words and no windows; items that repeat an
    id count once; items without an id hit as others do, count as one in
    ``n_items`` and are not in ``items``. An empty benchmark leaves
    every document clean. Columns of ``keep`` must not have the new names.
    """
    spark, keep = prepare(docs.sparkSession), list(keep)
    # Rows that repeat are one: a block's bound holds whatever their number.
    wanted = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("body")).where("body is not null").distinct()
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    found = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"),
                        F.array().cast("array<int>").alias("__spans"), F.array().cast("array<string>").alias("__items"))
    for k in range(blocks):
        # A block is about block_bytes of item text, whatever the benchmark's size.
        chosen = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast([(r.item, r.body) for r in chosen.collect()])
        if k:  # one block's tables in memory at a time
            found = scratch(spark).table(found.select(*keep, "__text", "__spans", "__items"), "decontaminate")
        found = _search(found, shared, keep, window)
    return found.select(
        *keep, F.array_compact("__items").alias("items"), "n_words", "n_hit", F.size("__items").cast("bigint").alias("n_items"), "items_sha256",
        ((F.col("n_hit") > 0) & (F.col("n_hit") * F.lit(100) >= F.col("n_words") * F.lit(percent))).alias("contaminated"))


def _search(found: DataFrame, shared, keep: list[str], window: int) -> DataFrame:
    """One block of windows against all texts; occurrences and items of earlier blocks are added to."""
    schema = StructType(found.schema.fields + StructType.fromDDL("n_words bigint, n_hit bigint, items_sha256 string").fields)
    key = uuid.uuid4().hex

    def run(batches):
        tables = _built(shared, key, window)
        for batch in batches:
            for part in parts_of(batch, len(keep)):
                rows = [_hits(tables, *r) for r in zip(*(c.to_pylist() for c in part.columns[-3:]), strict=True)]
                made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), to_arrow_schema(schema).types[-5:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep) + 1], *made], names=schema.names)

    return found.mapInArrow(run, schema)


def _hits(tables: Searches, text: str | None, spans: list[int], items: list[str | None]):
    words, spans, items = plain_words(text), list(spans), set(items)
    for start, length, item in tables.find(words):
        spans += (start, start + length)
        items.add(item)
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.asarray(spans, np.int64).reshape(-1, 2)
    np.add.at(edges, at[:, 0], 1)
    np.subtract.at(edges, at[:, 1], 1)
    named = sorted(i for i in items if i is not None)
    found = [*named, None] if None in items else named
    return spans, found, len(words), int((np.cumsum(edges[:-1]) > 0).sum()), hashlib.sha256(",".join(named).encode()).hexdigest()
