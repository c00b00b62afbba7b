"""Substring deduplication by prefix-partitioned suffix trees over words.

A window of SPAN words is removed when its words also begin in a document with
a smaller id. Suffixes are taken at anchors: words at which a GRAM-word
sequence has the least hash among the sequences of some window. Equal windows
choose equal anchors at equal offsets, so every repeated window shows as an
anchor with an equal prefix of GRAM words in two documents, and about one
position in eighteen is an anchor.

Suffixes are partitioned by prefixes of variable length. An anchor's sequence
is the prefix of a group that fits in memory; where too many suffixes share
it, the prefix is lengthened to the whole window, and a group is then a single
node of depth SPAN of which only the smallest document is needed. Suffixes
with the same words on both sides are one leaf, counted before the shuffle. A
leaf is represented by one suffix of its smallest document; what is found for
it holds at every place where that document has the leaf.

In a memory-sized group two trees are grown level by level, one over the words
after the anchor and one over the words before it. A node of depth a in the
first and one of depth b in the second with a + b = SPAN are a window; the
smallest document below both is the one that keeps it. The comparison is of
words, not of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from setwise.llm.minhash import _HASHES, mixed
from setwise.llm.store import scratch
from setwise.llm.texts import parts_of, space_words

SPAN, GRAM = 50, 16
BEFORE = SPAN - GRAM  # words before an anchor that a window with it may have
GROUP = 4_000  # most suffixes of a group
BATCH = 12_000  # suffixes whose trees are grown together
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def widened(df: DataFrame, fields: str) -> StructType:
    """The key's field and others."""
    return StructType([df.schema["key"], *StructType.fromDDL(fields).fields])


class Sequences:
    """Hashes of word sequences of one document, from sums over its beginning."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        h = np.array([_HASHES[w] for w in words], np.uint64)
        up, self.down = np.full(n + 1, STEP, np.uint64), np.full(n + 1, BACK, np.uint64)
        up[0] = self.down[0] = 1
        up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(self.down, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:-1], dtype=np.uint64)])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def choices(grams: np.ndarray) -> np.ndarray:
    """The position that the window at each position chooses: the first one with its least hash."""
    windows = np.lib.stride_tricks.sliding_window_view(grams, BEFORE + 1)
    parts = np.array_split(np.arange(len(windows)), 1 + len(windows) // 20_000)
    return np.concatenate([part + windows[part].argmin(1) for part in parts])


def anchors_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash of the GRAM words there, hash of all words that windows with the anchor may have)."""
    n = len(words)
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    seq = Sequences(words)
    at = np.arange(n - GRAM + 1)
    grams = seq.between(at, at + GRAM)
    chosen = np.unique(choices(grams))
    first, last = np.maximum(chosen - BEFORE, 0), np.minimum(chosen + SPAN, n)
    whole = mixed(seq.between(first, last) + (chosen - first).astype(np.uint64) * STEP)
    return chosen, grams[chosen], whole


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _describe(named: DataFrame) -> DataFrame:
    """One row per anchor: key, mark, at, prefix, whole, size (words of the document)."""
    schema = widened(named, "mark bigint, at int, prefix bigint, whole bigint, size int")

    def run(batches):
        for batch in batches:
            for part in parts_of(batch, 1):
                keys, marks, made = part.column(0), part.column(2), [[], [], [], [], []]
                for i, text in enumerate(part.column(1).to_pylist()):
                    words = space_words(text)
                    at, gram, whole = anchors_of(words)
                    for column, x in zip(made, (np.full(len(at), i), at, gram, whole, np.full(len(at), len(words))), strict=True):
                        column.append(x)
                row, at, gram, whole, size = (np.concatenate(x) for x in made)
                row = pa.array(row.astype(np.int64))
                yield pa.RecordBatch.from_arrays([
                    keys.take(row), marks.take(row), pa.array(at.astype(np.int32)), _signed(gram.astype(np.uint64)),
                    _signed(whole.astype(np.uint64)), pa.array(size.astype(np.int32))], names=schema.names)

    return named.where("key IS NOT NULL").mapInArrow(run, schema)


def _contexts(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (key, body, spots): the words around an anchor, and windows by the hash of all their words."""
    around_schema = widened(wanted, "prefix bigint, whole bigint, before int, around binary")
    window_schema = widened(wanted, "prefix bigint, whole bigint, window bigint, window2 bigint, ahead int")

    def around(batches):
        for batch in batches:
            for part in parts_of(batch, 1):
                rows, index = [], []
                for i, (text, spots) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    words = space_words(text)
                    for s in spots:
                        at = s["at"]
                        if not s["long"] and at < len(words):
                            first = max(at - BEFORE, 0)
                            index.append(i)
                            rows.append((s["prefix"], s["whole"], at - first, b" ".join(words[first : at + SPAN])))
                if rows:
                    columns = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(index)), *columns], names=around_schema.names)

    def windows(batches):
        for batch in batches:
            for part in parts_of(batch, 1):
                for i, (text, spots) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    words = space_words(text)
                    seq, at = Sequences(words), np.arange(len(words) - GRAM + 1)
                    long = {s["at"]: s for s in spots if s["long"]}
                    # Equal windows choose equal anchors: a window is looked up at the one it chooses.
                    chosen = choices(seq.between(at, at + GRAM))
                    starts = np.flatnonzero(np.isin(chosen, np.fromiter(long, np.int64)))
                    chosen = chosen[starts]
                    one = seq.between(starts, starts + SPAN)
                    two = seq.between(starts, starts + SPAN // 2)
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).take(pa.array(np.full(len(starts), i))),
                        *[pa.array([long[c][f] for c in chosen.tolist()], pa.int64()) for f in ("prefix", "whole")],
                        _signed(one), _signed(two), pa.array((chosen - starts).astype(np.int32))], names=window_schema.names)

    return wanted.where("exists(spots, s -> NOT s.long)").mapInArrow(around, around_schema), wanted.where(
        "exists(spots, s -> s.long)").mapInArrow(windows, window_schema)


def grow(node: np.ndarray, symbols: np.ndarray) -> list[np.ndarray]:
    """Nodes of every suffix at each depth: those at one depth with the same next word share a child. -1: past the end."""
    levels = [node]
    for column in symbols.T:
        ends = (node < 0) | (column < 0)
        _, child = np.unique(np.where(ends, -1, node * (int(symbols.max(initial=0)) + 2) + column), return_inverse=True)
        node = np.where(ends, -1, child)
        levels.append(node)
    return levels


def repeats_of(prefix: np.ndarray, rank: np.ndarray, before: np.ndarray, around: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in windows that a smaller document has: index, and the first and last window offset before the anchor.

    ``rank`` orders the documents.
    """
    n = len(prefix)
    vocabulary: dict[bytes, int] = {}
    after, ahead = np.full((n, SPAN), -1, np.int64), np.full((n, BEFORE), -1, np.int64)
    for i, raw in enumerate(around):
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in raw.split(b" ")]
        b = before[i]
        after[i, : len(ids) - b] = ids[b:]
        ahead[i, :b] = ids[:b][::-1]
    group = np.unique(prefix, return_inverse=True)[1]
    right, left = grow(group, after), grow(group, ahead)
    low, high = np.full(n, SPAN), np.full(n, -1)
    for offset in range(BEFORE + 1):
        a, b = left[offset], right[SPAN - offset]
        inside = np.flatnonzero((a >= 0) & (b >= 0))
        if not len(inside):
            continue
        window = np.unique(a[inside] * (int(b.max()) + 1) + b[inside], return_inverse=True)[1]
        least = np.full(int(window.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, window, rank[inside])
        again = inside[least[window] < rank[inside]]
        low[again], high[again] = np.minimum(low[again], offset), np.maximum(high[again], offset)
    found = np.flatnonzero(high >= 0)
    return found, low[found], high[found]


def _trees(contexts: DataFrame) -> DataFrame:
    """(key, prefix, whole, low, high): first and last offset of repeated windows, from suffixes sorted by prefix; whole groups are worked on together."""
    schema = widened(contexts, "prefix bigint, whole bigint, low int, high int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(table: pa.Table) -> pa.RecordBatch:
            keys = table.column("key").combine_chunks()
            order = pc.rank(keys, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
            prefix, whole = table.column("prefix").to_numpy(), table.column("whole").to_numpy()
            found, low, high = repeats_of(prefix, order, table.column("before").to_numpy(), table.column("around").to_pylist())
            return pa.RecordBatch.from_arrays([
                keys.take(pa.array(found)), pa.array(prefix[found]), pa.array(whole[found]),
                pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=schema.names)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < BATCH:
                continue
            table = pa.Table.from_batches(held)
            prefix = table.column("prefix").to_numpy()
            cut = int(np.searchsorted(prefix, prefix[-1]))  # the last group may go on in the next batch
            if cut:
                yield work(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held and sum(b.num_rows for b in held):
            yield work(pa.Table.from_batches(held))

    return contexts.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """(key, start, end): words of windows that a document with a smaller key has as well; spans may overlap."""
    hold = scratch(docs.sparkSession)
    # The mark tells rows that repeat a key apart, as a position is one of its own row's words.
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("body"), F.xxhash64(text).alias("mark"))
    anchors = hold.table(_describe(named), "anchors")
    leaves = anchors.groupBy("prefix", "whole").agg(
        F.min("key").alias("least"), F.max("key").alias("most"), F.min_by(F.struct("at", "mark"), "key").alias("first"))
    leaves = hold.table(leaves.select("prefix", "whole", "least", "most", "first.*"), "leaves")

    # The same words on both sides in a smaller document: all windows with the anchor are repeats.
    twins = leaves.where("least < most").select("prefix", "whole", "least", F.lit(0).alias("low"), F.lit(BEFORE).alias("high"), F.lit(True).alias("twin"))

    # Different words around one prefix, in different documents: these suffixes go to the trees.
    nodes = leaves.groupBy("prefix").agg(F.count("*").alias("n"), F.min("least").alias("low"), F.max("most").alias("high")).where(
        "n > 1 AND low < high").select("prefix", (F.col("n") > group).alias("long"))
    spots = leaves.join(nodes, "prefix").groupBy(F.col("least").alias("key"), "mark").agg(
        F.collect_list(F.struct("prefix", "whole", "at", "long")).alias("spots"))
    wanted = hold.table(named.join(spots, ["key", "mark"]).select("key", "body", "spots"), "wanted")
    around, windows = _contexts(wanted)
    found = _trees(around)

    windows = hold.table(windows, "windows")
    least = windows.groupBy("window", "window2").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most")
    single = windows.join(least, ["window", "window2"]).where("key > least").groupBy("key", "prefix", "whole").agg(
        F.min("ahead").alias("low"), F.max("ahead").alias("high"))

    # A leaf's smallest document loses what was found for it at every place where it has the leaf, the others all windows with it.
    shown = found.union(single).select("prefix", "whole", F.col("key").alias("least"), "low", "high", F.lit(False).alias("twin"))
    return anchors.join(twins.union(shown), ["prefix", "whole"]).where("CASE WHEN twin THEN key > least ELSE key = least END").select(
        "key", F.greatest(F.col("at") - F.col("high"), F.lit(0)).cast("int").alias("start"),
        (F.least(F.col("at") - F.col("low"), F.col("size") - SPAN) + SPAN).cast("int").alias("end"))


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """One row per document: key, n_words, n_removed, removed (merged word spans), kept_text (kept words joined by a blank).

    NULL and empty texts have no words. Rows without a key are left whole and are no source of windows. Rows that
    repeat a key are one document: none of them makes another lose words, and spans found in one hold for all.
    Documents of fewer than SPAN words have no windows. An empty table stays empty.
    """
    spans = repeated_spans(docs, key, text, group).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("body")).join(spans, "key", "left").select("key", "body", "spans")
    schema = widened(rows, "n_words bigint, n_removed bigint, removed array<struct<start:int,end:int>>, kept_text string")

    def run(batches):
        for batch in batches:
            for part in parts_of(batch, 1):
                made = [[], [], [], []]
                for body, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words, kept, at = space_words(body), [], 0
                    removed = [(a, min(b, len(words))) for a, b in _merged(found) if a < len(words)]
                    for a, b in removed:
                        kept += words[at:a]
                        at = b
                    kept += words[at:]
                    for column, x in zip(made, (
                        len(words), len(words) - len(kept), [{"start": a, "end": b} for a, b in removed], b" ".join(kept).decode()), strict=True):
                        column.append(x)
                types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, type=t) for c, t in zip(made, types, strict=True)]], names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def digest(removed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest form of ``remove_repeats``."""
    return removed.select(key, "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


