"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

Documents with one shingle set are a class; its smallest id stands for it.
A class has the minima of BANDS * ROWS hash functions over its shingles. Bands
of ROWS minima make candidates; of each minimum two low bits are kept, packed
into 64-bit words, and the share of equal bit pairs, corrected for pairs that
are equal by chance, drops candidates far below the threshold. The rest are
confirmed by counting the shingles they share.

Pairs are not formed within a bucket. First every class is compared with one
class of its bucket, the one whose buckets are the largest (a template lies in
the buckets of all its copies). Then only classes of a bucket that are still
in another component than most of the bucket are compared with its others; that
join keeps nothing but pairs that share enough of a shortened form of the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from setwise.llm.components import components
from setwise.llm.store import scratch
from setwise.llm.texts import add_from_text, parts_of, space_words

# At a similarity of 0.8 a pair misses all bands with a chance of 1e-7.
BANDS, ROWS, BITS = 40, 5, 2
WORDS = -(-BANDS * ROWS * BITS // 64)
# An estimate this far below the threshold (six standard deviations) is no link.
MARGIN = 0.18
CELL = 250_000
# Most words a worker remembers the hashes of.
HASHES = 200_000

_random = np.random.default_rng(20_231)
MULTIPLY = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
BAND_MIX = _random.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """Word -> 64-bit hash, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASHES:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words are one shingle, none are none."""
    words = space_words(text, lower=True)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([_HASHES[w] for w in words], np.uint64)
    width = min(k, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return np.unique(total)


def signature(held: np.ndarray) -> np.ndarray:
    """Minima of all hash functions."""
    best = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(held), 2048):
        best = np.minimum(best, (held[at : at + 2048, None] * MULTIPLY + ADD).min(0))
    return best


def packed(minima: np.ndarray) -> np.ndarray:
    """BITS bits of every minimum, in 64-bit words."""
    values = np.zeros(WORDS * 64 // BITS, np.uint64)
    values[: len(minima)] = mixed(minima) & np.uint64((1 << BITS) - 1)
    shifts = np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(values.reshape(WORDS, -1) << shifts, axis=1)


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def _describe(k: int):
    def run(texts):
        counts, sets, bands, bits = [], [], [], []
        for text in texts:
            held = shingles(text, k)
            counts.append(len(held))
            if not len(held):
                sets.append(None), bands.append([]), bits.append([])
                continue
            minima = signature(held)
            sets.append(xxhash.xxh3_128_digest(held.tobytes()))
            bands.append(_signed(mixed((minima.reshape(BANDS, ROWS) * BAND_MIX).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))))
            bits.append(_signed(packed(minima)))
        return counts, sets, bands, bits

    return run


def similarity(a: str, b: str) -> Column:
    """Estimate from packed bits: the share of equal minima, corrected for those equal by chance."""
    apart = None
    ones = int("01" * 32, 2)  # one bit in every pair
    for i in range(WORDS):
        x = F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])
        n = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(ones)))
        apart = n if apart is None else apart + n
    return (1 - apart / (BANDS * ROWS) - 2.0**-BITS) / (1 - 2.0**-BITS)


def _likely(a: str, b: str, percent: int) -> Column:
    """What a link needs: sizes within the ratio, and an estimate not far below the threshold."""
    near = F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent
    return near & (similarity(a, b) >= percent / 100 - MARGIN)


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for frame in frames:
            keep = []
            for a, b, one, two in zip(frame["a"], frame["b"], frame["one"], frame["two"], strict=True):
                if a != last:
                    last, held = a, shingles(one, k)
                other = shingles(two, k)
                shared = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(100 * shared >= percent * (len(held) + len(other) - shared))
            yield frame.loc[keep, ["a", "b"]]

    whole = pairs.join(texts.select(F.col("key").alias("b"), F.col("body").alias("two")), "b").join(
        texts.select(F.col("key").alias("a"), F.col("body").alias("one")), "a")
    return whole.select("a", "b", "one", "two").mapInPandas(run, pairs.select("a", "b").schema)


def _small_sets(texts: DataFrame, k: int) -> DataFrame:
    """(key, small): the shingles of some documents as 32-bit numbers."""
    schema = StructType([texts.schema["key"], *StructType.fromDDL("small array<int>").fields])

    def run(batches):
        for batch in batches:
            for part in parts_of(batch, 1):
                held = [np.unique((shingles(t, k) >> np.uint64(32)).astype(np.uint32).view(np.int32)) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0] + [len(x) for x in held]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))], names=schema.names)

    return texts.select("key", "body").mapInArrow(run, schema)


def _across(open_ones: DataFrame, percent: int) -> DataFrame:
    """Pairs (a > b) of different components that met in a bucket and may be linked, one of them not in the largest.

    The join keeps a pair only if enough of their small sets is shared. Equal numbers of different shingles can only
    make that too many, those within a set are made up for: no link is lost, and few pairs without one are left.
    """
    # Around a crowded middle the left side is dealt to cells of about CELL comparisons, the right side is in all of them.
    cells = F.ceil(F.col("n_left") * F.col("n_all") / CELL)
    left = open_ones.where("component <> most").select(
        "middle", F.pmod(F.xxhash64("x.key"), cells).alias("cell"), F.col("component").alias("c1"), F.col("x").alias("a"))
    right = open_ones.select(
        F.col("middle").alias("m2"), F.explode(F.sequence(F.lit(0).cast("bigint"), cells - 1)).alias("cell2"),
        F.col("component").alias("c2"), F.col("x").alias("b"))
    lost = F.col("a.n") - F.size("a.small") + F.col("b.n") - F.size("b.small")
    shared = F.size(F.array_intersect("a.small", "b.small")) + lost
    enough = shared * (100 + percent) >= (F.col("a.n") + F.col("b.n")) * percent
    here = (F.col("middle") == F.col("m2")) & (F.col("cell") == F.col("cell2"))
    met = left.join(right, here & (F.col("c1") != F.col("c2")) & _likely("a", "b", percent) & enough)
    return met.select(F.greatest("a.key", "b.key").alias("a"), F.least("a.key", "b.key").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80,
) -> DataFrame:
    """One row per document: key, n_shingles, component (smallest key reachable over links) and kept (key = component).

    Two documents are linked when ``percent`` of the united shingles are shared. Texts without
    words have no shingles and no links; very long texts count whole. Rows without a key have no links and are kept; rows that repeat a key are
    one document and are kept together. An empty table stays empty.
    """
    hold = scratch(docs.sparkSession)
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("body"))
    rows = hold.table(add_from_text(
        named, lambda: _describe(k), "n bigint, set_id binary, bands array<bigint>, bits array<bigint>", ["key"], "body"), "signatures")
    with_set = rows.where("key IS NOT NULL AND set_id IS NOT NULL")
    classes = hold.table(with_set.groupBy("set_id").agg(F.min("key").alias("rep")), "classes")
    # By key, which is unique: the rows of a large class are not brought together.
    reps = rows.join(classes.select(F.col("rep").alias("key"), "set_id"), ["key", "set_id"], "left_semi")

    in_band = reps.select("key", F.explode("bands").alias("bucket"))
    shared = in_band.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = hold.table(in_band.join(shared, "bucket"), "members")
    standing = members.groupBy("key").agg(F.sum("size").alias("weight"))
    one = reps.select("key", "n", "bits").join(standing, "key").dropDuplicates(["key"])
    members = hold.table(members.select("bucket", "key").distinct().join(one, "key"), "members-described")
    texts = hold.table(named.join(members.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]), "texts")

    middle = hold.table(members.groupBy("bucket").agg(F.max_by(
        F.struct("key", "n", "bits"), F.struct("weight", "key")).alias("a")), "middles")
    stars = members.select("bucket", F.struct("key", "n", "bits").alias("b")).join(middle, "bucket").where(
        (F.col("a.key") != F.col("b.key")) & _likely("a", "b", percent))
    tried = hold.table(stars.select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct(), "tried")
    links = hold.table(_confirmed(tried, texts, k, percent), "links")
    joined = components(links, "a", "b", hold)

    placed = members.join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key"))
    around = placed.join(middle.select("bucket", F.col("a.key").alias("middle")), "bucket").select(
        "middle", "key", "component", "n", "bits").dropDuplicates(["middle", "key"])
    around = hold.table(around, "around")
    parts = around.groupBy("middle", "component").agg(F.count("*").alias("n_part"))
    # Stored, so that AQE may split a crowded middle in the join below.
    several = hold.table(parts.groupBy("middle").agg(
        F.count("*").alias("n_parts"), F.sum("n_part").alias("n_all"), (F.sum("n_part") - F.max("n_part")).alias("n_left"),
        F.max_by("component", F.struct("n_part", "component")).alias("most")).where("n_parts > 1"), "crowded")
    open_ones = around.join(several, "middle")
    small = hold.table(_small_sets(texts.join(open_ones.select("key").distinct(), "key", "left_semi"), k), "small-sets")
    more = _across(open_ones.join(small, "key").select(
        "middle", "component", "most", "n_all", "n_left", F.struct("key", "n", "bits", "small").alias("x")), percent)
    known = tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    late = hold.table(_confirmed(more.join(known, ["a", "b"], "left_anti"), texts, k, percent), "late-links")
    groups = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(late.select("a", "b")), "a", "b", hold)

    of_class = classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_id", F.coalesce("component", "rep").alias("component"))
    # Only classes that move a document: single documents need no partner here.
    out = rows.select("key", "n", "set_id").join(of_class, "set_id", "left").withColumn(
        "component", F.when(F.col("key").isNotNull(), F.coalesce("component", "key")))
    return out.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), "component", F.coalesce(F.col("key") == F.col("component"), F.lit(True)).alias("kept"))
