"""Alignment of two tokenizers: groups of tokens that cover the same bytes, and how often ids are linked.

Both tokenizers cut a text's bytes into tokens. Where a token of each ends at
the same byte a group ends. The ends of both are merged along their merge path:
diagonals at equal distances, each found by binary search, cut the path into
pieces of equal work, which need nothing of each other. A piece emits the ends
that both sides have in it; an end whose two sides fall into neighbouring pieces
is found at the cut, and a group runs on from piece to piece until an end closes it.

How many documents hold a pair of ids linked is a corpus-wide count. Documents
are held in chunks of bounded text; a chunk lists each pair once, with the
number of its documents. The lists are summed by pair, and every chunk gets the
counts of its own pairs back, so a pair that all documents hold is one row a
chunk, no table of all pairs is broadcast, and no key is hot. A chunk is stored
in rows of bounded lists, and these in bounded row groups: what Spark writes,
reads or deals out at a time depends neither on a chunk nor on a task's input.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from setwise.llm.store import scratch, small_batches
from setwise.llm.texts import parts_of

PIECE = 16_384  # ends of both sides in a piece
PART_BYTES = 500_000  # text that is encoded together
CHUNK_BYTES = 8_000_000  # text whose pairs are listed together
DOC_BYTES = 500  # that a document counts for beside its text
ROW = 16_384  # pairs and links of a chunk in a row
DOC_LINKS = 16  # links that a document's other columns count for in a row
GROUP_BYTES = 8_000_000  # stored bytes of a row group, 100 rows at least
LINKS = 4_000_000  # links spread out at a time


class Side:
    """A tokenizer: ids of texts, and the bytes of every id."""

    def __init__(self, encode, tokens: list[bytes]):
        self.encode, self.tokens = encode, tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself where printable, else the next beyond 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


# Characters whose classes (letter, digit, space) no version of Unicode has changed, and no run of spaces to search back over.
_SETTLED = re.compile(r"(?!.*\s{500})[\x00-\u04ff]*", re.DOTALL)


def _ranked(path: str, tokens: list[bytes]):
    """The same vocabulary for the ``tiktoken`` library, if its merges are ranked by id and its pattern is the usual one; else None."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    cut, model = said["pre_tokenizer"] or {}, said["model"]
    usual = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not said["normalizer"]
    if not usual or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        return None
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in pairwise(merged)):
        return None
    special = {t["id"] for t in said["added_tokens"]}
    ranks = {t: i for i, t in enumerate(tokens) if t and i not in special}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def byte_level(path: str) -> Side:
    """A byte-level BPE of the ``tokenizers`` library, over the text after a space.

    Texts of settled characters get the same ids from the faster ``tiktoken`` library where the file allows it.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel work
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    letters = _byte_letters()
    special = set(tokenizer.get_added_tokens_decoder())
    names = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]
    tokens = [b"" if i in special else bytes(letters[c] for c in name) for i, name in enumerate(names)]
    ranked = _ranked(path, tokens)

    def encode(texts: list[str]) -> list[list[int]]:
        quick = [ranked is not None and _SETTLED.fullmatch(t) is not None for t in texts]
        slow = iter(tokenizer.encode_batch_fast([f" {t}" for t, q in zip(texts, quick, strict=True) if not q], add_special_tokens=False))
        return [ranked.encode_ordinary(f" {t}") if q else next(slow).ids for t, q in zip(texts, quick, strict=True)]

    return Side(encode, tokens)


@lru_cache(maxsize=2)
def pieces(path: str) -> Side:
    """A BPE of the ``sentencepiece`` library, which puts the space before itself."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    byte = re.compile(r"<0x([0-9A-F]{2})>")
    named = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in named]
    return Side(lambda texts: model.encode(texts, num_threads=1), tokens)


def path_cuts(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """How much of a and of b lies before each diagonal of their merge path, ends included; a goes first where they are equal."""
    diagonals = np.arange(piece, len(a) + len(b), piece)
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while len(searched := np.flatnonzero(low < high)):
        middle = (low[searched] + high[searched]) // 2
        of_a = a[middle] <= b[diagonals[searched] - 1 - middle]
        low[searched[of_a]], high[searched[~of_a]] = middle[of_a] + 1, middle[~of_a]
    return np.concatenate(([0], low, [len(a)])), np.concatenate(([0], diagonals - low, [len(b)]))


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Where two rising sequences have the same value: indices in a and in b."""
    cut_a, cut_b = path_cuts(a, b, piece)
    found = []
    for i in range(len(cut_a) - 1):
        here, there = a[cut_a[i] : cut_a[i + 1]], b[cut_b[i] : cut_b[i + 1]]
        if i and cut_a[i] and len(there) and a[cut_a[i] - 1] == there[0]:  # one end on both sides of the cut
            found.append((cut_a[i] - 1 + np.zeros(1, np.int64), cut_b[i] + np.zeros(1, np.int64)))
        if len(here) and len(there):
            at = np.searchsorted(there, here)
            same = np.flatnonzero(there[np.minimum(at, len(there) - 1)] == here)
            found.append((cut_a[i] + same, cut_b[i] + at[same]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(side) for side in zip(*found, strict=True))


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate(times), len(distinct)).astype(np.int64)


def _links(a, b, starts_a, starts_b, n_a, n_b, n_b_ids: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair, times) of one text's groups, pairs as a * n_b_ids + b, spread out ``most`` at a time."""
    sizes = n_a * n_b
    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    block = np.cumsum(sizes) // most
    for k in np.unique(block):
        inside = np.flatnonzero(block == k)
        for g in inside[sizes[inside] > most]:  # tokens of one group, each id once
            ids_a, many_a = np.unique(a[starts_a[g] : starts_a[g] + n_a[g]], return_counts=True)
            ids_b, many_b = np.unique(b[starts_b[g] : starts_b[g] + n_b[g]], return_counts=True)
            for i in range(0, len(ids_a), max(1, most // len(ids_b))):
                part = slice(i, i + max(1, most // len(ids_b)))
                keys.append((ids_a[part, None] * n_b_ids + ids_b).ravel())
                times.append((many_a[part, None] * many_b).ravel())
        inside = inside[sizes[inside] <= most]
        group = np.repeat(inside, sizes[inside])
        at = np.arange(len(group)) - np.repeat(np.cumsum(sizes[inside]) - sizes[inside], sizes[inside])
        pair = a[starts_a[group] + at // n_b[group]] * n_b_ids + b[starts_b[group] + at % n_b[group]]
        distinct, many = np.unique(pair, return_counts=True)
        keys, times = [*keys, distinct], [*times, many]
        if len(keys) > 64 or sum(map(len, keys)) > 4 * most:
            keys, times = ([x] for x in _summed(keys, times))
    return _summed(keys, times)


def _group_texts(a, b, last_a, last_b, n_a, n_b, names: np.ndarray, size_a: int, size_b: int) -> np.ndarray:
    """The names of all tokens in the order of their groups, A's before B's, each with the sign after it."""
    placed = np.zeros(len(a) + len(b), np.int64)
    code_a, code_b = a.copy(), b + 2 * size_a
    code_a[last_a] += size_a
    code_b[last_b] += size_b
    placed[np.arange(len(a)) + np.repeat(last_b + 1 - n_b, n_a)] = code_a
    placed[np.arange(len(b)) + np.repeat(last_a + 1, n_b)] = code_b
    return names[placed]


def _aligned(a_side: Side, b_side: Side, names: np.ndarray, texts: list[str | None], spell: bool, piece: int, most: int):
    """For each text (n_a, n_b, n_groups, n_links, groups or its digest) and its (pair, times)."""
    rows: list[tuple] = [(0, 0, 0, 0, "")] * len(texts)
    links = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
    some = [i for i, t in enumerate(texts) if t]
    coded = zip(some, a_side.encode([texts[i] for i in some]), b_side.encode([texts[i] for i in some]), strict=True)
    held = []
    for i, a, b in coded:
        whole = b" " + texts[i].encode()
        if b"".join(map(a_side.tokens.__getitem__, a)) == whole == b"".join(map(b_side.tokens.__getitem__, b)):
            held.append((i, len(a), len(b), np.array(a, np.int64), np.array(b, np.int64)))
    if not held:
        return rows, links
    at, long_a, long_b, a, b = zip(*held, strict=True)
    a, b = np.concatenate(a), np.concatenate(b)
    # Texts follow each other on one axis: the last token of each ends with it on both sides.
    last_a, last_b = common_ends(np.cumsum(a_side.sizes[a]), np.cumsum(b_side.sizes[b]), piece)
    n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    pieces_of = _group_texts(a, b, last_a, last_b, n_a, n_b, names, len(a_side.tokens), len(b_side.tokens))
    text_a, text_b = np.cumsum((0, *long_a)), np.cumsum((0, *long_b))
    group_at = np.searchsorted(last_a, text_a[1:] - 1, "right")
    first = 0
    for k, i in enumerate(at):
        these = slice(first, group_at[k])
        first = group_at[k]
        said = "".join(pieces_of[text_a[k] + text_b[k] : text_a[k + 1] + text_b[k + 1]].tolist())[:-1]
        links[i] = _links(a, b, last_a[these] + 1 - n_a[these], last_b[these] + 1 - n_b[these], n_a[these], n_b[these], len(b_side.tokens), most)
        rows[i] = (long_a[k], long_b[k], these.stop - these.start, int((n_a[these] * n_b[these]).sum()),
                   said if spell else hashlib.sha256(said.encode()).hexdigest())
    return rows, links


def _chunk(number: int, keys: list[pa.Array], rows: list[tuple], links: list[tuple], schema: pa.Schema, row: int) -> Iterator[pa.RecordBatch]:
    """The chunk's texts, its distinct pairs with the number of texts that hold each, and every text's pairs by their place, in rows of bounded lists."""
    pairs, place = np.unique(np.concatenate([k for k, _ in links]), return_inverse=True)
    held = np.bincount(place, minlength=len(pairs))
    docs = pa.StructArray.from_arrays(
        [pa.concat_arrays(keys), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)),
         pa.array(np.cumsum([len(k) for k, _ in links]), pa.int64())],
        fields=list(schema.field("docs").type.value_type))
    lists = [docs, pa.array(pairs), pa.array(held, pa.int64()), pa.array(place, pa.int32()), pa.array(np.concatenate([t for _, t in links]), pa.int64())]
    most = [max(1, row // DOC_LINKS), *[row] * 4]
    for part in range(max(-(-len(x) // n) for x, n in zip(lists, most, strict=True))):
        cut = [x.slice(part * n, n) for x, n in zip(lists, most, strict=True)]
        one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x).cast(f.type) for x, f in zip(cut, list(schema)[2:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([part], pa.int64()), *one], schema=schema)


def align(
    docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", groups: bool = False,
    piece: int = PIECE, chunk_bytes: int = CHUNK_BYTES, most: int = LINKS, row: int = ROW,
) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (or with ``groups`` the text it digests).

    A is a byte-level vocabulary of the ``tokenizers`` library, B a ``sentencepiece`` model; both files are read by every worker.
    NULL and empty texts, and texts that either tokenizer does not give back byte for byte, have no tokens: zeros and ''. Very long
    texts are aligned whole. Rows that repeat a key or a text are documents of their own in the counts; pairs with the same count
    are all best. An empty table stays empty; other columns are ignored.
    """
    spark, hold = docs.sparkSession, scratch(docs.sparkSession)
    said = "groups" if groups else "groups_sha256"
    key_type = docs.schema[key].dataType
    counted = ("n_a", "n_b", "n_groups", "n_links")
    doc_fields = pa.struct([pa.field(key, to_arrow_type(key_type)), *[pa.field(c, pa.int64()) for c in counted], pa.field(said, pa.string()), pa.field("link_end", pa.int64())])
    of_docs = ", ".join([f"`{key}`: {key_type.simpleString()}", *[f"{c}: bigint" for c in counted], f"{said}: string", "link_end: bigint"])
    chunk_ddl = f"chunk bigint, part bigint, docs array<struct<{of_docs}>>, pairs array<bigint>, held array<bigint>, place array<int>, times array<bigint>"
    lists = [pa.field(n, pa.list_(t)) for n, t in (("docs", doc_fields), ("pairs", pa.int64()), ("held", pa.int64()), ("place", pa.int32()), ("times", pa.int64()))]
    chunk_schema = pa.schema([pa.field("chunk", pa.int64()), pa.field("part", pa.int64()), *lists])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side = byte_level(a_path), pieces(b_path)
        names = np.array([f"{i}{c}" for side, ends in ((a_side, ",|"), (b_side, ",;")) for c in ends for i in range(len(side.tokens))], object)
        number, size, keys, rows, links = TaskContext.get().partitionId() << 32, 0, [], [], []
        for batch in batches:
            for part in parts_of(batch, 1, PART_BYTES):
                texts = part.column(1).to_pylist()
                more, linked = _aligned(a_side, b_side, names, texts, groups, piece, most)
                keys, rows, links = [*keys, part.column(0)], rows + more, links + linked
                size += part.column(1).nbytes + DOC_BYTES * part.num_rows
                if size >= chunk_bytes:
                    yield from _chunk(number, keys, rows, links, chunk_schema, row)
                    number, size, keys, rows, links = number + 1, 0, [], [], []
        if rows:
            yield from _chunk(number, keys, rows, links, chunk_schema, row)

    with small_batches(spark):
        chunks = hold.table(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(encode, chunk_ddl), "chunks", **{"parquet.block.size": GROUP_BYTES})
    n_b_ids = len(pieces(b_path).tokens)
    counts = hold.table(chunks.select(F.explode(F.arrays_zip("pairs", "held")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(
        F.sum("p.held").alias("n")).withColumn("a", F.expr(f"pair div {n_b_ids}")), "counts")
    judged = counts.join(counts.groupBy("a").agg(F.max("n").alias("most")), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    own = chunks.select(F.col("chunk").alias("of"), "part", F.posexplode("pairs").alias("at", "pair")).withColumn("at", F.col("part") * row + F.col("at"))
    own = own.select("of", "at", "pair").join(judged, "pair").select("of", "at", "n", "best")

    out = StructType([StructField(key, key_type), *[StructField(c, LongType()) for c in (*counted, "n_best", "count_sum")], StructField(said, StringType())])
    arrow_out = pa.schema([pa.field(key, to_arrow_type(key_type)), *[pa.field(c, pa.int64()) for c in (*counted, "n_best", "count_sum")], pa.field(said, pa.string())])

    def total(chunk: pa.Table, counts: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("part")
        one = lambda name: chunk.column(name).combine_chunks().flatten()
        place, times, held = one("place").to_numpy(), one("times").to_numpy(), one("docs")
        n, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
        at = counts.column("at").to_numpy()
        n[at], best[at] = counts.column("n").to_numpy(), counts.column("best").to_numpy().astype(np.int64)
        ends = np.concatenate(([0], held.field("link_end").to_numpy()))
        sums = [np.concatenate(([0], np.cumsum(x[place] * times)))[ends] for x in (best, n)]
        flat = [held.field(i) for i in range(6)]
        return pa.Table.from_arrays([*flat[:5], *(pa.array(np.diff(s)) for s in sums), flat[5]], schema=arrow_out)

    return chunks.select("chunk", "part", "docs", "place", "times").groupBy("chunk").cogroup(own.groupBy("of")).applyInArrow(total, out)
