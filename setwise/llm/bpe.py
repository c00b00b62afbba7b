"""Byte-level BPE: pre-tokens from a scan over transition functions, cached pair merging, and decoding.

Pre-tokenising is a small automaton over classes of code points that look one
or two characters ahead. A character is a function from states to states, and
functions compose associatively: all chunks of a batch of texts are composed
side by side, the few chunk functions are applied in a row, and a second pass
marks where a slice begins. No regular expression runs.
"""

from __future__ import annotations

import base64
import heapq
import struct
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from setwise.llm.texts import add_from_text

CACHE_ENTRIES, CACHE_PIECE = 300_000, 64  # pieces longer than so many bytes are merged anew

# Code points that count as white space.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Symbols: letter, number, other, an apostrophe that may begin 's 't 'm 'd or
# 're 've 'll, a last space before something else, another last white space,
# white space that is followed by more of it or by the end.
LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, LAST, MID = range(8)
FRESH, WORD, DIGITS, SIGNS, JOIN, GAP, ONE_MORE, TWO_MORE = range(8)


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """State after a symbol, and whether a slice begins with it, by [symbol, state]."""
    after, begins = np.zeros((8, 8), np.uint8), np.ones((8, 8), bool)
    rows = {
        LETTER: (WORD, {WORD: WORD, JOIN: WORD, ONE_MORE: FRESH, TWO_MORE: ONE_MORE}),
        NUMBER: (DIGITS, {DIGITS: DIGITS, JOIN: DIGITS}),
        OTHER: (SIGNS, {SIGNS: SIGNS, JOIN: SIGNS}),
        SHORT: (ONE_MORE, {SIGNS: SIGNS, JOIN: SIGNS}),
        LONG: (TWO_MORE, {SIGNS: SIGNS, JOIN: SIGNS}),
        BLANK: (JOIN, {}),
        LAST: (FRESH, {}),
        MID: (GAP, {GAP: GAP}),
    }
    for symbol, (new, goes_on) in rows.items():
        after[symbol] = new
        for state, to in goes_on.items():
            after[symbol, state], begins[symbol, state] = to, False
    return after, begins


AFTER, BEGINS = _transitions()
# A text's first character acts on FRESH whatever came before: symbols 8 to 15.
AFTER = np.concatenate([AFTER, np.repeat(AFTER[:, :1], 8, axis=1)])
BEGINS = np.concatenate([BEGINS, np.ones((8, 8), bool)])


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or MID (white space) of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = NUMBER
    table[SPACES] = MID
    return table


def symbols(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbol of every character of some joined texts; ``first`` are the texts' first positions."""
    n = len(codes)
    kind = classes()[codes]
    starts = np.zeros(n + 1, bool)
    starts[first] = True
    starts[n] = True
    # Characters one and two ahead in the same text; 0 past its end.
    one = np.append(codes[1:], 0)
    one[starts[1:]] = 0
    two = np.append(one[1:], 0)
    two[starts[1:]] = 0
    space = kind == MID
    followed = np.append(~space[1:], False) & ~starts[1:]
    kind[space & followed] = LAST
    kind[space & followed & (codes == 32)] = BLANK
    quote = codes == ord("'")
    kind[quote & np.isin(one, [ord(c) for c in "stmd"])] = SHORT
    for a, b in ("re", "ve", "ll"):
        kind[quote & (one == ord(a)) & (two == ord(b))] = LONG
    return kind + np.where(starts[:n], 8, 0).astype(np.uint8)


def slice_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a slice begins, by character."""
    n = len(codes)
    if not n:
        return np.zeros(0, bool)
    width = max(16, int(n**0.5))
    count = -(-n // width)
    padded = np.zeros(count * width, np.uint8)
    padded[:n] = symbols(codes, first)
    columns = np.ascontiguousarray(padded.reshape(count, width).T).astype(np.intp) * 8
    after, begins = AFTER.ravel(), BEGINS.ravel()
    whole = np.tile(np.arange(8, dtype=np.uint8), (count, 1))  # each chunk's function, composed so far
    for column in columns:
        whole = after[column[:, None] + whole]
    state = np.zeros(count, np.uint8)
    for i in range(1, count):
        state[i] = whole[i - 1, state[i - 1]]
    marks = np.zeros((width, count), bool)
    for j, column in enumerate(columns):
        at = column + state
        marks[j], state = begins[at], after[at]
    return marks.T.ravel()[:n]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the pair of lowest rank, leftmost first, is joined until none is known."""
    n = len(piece)
    if piece in ranks:
        return [ranks[piece]]
    return _merge_short(piece, ranks) if n <= CACHE_PIECE else _merge_long(piece, ranks)


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    get, none = ranks.get, len(ranks) + 1_000_000
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (best := min(pairs)) < none:
        i = pairs.index(best)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in n log n for slices without a break, however long."""
    n = len(piece)
    after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
    end = [*range(1, n + 1)]
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two has been joined otherwise since
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Pieces(dict):
    """Slice -> its ids as little-endian 32-bit integers; forgets everything when full."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        ids = merge(piece, self.ranks)
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHE_PIECE:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


# Kept for the life of a worker, by vocabulary: tasks find the cache warm.
_PIECES: dict[str, Pieces] = {}


def encode_texts(texts: Sequence[str | None], pieces: Pieces) -> list[bytes]:
    """Ids of every text, as little-endian 32-bit integers."""
    held = [t or "" for t in texts]
    codes = np.frombuffer("".join(held).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) for t in held], dtype=np.int64)
    first = np.array([e - len(t) for t, e in zip(held, ends, strict=True) if t], np.int64)
    at = np.flatnonzero(slice_starts(codes, first))
    octets = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), dtype=np.int64)])
    cuts = np.searchsorted(at, ends)  # slices before each text's end
    offsets = octets[at]
    out, low = [], 0
    for text, end, high in zip(held, ends, cuts, strict=True):
        raw, base = text.encode(), octets[end - len(text)]
        edge = [*(offsets[low:high] - base).tolist(), len(raw)]
        out.append(b"".join([pieces[raw[a:b]] for a, b in zip(edge, edge[1:], strict=False)]))
        low = high
    return out


def _ranks_of(spark: SparkSession, path: str):
    """The vocabulary as a broadcast: its size is that of one public rank file, not of the data."""
    return spark.sparkContext.broadcast(read_ranks(path))


def decode_ids(packed: Sequence[bytes | None], tokens: dict[int, bytes]) -> list[bytes]:
    return [b"".join(map(tokens.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in packed]


def encode(
    docs: DataFrame, ranks: str, keep: Sequence[str] = ("doc_id",), text: str = "text", decoded: str | None = None,
) -> DataFrame:
    """``keep`` columns with n_tokens, ids and starts of every whole text.

    ``ids`` are little-endian unsigned 32-bit integers; ``starts`` in the same
    form give the byte of the text at which each token begins, so any range of
    tokens can be decoded to a place in the text. With ``decoded`` a column of
    that name holds what the ids decode to, found in the same pass. NULL and
    empty texts have no tokens. Texts of any length are encoded whole. Rows that
    repeat get the same ids each, of pairs of one rank the first is merged, and
    an empty table stays empty. ``keep`` must not have the new names.
    """
    shared = _ranks_of(docs.sparkSession, ranks)

    def work():
        pieces = _PIECES.setdefault(ranks, Pieces(shared.value))
        size = np.zeros(max(shared.value.values(), default=0) + 1, np.int64)
        for token, i in shared.value.items():
            size[i] = len(token)

        def run(texts):
            ids = encode_texts(texts, pieces)
            starts = []
            for x in ids:
                long = np.cumsum(size[np.frombuffer(x, "<u4")])
                starts.append(np.concatenate([[0], long[:-1]]).astype("<u4").tobytes() if len(long) else b"")
            out = [[len(x) // 4 for x in ids], pa.array(ids, pa.binary()), pa.array(starts, pa.binary())]
            return [*out, pa.array(decode_ids(ids, tokens), pa.binary())] if decoded else out

        tokens = {i: token for token, i in shared.value.items()} if decoded else {}
        return run

    fields = "n_tokens bigint, ids binary, starts binary" + (f", `{decoded}` binary" if decoded else "")
    return add_from_text(docs, work, fields, keep, text, 1_000_000)


def decode(encoded: DataFrame, ranks: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns plus the bytes that the ids of ``encode`` stand for (NULL ids: empty)."""
    shared = _ranks_of(encoded.sparkSession, ranks)

    def work():
        tokens = {i: token for token, i in shared.value.items()}

        def run(packed):
            return [pa.array(decode_ids(packed, tokens), pa.binary())]

        return run

    return add_from_text(encoded, work, f"`{into}` binary", encoded.columns, ids, 2_000_000)
