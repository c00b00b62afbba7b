"""Alignment against a merge written out in plain Python."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from setwise.llm import alignment, queries, store

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, n_a string, chunk int"


def groups_by_force(texts):
    a_coder, b_coder = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_coder.encode_special_tokens = True
    letters = alignment._byte_letters()
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        a_ids, b_ids = a_coder.encode(" " + text, add_special_tokens=False).ids, b_coder.encode(text)
        a = [(i, bytes(letters[c] for c in a_coder.id_to_token(i))) for i in a_ids]
        b = [(i, bytes.fromhex(p[3:5]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()) for i, p in zip(b_ids, b_coder.id_to_piece(b_ids), strict=True)]
        whole = (" " + text).encode()
        if b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
            out.append(None)
            continue
        groups, x, y, at_x, at_y, now = [], 0, 0, 0, 0, ([], [])
        while x < len(a) or y < len(b):
            if at_x <= at_y:
                now[0].append(a[x][0])
                at_x, x = at_x + len(a[x][1]), x + 1
            else:
                now[1].append(b[y][0])
                at_y, y = at_y + len(b[y][1]), y + 1
            if at_x == at_y:
                groups.append(now)
                now = ([], [])
        out.append(groups)
    return out


def aligned_by_force(rows):
    found = groups_by_force([t for _, t in rows])
    counts = collections.Counter(p for g in found if g for p in {(a, b) for x, y in g for a in x for b in y})
    most = collections.Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for (key, _), groups in zip(rows, found, strict=True):
        if groups is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(a, b) for x, y in groups for a in x for b in y]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((key, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
                    sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest()))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r))


ODD = [
    None, "", " ", "  ", "\n", "plain words", "plain words", "<|endoftext|> <s></s><unk> <0x41>", "naïve café ﬁne ½", "語言模型 🙂🙃", "▁low",
    "áë", "tab\tand  double   spaces", "​﻿zero", "x" * 5000, "ab" * 3000, "12345678901234567890", "🏳️‍🌈" * 50, "word " * 4000, "\x00\x01\x7f",
]


@pytest.mark.parametrize(("piece", "chunk", "most"), [(16_384, 8_000_000, 4_000_000), (7, 3000, 11)])
def test_against_force(spark, piece, chunk, most):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(5, "plain words"), (None, "plain words"), (5, "other words")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert ordered(alignment.align(docs, A, B, piece=piece, chunk_bytes=chunk, most=most).collect()) == ordered(aligned_by_force(rows))


@pytest.mark.parametrize("row", [1, 7, 100])
def test_rows_of_a_chunk(spark, row):
    rows = [(i, t) for i, t in enumerate(ODD) if len(t or "") < 4000] + [(5, "plain words"), (None, "plain words")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert ordered(alignment.align(docs, A, B, row=row).collect()) == ordered(aligned_by_force(rows))


def test_stored_rows_and_row_groups_are_bounded(spark, monkeypatch):
    """One task's documents: no stored row holds a chunk's whole lists, no row group all rows."""
    stored, table = {}, store.Scratch.table

    def kept(self, df, name, **options):
        stored[name] = table(self, df, name, **options)
        return stored[name]

    monkeypatch.setattr(store.Scratch, "table", kept)
    rng = random.Random(7)
    rows = [(i, " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(30))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    want = ordered(aligned_by_force(rows))
    assert ordered(alignment.align(docs, A, B).collect()) == want
    sizes = stored["chunks"].select(*[F.max(F.size(c)) for c in ("docs", "pairs", "held", "place", "times")], F.sum(F.size("place")), F.count("*")).first()
    assert sizes[5] > 2 * alignment.ROW and sizes[6] > 2
    assert max(sizes[1:5]) <= alignment.ROW and sizes[0] <= alignment.ROW // alignment.DOC_LINKS
    monkeypatch.setattr(alignment, "GROUP_BYTES", 10_000)
    assert ordered(alignment.align(docs, A, B, row=64).collect()) == want
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in stored["chunks"].inputFiles()]
    rows_in = [m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)]
    assert sum(rows_in) > 400 and max(rows_in) <= 200


def test_chunks_of_short_texts_are_bounded(spark, monkeypatch):
    stored, table = {}, store.Scratch.table

    def kept(self, df, name, **options):
        stored[name] = table(self, df, name, **options)
        return stored[name]

    monkeypatch.setattr(store.Scratch, "table", kept)
    before = spark.conf.get(store.ARROW_ROWS[0], None)
    docs = spark.range(40_000).coalesce(1).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "ab").alias("text"))
    found = alignment.align(docs, A, B).groupBy("n_best", "count_sum").count().collect()
    links = sum(len(a) * len(b) for a, b in groups_by_force(["ab"])[0])
    held = sum(i % 3 > 0 for i in range(40_000))
    assert sorted(map(tuple, found)) == [(0, 0, 40_000 - held), (links, links * held, held)]
    assert spark.conf.get(store.ARROW_ROWS[0], None) == before
    sizes = [r.n for r in stored["chunks"].groupBy("chunk").agg(F.sum(F.size("docs")).alias("n")).collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= alignment.CHUNK_BYTES // alignment.DOC_BYTES + 500


def test_smallest_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert ordered(queries.QUERIES["op12_token_alignment"](spark, "/root/testdata/sf0.001").collect()) == ordered(aligned_by_force(rows))


def test_groups_as_text(spark):
    found = alignment.align(spark.createDataFrame([(1, "tokenizers align")], "doc_id bigint, text string"), A, B, groups=True).first()
    want = groups_by_force(["tokenizers align"])[0]
    assert found.groups == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in want)
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B).collect() == []


@pytest.mark.parametrize("piece", [1, 2, 3, 10, 1000])
def test_pieces_of_the_merge_path(piece):
    rng = random.Random(piece)
    for _ in range(50):
        a = np.array(sorted(rng.sample(range(200), rng.randrange(0, 90))), np.int64)
        b = np.array(sorted(rng.sample(range(200), rng.randrange(0, 90))), np.int64)
        at_a, at_b = alignment.common_ends(a, b, piece)
        assert a[at_a].tolist() == b[at_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        cut_a, cut_b = alignment.path_cuts(a, b, piece)
        assert max(np.diff(cut_a) + np.diff(cut_b), default=0) <= piece


def test_both_encoders_of_one_vocabulary(spark):
    """Every settled character in several surroundings, and the smallest table's texts."""
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2 {chr(c)}'s\n{chr(c)}  {chr(c)}" for c in range(0x500)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text] + [" " * 600, "x" + "\n" * 499]
    slow = Tokenizer.from_file(A)
    slow.encode_special_tokens = True
    assert alignment.byte_level(A).encode(texts) == [e.ids for e in slow.encode_batch([f" {t}" for t in texts], add_special_tokens=False)]
    assert alignment._ranked(A, alignment.byte_level(A).tokens) is not None
    assert [alignment._SETTLED.fullmatch(t) is not None for t in ("plain\nÄ", "語", " " * 600, "")] == [True, False, False, True]
