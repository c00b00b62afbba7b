"""The manifest against plain Python, over tables of many sizes and groups."""

import hashlib
import zlib

import pytest

from setwise.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, root int"


def hashed(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row, more=0):
    doc_id, text, lang, source, n_chars = row[:5]
    values = (doc_id, source, lang, None if n_chars is None else n_chars + more, text)
    return hashed("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_of(level):
    levels = [level]
    while len(levels[-1]) > 1:
        held = levels[-1]
        levels.append([hashed("".join(held[i : i + 2])) for i in range(0, len(held), 2)])
    return levels


def fold(levels, at, now):
    proof = []
    for level in levels[:-1]:
        beside = level[at ^ 1] if at ^ 1 < len(level) else None
        now = hashed(now if beside is None else beside + now if at % 2 else now + beside)
        proof += [beside] if beside else []
        at //= 2
    return now, proof


def manifest_by_force(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {g: tree_of([leaf_of(r) for r in groups[g]]) for g in names}
    top = tree_of([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now, low = fold(trees[g], i, leaf_of(r, int(hit)))
            now, high = fold(top, k, now)
            root = top[-1][0]
            out.append((r[0], leaf_of(r), trees[g][-1][0], root, hashed("".join(low + high)), now, now == root))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r))


def table(n, langs):
    rows = [(i * 37 % 1009, f"text {i} é", f"l{i % langs}" if i % langs else None, f"s{i % 3}" if i % 5 else None, None if i % 11 == 0 else i, "x", i) for i in range(n)]
    return rows


@pytest.mark.parametrize(("n", "langs", "height", "run"), [(1, 1, 9, 4096), (9, 9, 2, 8), (65, 3, 2, 8), (300, 70, 9, 4096)])
def test_against_force(spark, n, langs, height, run):
    rows = table(n, langs)
    found = merkle.prove(spark.createDataFrame(rows, SCHEMA), merkle.with_count_raised(), height=height, run=run)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert ordered(found.collect()) == ordered(manifest_by_force(rows))


def test_edge_rows(spark):
    long = "word " * 300_000
    rows = [
        (None, None, None, None, None, None, None), (None, "no key", "en", None, 5, "x", 1), (1, "", "en", "", 2**63 - 1, "x", 1),
        (2, "same", "en", "a", 4, "x", 1), (2, "same", "en", "a", 4, "y", 2), (2, "other", "en", "a", 5, "x", 1), (3, long, "ü", "a", len(long), "x", 1),
        (-7, "below zero", "", "a", -1, "x", 1),
    ]
    found = merkle.prove(spark.createDataFrame(rows, SCHEMA), merkle.with_count_raised(), height=2, run=2).collect()
    assert ordered(found) == ordered(manifest_by_force(rows))
    same = [r for r in found if r.doc_id == 2 and r.leaf == leaf_of(rows[3])]
    assert len(same) == 2
    assert merkle.prove(spark.createDataFrame([], SCHEMA)).collect() == []


def test_untampered_rows_verify(spark):
    assert all(r.verified for r in merkle.prove(spark.createDataFrame(table(100, 4), SCHEMA)).collect())


def test_every_key_of_the_climb_is_bounded(spark):
    """A row high in the tree is stored for every run of leaves below it, none with more than a run's leaves."""
    rows = spark.createDataFrame(table(300, 2), SCHEMA)
    held = []
    tables = merkle.Scratch.table
    merkle.Scratch.table = lambda self, df, name: held.append((name, tables(self, df, name))) or held[-1][1]
    try:
        merkle.prove(rows, height=2, run=8)
    finally:
        merkle.Scratch.table = tables
    nodes = dict(held)["nodes"]
    assert nodes.groupBy("id", "run").count().where("count > 1").count() == 0
    assert nodes.count() <= nodes.select("id").distinct().count() + 300 / 8 * 8
