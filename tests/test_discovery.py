"""Keys and references found from the data, against plain Python."""

import itertools
import random

import pytest

from setwise.operators import discovery
from setwise.operators.documentation import keyless_tables


def keys_by_force(rows, names, widest):
    found = []
    for width in range(1, widest + 1):
        for c in itertools.combinations(range(len(names)), width):
            whole = all(r[i] is not None for r in rows for i in c)
            if whole and len({tuple(r[i] for i in c) for r in rows}) == len(rows) and not any(set(k) < set(c) for k in found):
                found.append(c)
    return {",".join(names[i] for i in c) for c in found}


@pytest.mark.parametrize(("seed", "witnesses"), [(1, 1000), (2, 5), (3, 2)])
def test_key_sets_against_force(make, seed, witnesses):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(6), rnd.choice("abcd"), rnd.randrange(4) * 0.5, None if rnd.random() < 0.02 else i, [rnd.randrange(3)]) for i in range(40)]
    rows = list({(r[0], r[1], r[2], r[4][0]): r for r in rows}.values())
    tables = {"t": make(rows, "a int, b string, c double, d int, e array<int>"), "two": make([(1, 1), (1, 2), (2, 1)], "x int, y int"),
              "none": make([], "x int, y int"), "twice": make([(1, 1), (1, 1)], "x int, y int"), "one": make([(7, None)], "x int, y int")}
    got = {}
    for r in discovery.candidate_key_sets(tables, widest=4, witnesses=witnesses).collect():
        got.setdefault(r.table_name, set()).add(r.key_columns)
        assert r.n_columns == r.key_columns.count(",") + 1
    hashable = [(a, b, c, d, tuple(e)) for a, b, c, d, e in rows]
    assert got.get("t", set()) == keys_by_force(hashable, "abcde", 4)
    assert got["two"] == {"x,y"} and got["none"] == {"x", "y"} and "twice" not in got and got["one"] == {"x"}


def test_a_repeat_anywhere_rules_a_key_out(make, rows):
    """One pair of equal values among many rows, out of sight of the rows looked at first."""
    big = make([(i if i < 4999 else 17, i) for i in range(5000)], "a int, b int")
    assert rows(keyless_tables({"big": big.select("a"), "fine": big})) == [("big",)]
    assert discovery.unique_columns({"big": big}) == {"big": ["b"]}


def test_inclusions_against_force(make):
    rnd = random.Random(4)
    tables, held = {}, {}
    for n in range(12):
        names = [f"c{n}_{i}" for i in range(6)]
        rows = [tuple(None if rnd.random() < 0.1 else rnd.randrange(rnd.choice((2, 4, 30))) for _ in names) for _ in range(20)]
        tables[f"t{n}"] = make(rows, ", ".join(f"{c} {'bigint' if i % 2 else 'int'}" for i, c in enumerate(names)))
        for i, c in enumerate(names):
            held[f"t{n}", c] = {r[i] for r in rows} - {None}
    tables["s"] = make([("1", 1.0), ("2", None)], "s string, d double")
    got = {(r.child, r.child_column, r.parent, r.parent_column) for r in discovery.inclusions(tables).collect()}
    assert got == {(*a, *b) for a, x in held.items() for b, y in held.items() if a != b and x and x <= y}


def test_parent_is_key(make):
    tables = {"child": make([(1,), (2,), (2,), (None,)], "k int"), "parent": make([(1, 1), (2, 1), (3, 2)], "id bigint, g int")}
    got = {(r.child_column, r.parent_column): r.parent_is_key for r in discovery.inclusions(tables).collect()}
    assert got == {("k", "id"): True, ("k", "g"): False, ("g", "k"): False, ("g", "id"): True}


def test_repeats_out_of_sight_are_not_counted_whole(make, monkeypatch):
    """Columns and pairs with many repeats are ruled out by a slice of their values; only what may be a key is counted."""
    counted, whole = [], discovery._distinct

    def recorded(held, wanted):
        counted.extend(c for combinations in wanted.values() for c in combinations)
        return whole(held, wanted)

    monkeypatch.setattr(discovery, "_distinct", recorded)
    t = make([(i, i % 4000, f"n{i % 4000}", float(i % 2500)) for i in range(8000)], "a int, b int, c string, d double")
    found = {r.key_columns for r in discovery.candidate_key_sets({"t": t}, widest=2, witnesses=5).collect()}
    assert found == {"a", "b,d", "c,d"}
    assert set(counted) == {(0,), (1, 3), (2, 3)}
