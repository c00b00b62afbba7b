import random

import pytest

from setwise.operators import graph


def reach(edges):
    """Reachable blocked nodes per node, by walking each node's blockers."""
    up = dict(edges)
    below = {n: set() for n in up}
    for n in up:
        seen, at = {n}, up[n]
        while at in up and at not in seen:
            below[at].add(n)
            seen.add(at)
            at = up[at]
    return {n: len(b) for n, b in below.items()}


def counts(make, edges):
    df = make(edges, "id int, by int")
    return {r.id: r.n for r in graph.descendant_count(df, "id", "by", "n").collect()}


@pytest.mark.parametrize("edges, want", [
    ([(1, None), (2, 1), (3, 2)], {1: 2, 2: 1, 3: 0}),
    ([(1, None), (2, 1), (3, 1)], {1: 2, 2: 0, 3: 0}),
    ([(1, 2), (2, 1)], {1: 1, 2: 1}),
    ([(1, 1)], {1: 0}),
    ([(1, 77), (2, 1)], {1: 1, 2: 0}),
    ([(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (6, None), (7, 6)], {1: 4, 2: 4, 3: 4, 4: 1, 5: 0, 6: 1, 7: 0}),
])
def test_descendant_count(make, edges, want):
    assert counts(make, edges) == want


def test_random_forest_with_circles(make):
    rnd = random.Random(5)
    edges = [(i, rnd.choice([None, *range(30)])) for i in range(30)]
    assert counts(make, edges) == reach(edges)


def test_deep_chain_and_star(make):
    chain = [(i, i - 1 if i else None) for i in range(300)]
    assert counts(make, chain) == {i: 299 - i for i in range(300)}
    star = [(i, 0 if i else None) for i in range(300)]
    assert counts(make, star)[0] == 299


def test_several_blockers(make):
    edges = [(53, 51), (53, 52), (52, 51), (51, None), (60, 61), (61, 60), (61, 53), (70, 99)]
    found = graph.descendant_count(make(edges, "id int, by int"), "id", "by")
    assert {r.id: r.blocked_count for r in found.collect()} == {51: 4, 52: 3, 53: 2, 60: 1, 61: 1, 70: 0}


def counts_by_force(edges):
    up = {}
    for n, b in edges:
        up.setdefault(n, set()).add(b)
    below = {n: set() for n in up}
    for n in up:
        seen, todo = {n}, [n]
        while todo:
            for b in up[todo.pop()]:
                if b in up and b not in seen:
                    seen.add(b)
                    todo.append(b)
        for b in seen - {n}:
            below[b].add(n)
    return {n: len(x) for n, x in below.items()}


def several(make, edges):
    found = graph.descendant_count(make(edges, "id int, by int"), "id", "by", "n").collect()
    return {r.id: r.n for r in found}


@pytest.mark.parametrize("seed", (0, 3))
def test_random_graphs(make, seed):
    """Trees, circles, circles through nodes with several blockers, and paths that join again."""
    rnd = random.Random(seed)
    size = 40
    edges = [(i, None) for i in range(size) if rnd.random() < 0.2]
    for i in range(size):
        for _ in range(rnd.choice((1, 1, 1, 1, 2, 3)) if seed else 1):
            edges.append((i, rnd.randrange(i) if i and rnd.random() < (0.9 if seed else 1) else rnd.randrange(size)))
    assert several(make, edges) == counts_by_force(edges)


def test_one_node_with_two_blockers_in_a_chain(make, monkeypatch):
    """The rest of the chain stays at one row a node."""
    held = []
    store = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label="stage": held.append((label, store(df, label))) or held[-1][1])
    monkeypatch.setattr(graph, "release", lambda df: None)
    edges = [(i, i - 1 if i else None) for i in range(300)] + [(200, 100)]
    assert several(make, edges) == {i: 299 - i for i in range(300)}
    assert max(df.count() for _, df in held) <= 301


def test_every_node_waits_for_two_others(make, monkeypatch):
    """Nodes are held with what they reach as one row: nothing stored grows with the reachable pairs."""
    held = []
    store = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label="stage": held.append((label, store(df, label))) or held[-1][1])
    monkeypatch.setattr(graph, "release", lambda df: None)
    edges = [(i, up) for i in range(1, 400) for up in (i // 2, i // 3)]
    want = counts_by_force(edges)
    assert dict(several(make, edges)) == want
    most = max(df.count() for _, df in held)
    assert most <= 3 * 400 < sum(want.values()) / 3


def test_long_ways_and_circles_of_branching_nodes(make, monkeypatch):
    """Over the number of levels, and on circles, pairs are followed as before; arrays in parts hold the same places."""
    edges = [(i, up) for i in range(9) for up in (i - 1, i - 2)]
    turning = edges + [(0, 5), (10, 8), (10, 3), (11, 10), (11, 2)]
    monkeypatch.setattr(graph, "LEVELS", 3)
    assert several(make, edges) == counts_by_force(edges)
    monkeypatch.setattr(graph, "LEVELS", 40)
    monkeypatch.setattr(graph, "PLACES", 4)
    assert several(make, turning) == counts_by_force(turning)


def test_ways_that_join(make):
    edges = [(4, 2), (4, 3), (2, 1), (3, 1), (1, None), (5, 4), (6, 4), (7, 3), (7, 5)]
    assert several(make, edges) == counts_by_force(edges) == {1: 6, 2: 4, 3: 4, 4: 3, 5: 1, 6: 0, 7: 0}


def test_chase_missing(make, rows):
    table = make([(1, None), (2, 1), (3, 2), (4, 3), (5, 9), (6, 7), (7, 6), (8, None)], "id int, by int")
    chased = lambda seeds: [r[0] for r in rows(graph.chase_missing(make([(s,) for s in seeds], "id int"), table, "id", "by").select("id"))]
    assert chased([4]) == [1, 2, 3, 4]
    assert chased([3, 5]) == [1, 2, 3, 5]
    assert chased([6]) == [6, 7]
    assert chased([]) == []
