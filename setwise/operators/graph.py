"""Reach and closure over "is blocked by" edges, in logarithmically many rounds.

Where a node waits for one other at most, following the edge is a function.
Each round joins that function with itself, doubling the distance it spans:
a chain of a million nodes takes twenty rounds, and no round holds more than
one row per node. Nodes that wait for several others are cut off as roots of
trees of their own; pairs are formed between such nodes and the places where
their blockers enter a tree, and along a tree's path only where several enter
the same tree. Where no way passes many branching nodes, a node's places are
one array, put together level by level from those of the nodes it waits for.
Rounds are stored in the shared folder, so lineage stays short and a lost
executor re-reads instead of re-running the rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from setwise.session import materialize, release

LEVELS = 40  # branching nodes on one way that are still followed level by level
PLACES = 1 << 22  # places that one array may hold


def _double(jumps: DataFrame) -> DataFrame:
    """Follow each jump twice."""
    further = jumps.select(F.col("node").alias("__via"), F.col("up").alias("__up"))
    return jumps.join(further, jumps["up"] == further["__via"], "left").drop("__via")


def descendant_count(nodes: DataFrame, node: str, blocked_by: str, name: str = "blocked_count") -> DataFrame:
    """Per node, how many others wait for it directly or through others.

    Input has a row per node and node it waits for, or NULL. Blockers that are
    not nodes themselves are ignored. Nodes waiting in a circle each count the
    others of the circle and everything behind it, once however many ways there
    are.
    """
    pairs = nodes.select(F.col(node).alias("node"), F.col(blocked_by).alias("up")).distinct()
    known = pairs.select(F.col("node").alias("__n")).distinct()
    edges = materialize(pairs.join(known, pairs["up"] == known["__n"], "left_semi").where("node <> up"), "edges")
    weights = known.select(F.col("__n").alias("node"), F.lit(1).cast("bigint").alias("weight"))
    graph = _Graph.of(weights, edges)

    place = None  # node -> the node that stands for its circle
    if graph.circles is not None:
        on_circle = graph.circles.select(F.col("up").alias("node")).distinct()
        place = _circle_ids(graph.forest.join(on_circle, "node", "left_semi"), graph.rounds)
        weights, edges = _condensed(weights, edges, place)
        graph = _Graph.of(weights, edges)
    entries = graph.entries_by_level()
    if entries is None and graph.several is not None:
        reach = graph.branches_reached()
        turning = _turning_groups(graph, reach)
        if turning is not None:
            weights, edges = _condensed(weights, edges, turning)
            place = turning if place is None else _chained(place, turning)
            graph = _Graph.of(weights, edges)
            entries = graph.entries_by_level()
            reach = graph.branches_reached() if entries is None else None
        if reach is not None:
            entries = graph.entries_of(reach)
    total = graph.totals(entries)
    if place is not None:
        stands = known.select(F.col("__n").alias("node")).join(place, "node", "left").select("node", F.coalesce("circle", "node").alias("__at"))
        total = stands.join(total.withColumnRenamed("node", "__at"), "__at")
    return _attach(nodes, node, total.select("node", (F.col("total") - 1).alias("below")), name)


class _Graph:
    """Weighted nodes and the edges to what they wait for, split into a forest and the edges of nodes that wait for several."""

    def __init__(self, weights: DataFrame, forest: DataFrame, several: DataFrame | None, trees: DataFrame, circles: DataFrame | None, rounds: int):
        self.weights, self.forest, self.several, self.trees, self.circles, self.rounds = weights, forest, several, trees, circles, rounds

    @classmethod
    def of(cls, weights: DataFrame, edges: DataFrame) -> _Graph:
        counted = edges.groupBy("node").agg(F.count(F.lit(1)).alias("n_up"), F.min("up").alias("one"))
        forest = materialize(weights.join(counted, "node", "left").select(
            "node", F.when(F.col("n_up") == 1, F.col("one")).alias("up"), "weight", (F.col("n_up") > 1).alias("branches")), "forest")
        size, branching = forest.agg(F.count(F.lit(1)), F.count_if("branches")).first()
        rounds = max(size, 1).bit_length()
        trees, circles = _subtree_sums(forest.select("node", "up", F.col("weight").alias("below")), rounds)
        several = edges.join(forest.where("branches").select("node"), "node", "left_semi") if branching else None
        return cls(weights, forest, several, trees, circles, rounds)

    def _entered(self) -> DataFrame:
        """(node, up): branching nodes and the branching roots of the trees their blockers are in."""
        roots = self.forest.where("branches").select(F.col("node").alias("top"))
        tops = self.trees.select(F.col("node").alias("up"), "top")
        return self.several.join(tops, "up").join(roots, "top", "left_semi").select("node", F.col("top").alias("up"))

    def branches_reached(self) -> DataFrame | None:
        """(node, up): branching nodes and the branching roots of the trees they get into, directly or through others."""
        return None if self.several is None else _closure(self._entered())

    def entries_of(self, reach: DataFrame) -> DataFrame:
        """(b, w, entry): branching nodes, their weights and the places where they get into trees, from the pairs of ``branches_reached``."""
        starts = self.several.select(F.col("node").alias("via"), F.col("up").alias("entry"))
        steps = reach.select(F.col("node").alias("b"), F.col("up").alias("via"))
        steps = steps.union(self.forest.where("branches").select(F.col("node").alias("b"), F.col("node").alias("via")))
        return steps.join(starts, "via").select("b", "entry").distinct().join(self.trees.select(F.col("node").alias("b"), F.col("below").alias("w")), "b")

    def entries_by_level(self) -> DataFrame | None:
        """What ``entries_of`` gives; None without branching nodes, with circles through them, or if over ``LEVELS`` are on one way.

        The places of a node are its blockers and the places of the roots above these. A level is worked on when all it waits
        for is known, so an array goes over each edge once, and no pair is found by more ways than its node has blockers.
        """
        if self.several is None:
            return None
        edges = materialize(self._entered().distinct(), "entered")
        heights = _heights(edges, self.forest.where("branches").select("node"), LEVELS)
        if heights is None:
            release(edges)
            return None
        above = heights.select(F.col("node").alias("up"), F.col("height").alias("up_height"))
        heights = heights.join(self.trees.select("node", F.col("below").alias("w")), "node")
        placed = materialize(edges.join(heights, "node").join(above, "up"), "entered")
        release(edges)
        needs: dict[int, list[int]] = {}
        for height, up_height in placed.select("height", "up_height").distinct().collect():
            needs.setdefault(height, []).append(up_height)
        parts = -(-self.several.select("up").distinct().count() // PLACES)
        own = materialize(self.several.join(heights, "node").groupBy(
            "node", "w", "height", F.pmod(F.xxhash64("up"), F.lit(parts)).alias("part")).agg(F.collect_set("up").alias("places")), "own")
        held: dict[int, DataFrame] = {}
        for height in range(own.agg(F.max("height")).first()[0], -1, -1):
            level = own.where(F.col("height") == height).select("node", "w", "part", "places")
            for up_height in needs.get(height, ()):
                known = held[up_height].select(F.col("node").alias("up"), "part", "places")
                waits = placed.where((F.col("height") == height) & (F.col("up_height") == up_height)).select("node", "w", "up")
                level = level.union(waits.join(known, "up").select("node", "w", "part", "places"))
            if height in needs:
                level = level.groupBy("node", "w", "part").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
            held[height] = materialize(level, "places")
        return reduce(DataFrame.union, held.values()).select(F.col("node").alias("b"), "w", F.explode("places").alias("entry"))

    def totals(self, entries: DataFrame | None) -> DataFrame:
        """(node, total): the weight of each node and of all that wait for it; the graph has no circles."""
        if entries is None:
            return self.trees.select("node", F.col("below").alias("total"))
        behind = self.trees.select(F.col("node").alias("b"), F.col("below").alias("w"))
        # A tree entered once counts all that comes in by adding it where it enters: the sums over subtrees carry it to the root.
        # Where several ways enter one tree their paths join, so every node of these paths is named once. Most trees have one
        # place to enter, and what enters there needs no look at the others.
        places = self.several.select(F.col("up").alias("entry")).distinct().join(self.trees.select(F.col("node").alias("entry"), "top"), "entry")
        wide = places.groupBy("top").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = materialize(places.join(wide, "top", "left_semi").select("entry", "top"), "shared")
        alone = entries.groupBy("entry").agg(F.sum("w").alias("w")).join(shared, "entry", "left_anti")
        placed = materialize(entries.join(shared, "entry"), "entries")
        ways = placed.groupBy("b", "top").agg(F.count(F.lit(1)).alias("ways"))
        alone = alone.union(placed.join(ways.where("ways = 1"), ["b", "top"], "left_semi").select("entry", "w"))
        once = alone.groupBy(F.col("entry").alias("node")).agg(F.sum("w").alias("more"))
        joining = placed.join(ways.where("ways > 1"), ["b", "top"], "left_semi").select(F.col("b").alias("tag"), F.col("entry").alias("node"))
        on_paths = _ancestors(joining, self.forest).join(behind, F.col("tag") == F.col("b")).groupBy("node").agg(F.sum("w").alias("direct"))
        valued = self.forest.join(once, "node", "left").select("node", "up", (F.col("weight") + F.coalesce("more", F.lit(0))).alias("below"))
        summed, _ = _subtree_sums(valued, self.rounds)
        return summed.join(on_paths, "node", "left").select("node", (F.col("below") + F.coalesce("direct", F.lit(0))).alias("total"))


def _heights(edges: DataFrame, nodes: DataFrame, most: int) -> DataFrame | None:
    """(node, height): how many edges (node, up) the longest way from below to a node has; None with circles or if over ``most``.

    Nodes that nobody waits for any more are taken off in rounds, and a round holds only the edges among those that are left.
    """
    left, size = edges, edges.count()
    floors = [nodes.select("node", F.lit(0).alias("height"))]
    while size:
        floors.append(materialize(left.select(F.col("up").alias("node")).distinct().withColumn("height", F.lit(len(floors))), "floor"))
        last, before = left, size
        left = materialize(last.join(floors[-1], "node", "left_semi").select("node", "up"), "waiting")
        size = left.count()
        if last is not edges:
            release(last)
        if size == before or len(floors) > most:
            return None
    return materialize(reduce(DataFrame.union, floors).groupBy("node").agg(F.max("height").alias("height")), "heights")


def _turning_groups(graph: _Graph, reach: DataFrame) -> DataFrame | None:
    """(node, circle) for nodes on circles that pass through branching nodes, or None without any.

    Branching nodes that reach each other are on a circle, and so are the paths by which one of them enters the tree of another.
    """
    back = reach.select(F.col("node").alias("up"), F.col("up").alias("node"))
    circle = materialize(reach.join(back, ["node", "up"], "left_semi").groupBy("node").agg(F.min("up").alias("circle")), "turning")
    if circle.isEmpty():
        return None
    of_top = circle.select(F.col("node").alias("top"), F.col("circle").alias("at_top"))
    inner = graph.several.join(circle, "node").join(graph.trees.select(F.col("node").alias("up"), "top"), "up").join(of_top, "top").where("circle = at_top")
    paths = _ancestors(inner.select(F.col("circle").alias("tag"), F.col("up").alias("node")), graph.forest)
    return materialize(paths.select("node", F.col("tag").alias("circle")).union(circle).distinct(), "turning")


def _condensed(weights: DataFrame, edges: DataFrame, place: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with one node for each circle."""
    heavy = weights.join(place, "node", "left").groupBy(F.coalesce("circle", "node").alias("node")).agg(F.sum("weight").alias("weight"))
    up = place.select(F.col("node").alias("up"), F.col("circle").alias("up_circle"))
    fewer = edges.join(place, "node", "left").join(up, "up", "left").select(
        F.coalesce("circle", "node").alias("node"), F.coalesce("up_circle", "up").alias("up")).where("node <> up").distinct()
    return materialize(heavy, "weights"), materialize(fewer, "edges")


def _chained(first: DataFrame, second: DataFrame) -> DataFrame:
    """Where nodes stand after both condensations."""
    later = second.select(F.col("node").alias("circle"), F.col("circle").alias("later"))
    moved = first.join(later, "circle", "left").select("node", F.coalesce("later", "circle").alias("circle"))
    return moved.union(second.join(first, "node", "left_anti"))


def _ancestors(seeds: DataFrame, forest: DataFrame) -> DataFrame:
    """(tag, node): the seeds and everything above them in a forest."""
    jumps = materialize(forest.select("node", "up"), "jumps")
    reached = materialize(seeds.distinct(), "paths")
    size = reached.count()
    while True:
        ahead = reached.join(jumps, "node").where("up is not null").select("tag", F.col("up").alias("node"))
        last, reached = reached, materialize(reached.union(ahead).distinct(), "paths")
        release(last)
        before, size = size, reached.count()
        if before == size:
            release(jumps)
            return reached
        last, jumps = jumps, materialize(_double(jumps).select("node", F.col("__up").alias("up")), "jumps")
        release(last)


def _attach(nodes: DataFrame, node: str, counted: DataFrame, name: str) -> DataFrame:
    return nodes.join(counted.select(F.col("node").alias(node), F.col("below").alias(name)), node)


def _closure(pairs: DataFrame) -> DataFrame:
    """(node, up) for everything a node gets to, directly or through others.

    A round puts what the last one found before all that is known, so distances
    double and no pair is put together twice; it ends when no pair is new, in
    circles too.
    """
    reach = materialize(pairs.distinct(), "closure")
    fresh = reach
    while not fresh.isEmpty():
        ahead = reach.select(F.col("node").alias("__via"), F.col("up").alias("__up"))
        more = fresh.join(ahead, F.col("up") == F.col("__via")).select("node", F.col("__up").alias("up")).distinct()
        found = materialize(more.join(reach, ["node", "up"], "left_anti"), "closure")
        grown = materialize(reach.union(found), "closure")
        release(fresh)
        release(reach)
        reach, fresh = grown, found
    return reach


def _subtree_sums(pairs: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame | None]:
    """(node, up, below, top): sums of ``below`` over each node's subtree, the root of its tree, and the jumps that never end, if any.

    After k rounds ``below`` covers the nodes less than 2^k steps behind, and
    ``up`` is the node 2^k steps ahead; what hangs off u's far end is added there.
    """
    state = pairs.withColumn("top", F.col("node"))
    if pairs.where("up is not null").isEmpty():
        return state, None
    for _ in range(rounds + 1):
        gained = state.where("up is not null").groupBy(F.col("up").alias("__to")).agg(F.sum("below").alias("__more"))
        ahead = state.select(F.col("node").alias("__via"), F.col("up").alias("__up"), F.col("top").alias("__top"))
        last, state = state, materialize(
            state.join(ahead, F.col("up") == F.col("__via"), "left").join(gained, F.col("node") == F.col("__to"), "left").select(
                "node", F.col("__up").alias("up"), (F.col("below") + F.coalesce("__more", F.lit(0))).alias("below"),
                F.coalesce("__top", "top").alias("top")), "reach")
        release(last)
        if state.where("up is not null").isEmpty():
            return state, None
    return state, state.where("up is not null")


def _circle_ids(circle: DataFrame, rounds: int) -> DataFrame:
    """The smallest node of each circle, beside each of its nodes."""
    state = circle.select("node", "up", F.col("node").alias("circle"))
    for _ in range(rounds):
        ahead = state.select(
            F.col("node").alias("__via"), F.col("up").alias("__up"), F.col("circle").alias("__other"))
        last, state = state, materialize(
            state.join(ahead, F.col("up") == F.col("__via"))
            .select("node", F.col("__up").alias("up"), F.least("circle", "__other").alias("circle")), "circles")
        release(last)
    return state.select("node", "circle")


def chase_missing(
    seeds: DataFrame, table: DataFrame, key: str, references: str,
) -> DataFrame:
    """Rows of ``table`` reached from the seed keys by following references until none is missing."""
    pairs = table.select(F.col(key).alias("node"), F.col(references).alias("up"))
    known = pairs.select(F.col("node").alias("__n"))
    jumps = materialize(pairs.join(known, pairs["up"] == known["__n"], "left").select("node", F.col("__n").alias("up")), "edges")
    reached = materialize(seeds.select(F.col(key).alias("node")).distinct(), "reached")
    size = reached.count()
    while True:
        # Everything 2^k steps ahead of what is reached: the set doubles its depth.
        ahead = reached.join(jumps, "node").where("up is not null").select(F.col("up").alias("node"))
        grown = materialize(reached.union(ahead).distinct(), "reached")
        release(reached)
        reached, last_size, size = grown, size, grown.count()
        if size == last_size:
            break
        last, jumps = jumps, materialize(_double(jumps).select("node", F.col("__up").alias("up")), "jumps")
        release(last)
    return table.join(reached.withColumnRenamed("node", key), key, "left_semi")


def reached_forward(seeds: DataFrame, pointers: DataFrame, stride: int = 4) -> DataFrame:
    """(node): the seeds and all they lead to over pointers (node, up) that never turn back; NULL ends a way.

    A level holds jumps ``stride`` times as long as the one before, and only for nodes that some jump of that one ends in:
    where ways join it is a fraction of it, and all levels together are little more than the pointers. Seeds move one jump
    a level, so the places found on a level and those that its jumps fill in between are all places after them.
    """
    first = seeds.select("node", F.lit(True).alias("first")).distinct()
    level = materialize(pointers.select("node", "up").distinct().join(first, "node", "left").select("node", "up", F.coalesce("first", F.lit(False)).alias("first")), "jumps")
    levels = [level]
    while not level.where("up is not null").isEmpty():
        ends = level.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.max("first").alias("first"))
        further = ends.withColumn("up", F.col("node"))
        for _ in range(stride):
            further = _stepped(further, level, "up", "up")
        level = materialize(further.select("node", "up", "first").distinct(), "jumps")
        levels.append(level)
    found = level.where("first").select("node").distinct()
    for level in reversed(levels[:-1]):
        places = [f"__at{i}" for i in range(stride)]
        between = found.select(F.col("node").alias(places[0]))
        for at, to in zip(places, places[1:]):
            between = _stepped(between, level, at, to)
        filled = between.select(F.explode(F.array_compact(F.array(*places))).alias("node"))
        found = materialize(filled.union(level.where("first").select("node")).distinct(), "reached")
    return found


def _stepped(rows: DataFrame, jumps: DataFrame, at: str, to: str) -> DataFrame:
    """Rows with ``to``, the end of the jump from ``at``; NULL where there is none."""
    ahead = jumps.where("up is not null").select(F.col("node").alias("__via"), F.col("up").alias("__up"))
    kept = [c for c in rows.columns if c != to]
    return rows.join(ahead, F.col(at) == F.col("__via"), "left").select(*kept, F.col("__up").alias(to))
