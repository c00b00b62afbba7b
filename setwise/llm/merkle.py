"""Merkle manifest of a table: leaves, trees by group, one root, and a proof climbed for every leaf.

A leaf is the digest of a row's fields. The leaves of a group are paired in the
order of their keys, level by level, down to one subroot; the subroots are
paired likewise, in the order of the groups, down to the root.

The tree is stored as node rows, each linked to its parent. A row covers HEIGHT
levels at once: the hashes of up to 2**HEIGHT consecutive children and of all
pairs above them. A recursive query ascends from every leaf over those links,
appending the siblings and folding the leaf's present digest, so that a leaf of
a tree of any size is at the root after levels / HEIGHT steps.

Every leaf passes the highest rows, so a row is stored once for each run of RUN
leaves below it and a leaf joins the copy of its own run: no join key has more
than RUN leaves. Leaves are numbered in range partitions, never in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from setwise.llm.store import Scratch, scratch

HEIGHT = 9
RUN = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# A leaf is numbered by its range partition and its place there.
_PLACE_BITS = 33


def digest(values: Sequence[Column]) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and itself, NULL as a dash."""
    said = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in (v.cast("string") for v in values)]
    return F.sha2(F.concat(*said), 256)


def _numbered(rows: DataFrame, order: Sequence[Column], tree: str, hold: Scratch) -> DataFrame:
    """``rows`` with g, their number in ``order`` over the whole table, and pos and n within their ``tree``, by which they are ordered first."""
    # The last order deals identical rows to several partitions; they are interchangeable.
    unnumbered = hold.table(rows, "unnumbered")
    order = [*order, F.col("tie")]
    ranged = unnumbered.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    ranged = hold.table(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged")
    hold.drop(unnumbered)
    stored = ranged.select(
        *rows.columns, F.shiftright("at", _PLACE_BITS).alias("part"), F.col("at").bitwiseAND((1 << _PLACE_BITS) - 1).alias("place"))
    # One row a partition.
    parts = stored.groupBy("part").agg(F.count("*").alias("held")).select(
        "part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("passed"))
    runs = stored.groupBy("part", tree).agg(F.min("place").alias("place"), F.count("*").alias("held")).join(F.broadcast(parts), "part")
    whole = runs.groupBy(tree).agg(F.min(F.col("passed") + F.col("place")).alias("first"), F.sum("held").alias("n"))
    places = runs.join(whole, tree).select("part", tree, "passed", "first", "n")
    # By partition and tree: a large tree is spread over as many keys as it has partitions.
    numbered = hold.table(stored.join(places, ["part", tree]).select(
        *rows.columns, (F.col("passed") + F.col("place")).alias("g"), (F.col("passed") + F.col("place") - F.col("first")).alias("pos"), "n"), "numbered")
    hold.drop(ranged)
    return numbered


def _id(kind: str, level: Column | int, block: Column, tree: Column) -> Column:
    return F.concat_ws("/", F.lit(kind), F.lit(level).cast("string"), block.cast("string"), tree)


def _levels(height: int) -> Column:
    """All levels above sorted ``hashes``: pairs are hashed ``rises`` times, an odd one at the end alone."""
    return F.expr(f"""aggregate(sequence(1, {height}), array(hashes), (held, k) -> CASE WHEN k > rises THEN held ELSE
      array_append(held, transform(sequence(0, (size(element_at(held, -1)) - 1) div 2), i -> unhex(sha2(lower(concat(
        hex(element_at(held, -1)[2 * i]), coalesce(hex(get(element_at(held, -1), 2 * i + 1)), ''))), 256)))) END)""")


def _grow(leaves: DataFrame, kind: str, height: int, hold: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node rows, one row a tree) over leaves (tree, pos, n, hash, lo, hi); lo and hi are the first and last number of the leaves below."""
    nodes, tops, level, now = None, None, 0, leaves
    while True:
        block = F.shiftright("pos", height)
        rows = now.groupBy("tree", "n", block.alias("block")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("met"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        whole = F.col("n") <= (1 << height)
        grown = hold.table(
            rows.withColumn("hashes", F.col("met.hash")).withColumn("rises", F.when(whole, F.ceil(F.log2("n"))).otherwise(height).cast("int"))
            .withColumn("levels", _levels(height)).select(
                _id(kind, level, F.col("block"), F.col("tree")).alias("id"), "tree", "block", "n", "lo", "hi", "levels", "rises",
                F.element_at(F.element_at("levels", -1), 1).alias("hash"),
                F.when(~whole, _id(kind, level + 1, F.shiftright("block", height), F.col("tree"))).alias("parent"),
                F.when(~whole, F.col("block").bitwiseAND((1 << height) - 1)).alias("slot")), f"{kind}-{level}")
        top = grown.where("parent IS NULL").select("tree", "hash", "lo", "hi", "id")
        nodes, tops = (grown, top) if nodes is None else (nodes.union(grown), tops.union(top))
        now = grown.where("parent IS NOT NULL").select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("n") / (1 << height)).alias("n"), "hash", "lo", "hi")
        level += 1
        if not now.take(1):
            return nodes, tops


def _climb_sql(height: int, run: int) -> str:
    path = f"""transform(filter(sequence(0, {height} - 1), k -> k < n.rises), k -> named_struct(
      'beside', get(n.levels[k], shiftright(c.slot, k) ^ 1), 'right', shiftright(c.slot, k) & 1 = 1))"""
    return f"""
WITH RECURSIVE climb (key, g, leaf, at, slot, hash, proof, subroot, root) AS (
  SELECT key, g, leaf, at, slot, start, X'', CAST(NULL AS BINARY), CAST(NULL AS BINARY) FROM {{leaves}}
  UNION ALL
  SELECT c.key, c.g, c.leaf, n.parent, n.slot,
    aggregate({path}, c.hash, (h, p) -> unhex(sha2(lower(CASE WHEN p.beside IS NULL THEN hex(h)
      WHEN p.right THEN concat(hex(p.beside), hex(h)) ELSE concat(hex(h), hex(p.beside)) END), 256))),
    aggregate({path}, c.proof, (held, p) -> concat(held, coalesce(p.beside, X''))),
    coalesce(c.subroot, n.subroot), n.root
  FROM climb c JOIN {{nodes}} n ON n.id = c.at AND n.run = c.g div {run})
SELECT key, leaf, subroot, root, unhex(sha2(lower(hex(proof)), 256)) AS proof, hash FROM climb WHERE at IS NULL"""


def _recursive(spark: SparkSession, sql: str, hold: Scratch, name: str, **views: DataFrame) -> DataFrame:
    """A recursive query's rows, stored: its number of rows is the table's, and Spark's limit on rows is lifted while it runs."""
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")
    try:
        return hold.table(spark.sql(sql, **views), name)
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)


def prove(
    docs: DataFrame, now: Column | None = None, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS,
    height: int = HEIGHT, run: int = RUN,
) -> DataFrame:
    """One row per document: key, leaf, subroot, root, proof_sha256, folded_root and verified.

    ``now`` is the digest a row has at present (by default the leaf itself); folding it with
    the siblings of the original tree gives ``folded_root``, and ``verified`` tells whether that is the root.
    NULL fields are dashes, empty and very long texts are digested whole. Groups are ordered as UTF-8 bytes and
    leaves by their key, NULL first; rows that repeat a key stand in the order of their leaves, and identical rows are
    interchangeable. An empty table has no root and gives no rows. Other columns are ignored.
    """
    spark, hold = docs.sparkSession, scratch(docs.sparkSession)
    leaf = digest([F.col(f"`{f}`") for f in fields])
    tree = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0"))
    rows = docs.select(
        F.col(f"`{key}`").alias("key"), tree.alias("tree"), F.unhex(leaf).alias("leaf"), F.unhex(leaf if now is None else now).alias("start"))
    leaves = _numbered(rows, [F.col("tree"), F.col("key").asc_nulls_first(), F.col("leaf")], "tree", hold)

    of_group, tops = _grow(leaves.select("tree", "pos", "n", F.col("leaf").alias("hash"), F.col("g").alias("lo"), F.col("g").alias("hi")), "g", height, hold)
    ranked = _numbered(tops.withColumn("one", F.lit("")), [F.col("one"), F.col("tree")], "one", hold)
    of_root, _ = _grow(ranked.select(F.lit("").alias("tree"), "pos", "n", "hash", "lo", "hi"), "r", height, hold)

    above = ranked.select(
        "id", _id("r", 0, F.shiftright("pos", height), F.lit("")).alias("up"), F.col("pos").bitwiseAND((1 << height) - 1).alias("up_slot"))
    linked = of_group.join(above, "id", "left").select(
        "id", "lo", "hi", "levels", "rises", F.coalesce("parent", "up").alias("parent"), F.coalesce("slot", "up_slot").alias("slot"),
        F.when(F.col("up").isNotNull(), F.col("hash")).alias("subroot"), F.lit(None).cast("binary").alias("root"))
    nodes = linked.union(of_root.select(
        "id", "lo", "hi", "levels", "rises", "parent", "slot", F.lit(None).cast("binary"), F.when(F.col("parent").isNull(), F.col("hash"))))
    nodes = hold.table(nodes.withColumn("run", F.explode(F.sequence(F.floor(F.col("lo") / run), F.floor(F.col("hi") / run)))).drop("lo", "hi"), "nodes")

    starts = leaves.select("key", "g", "leaf", "start", _id("g", 0, F.shiftright("pos", height), F.col("tree")).alias("at"),
                           F.col("pos").bitwiseAND((1 << height) - 1).alias("slot"))
    climbed = _recursive(spark, _climb_sql(height, run), hold, "climbed", leaves=starts, nodes=nodes)
    text = lambda c: F.lower(F.hex(c))
    return climbed.select(
        F.col("key").alias(key), text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        text("proof").alias("proof_sha256"), text("hash").alias("folded_root"), (F.col("hash") == F.col("root")).alias("verified"))


def with_count_raised(key: str = "doc_id", count: str = "n_chars", fields: Sequence[str] = FIELDS, every: int = 7) -> Column:
    """Digests after one is added to ``count`` where ``every`` divides the key's checksum; a NULL key or count stays."""
    raised = F.col(f"`{count}`").cast("decimal(38,0)") + F.coalesce((F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % every == 0).cast("int"), F.lit(0))
    return digest([raised if f == count else F.col(f"`{f}`") for f in fields])
