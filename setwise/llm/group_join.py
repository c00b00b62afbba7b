"""Exact Jaccard self-join of shingle sets over a token-group matrix.

Similar sets are put into groups, and a group keeps the union of its members'
tokens. What a set shares with a group's union bounds what it shares with any
member, so only groups whose bound reaches the threshold are opened, and only
their members are compared.

Two sieves come first and lose no link. A set of n tokens needs a share of its
tokens in common with any partner; a sketch of its smallest hashes must then
hold some of them, and so must the partner's. The first sieve drops sets whose
sketch has too few tokens that any other sketch has; the second does the same
with all tokens of what is left. For the second, tokens are ordered by how many
sets hold them: two linked sets share one of their rarest tokens, and only these
stand in the matrix that finds the groups of a set. What no other set has of a
set also bounds the size of its partners.

Tokens are counted in chunks of bounded text: a chunk lists each of its tokens
once, lists are dealt by ranges of hashes, and every chunk gets one byte for
each token back. A token that a third of all texts holds is one entry a chunk.

Sets that are alike are not compared in pairs. Each is compared with the most
central set of its cells (sets of one least hash); after that only sets outside
the largest component around a token look for groups, and only for groups that
hold members of other components.

Near-copies that are not linked share nearly all tokens, so these tell nothing.
The most central of them is their hub, and two sets of one hub differ in all in
which one of them differs from it, save what both have lost or gained: linked
sets of two components have some of that in common. Sets of one hub look for
groups by these differences alone, and by their tokens only for other hubs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from setwise.llm.components import components
from setwise.llm.minhash import mixed, shingles
from setwise.llm.store import Scratch, scratch
from setwise.llm.texts import parts_of

SPARE = 10  # tokens in common that a sketch is sure to hold, per cent of a set
CHUNK_BYTES = 2_000_000
PART_TOKENS = 500_000  # tokens of a range of hashes, which one task counts
GROUP, GROUP_TOKENS = 16, 200_000  # about so many members or tokens in a group
KEYS = 1_000_000  # so many keys may be broadcast
CELLS = np.random.default_rng(11).integers(0, 1 << 63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def needed(n, percent: int):
    """Least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def sketch_sizes(n: np.ndarray, percent: int, spare: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of a sketch, tokens a set is sure to share with a partner's sketch); no ``spare`` means the whole set."""
    least = needed(n, percent)
    if spare is None:
        return n, least
    held = lambda x: np.maximum(-(-spare * x // 100), 1)
    return np.minimum(n, n - least + held(n)), held(least)


def _packed(rows: DataFrame, k: int, percent: int, spare: int | None, chunk_bytes: int) -> DataFrame:
    """Chunks of texts (key, body[, wanted set]): keys with the place of their set, and the distinct sets with their sketches."""
    key = rows.schema[0]
    ddl = "ids array<binary>, n array<int>, ends array<int>, tokens array<bigint>"
    schema = StructType([*StructType.fromDDL("chunk bigint").fields, StructField("keys", ArrayType(key.dataType)), *StructType.fromDDL(f"at array<int>, {ddl}").fields])
    names = schema.names
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        keys, at, sets, size = [], [], {}, 0

        def chunk():
            n = np.array([len(s) for s in sets.values()], np.int64)
            sizes, _ = sketch_sizes(n, percent, spare)
            tokens = [s[:m] for s, m in zip(sets.values(), sizes, strict=True)]
            lists = [pa.concat_arrays(keys), pa.array(at, pa.int32()), pa.array(list(sets), pa.binary()), pa.array(n, pa.int32()),
                     pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate([*tokens, np.zeros(0, np.uint64)]).view(np.int64))]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *map(one, lists)], names=names)

        for batch in batches:
            for part in parts_of(batch, 1, chunk_bytes):
                taken = []
                for i, text in enumerate(part.column(1).to_pylist()):
                    held = shingles(text, k)
                    name = xxhash.xxh3_128_digest(held.tobytes()) if len(held) else b""
                    if part.num_columns > 2 and part.column(2)[i].as_py() != name:
                        continue
                    sets.setdefault(name, held)
                    taken.append(i)
                    at.append(name)
                keys.append(part.column(0).take(pa.array(taken, pa.int32())))
                size += part.column(1).nbytes
                if size >= chunk_bytes:
                    place = {name: i for i, name in enumerate(sets)}
                    at = [place[name] for name in at]
                    yield chunk()
                    number, size, keys, at, sets = number + 1, 0, [], [], {}
        if keys:
            place = {name: i for i, name in enumerate(sets)}
            at = [place[name] for name in at]
            yield chunk()

    return rows.mapInArrow(run, schema)


def _dealt(chunks: DataFrame, parts: int) -> DataFrame:
    """(part, chunk, tokens, counts): the distinct tokens of every chunk, cut into equal ranges of hashes."""
    width = np.uint64(-(-(1 << 64) // parts) if parts > 1 else (1 << 64) - 1)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                held = batch.column(1).slice(i, 1).flatten().to_numpy().view(np.uint64)
                tokens, counts = np.unique(held, return_counts=True)
                part = (tokens // width).astype(np.int64)
                cuts = np.flatnonzero(np.diff(part, prepend=-1))
                pieces = list(zip(cuts, [*cuts[1:], len(part)], strict=True)) if len(part) else []
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(part[a]) for a, _ in pieces], pa.int32()), pa.array([batch.column(0)[i].as_py()] * len(pieces), pa.int64()),
                    pa.array([tokens[a:b].tobytes() for a, b in pieces], pa.binary()),
                    pa.array([counts[a:b].astype(np.int32).tobytes() for a, b in pieces], pa.binary())], names=["part", "chunk", "tokens", "counts"])

    return chunks.select("chunk", "tokens").mapInArrow(run, "part int, chunk bigint, tokens binary, counts binary")


def _counted(table: pa.Table) -> pa.Table:
    """One range of hashes: for every chunk a byte a token, 0 where no other set has it, else growing with the number of sets."""
    tokens = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("counts").to_pylist()])
    _, at = np.unique(np.concatenate(tokens), return_inverse=True)
    total = np.bincount(at, counts)
    code = np.minimum(np.ceil(6 * np.log2(total)), 255).astype(np.uint8)[at]
    ends = np.cumsum([len(x) for x in tokens])
    codes = [x.tobytes() for x in np.split(code, ends[:-1])]
    return pa.table({"back": table.column("chunk"), "piece": table.column("part"), "codes": pa.array(codes, pa.binary())})


def _sieve(chunks: DataFrame, percent: int, spare: int | None, whole: bool, part_tokens: int) -> DataFrame:
    """Sets that may have a partner: set_id, n, and with ``whole`` weight, largest size of a partner, rare tokens, all tokens and cells."""
    total = chunks.agg(F.coalesce(F.sum(F.size("tokens").cast("bigint")), F.lit(0))).first()[0]
    codes = _dealt(chunks, max(1, -(-total // part_tokens))).groupBy("part").applyInArrow(_counted, "back bigint, piece int, codes binary")
    out = StructType.fromDDL("set_id binary, n int" + (", weight double, cap bigint, rare array<bigint>, tokens array<bigint>, cells array<bigint>" if whole else ""))
    names = out.names

    def run(chunk: pa.Table, back: pa.Table) -> pa.Table:
        one = lambda name: chunk.column(name).combine_chunks().flatten()
        tokens, n, ends = one("tokens").to_numpy().view(np.uint64), one("n").to_numpy().astype(np.int64), one("ends").to_numpy()
        ids = one("ids").to_pylist()
        _, at = np.unique(tokens, return_inverse=True)
        order = np.argsort(back.column("piece").to_numpy(), kind="stable")
        pieces = back.column("codes").to_pylist()
        code = np.frombuffer(b"".join(pieces[i] for i in order), np.uint8)[at]
        shared = np.concatenate(([0], np.cumsum(code > 0)))[np.concatenate(([0], ends))]
        size, sure = sketch_sizes(n, percent, spare)
        kept = np.flatnonzero((np.diff(shared) >= sure) & (n > 0))
        columns = [pa.array([ids[i] for i in kept], pa.binary()), pa.array(n[kept], pa.int32())]
        if whole:
            rows = [_described(tokens[ends[i] - size[i] : ends[i]], code[ends[i] - size[i] : ends[i]], int(size[i] - sure[i]) + 1, percent) for i in kept]
            weight, cap, rare, held, cells = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            columns += [pa.array(weight, pa.float64()), pa.array(cap, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (rare, held, cells))]
        return pa.Table.from_arrays(columns, names=names)

    read = chunks.select("chunk", "ids", "n", "ends", "tokens")
    return read.groupBy("chunk").cogroup(codes.groupBy("back")).applyInArrow(run, out).dropDuplicates(["set_id"])


def _described(tokens: np.ndarray, code: np.ndarray, first: int, percent: int):
    """(how common its tokens are, the largest partner, the rarest tokens that others have, all, the least under each cell's hash).

    A set shares no more than what others have of it, so a partner must be small enough for that to be ``percent`` of the union.
    """
    rarest = np.lexsort((tokens, code))[:first]
    rarest = rarest[code[rarest] > 0]
    cells = [mixed(tokens * c).min() for c in CELLS]
    cap = int((code > 0).sum()) * (100 + percent) // percent - len(tokens)
    return float(code.mean()), cap, tokens[rarest].view(np.int64), tokens.view(np.int64), np.array(cells, np.uint64).view(np.int64)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose sets share ``percent`` of their union."""
    x = sets.select(F.col("rep").alias("a"), F.struct("n", "cap", "tokens").alias("x"))
    y = sets.select(F.col("rep").alias("b"), F.struct("n", "cap", "tokens").alias("y"))
    both = F.size(F.array_intersect("x.tokens", "y.tokens"))
    return pairs.join(x, "a").join(y, "b").where(
        (F.col("x.n") <= F.col("y.cap")) & (F.col("y.n") <= F.col("x.cap"))
        & (both * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent)).select("a", "b")


def _stars(sets: DataFrame) -> DataFrame:
    """(rep, hub) of every set and (weight, rep) of the most central one of each of its cells."""
    cells = sets.select("rep", "weight", F.posexplode("cells").alias("which", "cell"))
    hubs = cells.groupBy("which", "cell").agg(F.max(F.struct("weight", "rep")).alias("hub"))
    return cells.join(hubs, ["which", "cell"]).select("rep", "hub")


def _apart(sets: DataFrame, stars: DataFrame, percent: int, group: int) -> DataFrame:
    """(rep, hub, differing): the tokens that one of a set and its most central hub has alone, where these are few and the hub has many sets."""
    hung = stars.groupBy("rep").agg(F.max("hub")["rep"].alias("hub"))
    many = hung.groupBy("hub").agg(F.count("*").alias("n_hung")).where(F.col("n_hung") > group).select("hub")
    center = sets.select(F.col("rep").alias("hub"), F.col("tokens").alias("of_hub"))
    differing = F.concat(F.array_except("tokens", "of_hub"), F.array_except("of_hub", "tokens"))
    return sets.select("rep", "n", "tokens").join(hung.join(many, "hub"), "rep").join(center, "hub").select("rep", "hub", "n", differing.alias("differing")).where(
        F.size("differing") * 100 <= F.col("n") * (3 * (100 - percent))).drop("n")


def _bounded(placed: DataFrame, apart: DataFrame, percent: int, hold: Scratch) -> tuple[DataFrame, DataFrame]:
    """(``placed`` with hub, far and reach, differences (hub, token, rep) that sets of several components have).

    Linked sets differ in (100 - percent) / (100 + percent) of their sizes at most, and that is what both differ from their hub less
    twice what these differences have in common. So the ``far`` of one is no more than the ``reach`` of the other.
    """
    each = apart.join(placed.select("rep", "component"), "rep").select("rep", "hub", "component", F.explode("differing").alias("token"))
    several = each.groupBy("hub", "token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("hub", "token")
    shared = hold.table(each.join(several, ["hub", "token"]).select("hub", "token", "rep"), "differences")
    counted = shared.groupBy("rep").agg(F.count("*").alias("n_shared"))
    bounds = apart.select("rep", "hub", F.size("differing").alias("n_differing")).join(counted, "rep", "left")
    far = (100 + percent) * F.col("n_differing").cast("bigint") - (100 - percent) * F.col("n")
    reach = 2 * (100 + percent) * F.coalesce("n_shared", F.lit(0)) - F.col("far")
    hung = placed.join(bounds, "rep", "left").withColumn("far", far).withColumn("reach", F.when(F.col("hub").isNotNull(), reach))
    return hung.drop("n_differing", "n_shared"), shared


def _met_by_tokens(members: DataFrame, hold: Scratch) -> DataFrame:
    """(rep, group): sets and the groups of other hubs with a rare token and a member of another component.

    Around a token there are components and hubs within which nothing is looked for; sets of the largest of these do not ask.
    """
    entries = members.select(F.explode("rare").alias("token"), "rep", "group", "component", "hub", "n", "cap")
    most = lambda by: entries.where(f"{by} IS NOT NULL").groupBy("token", by).agg(F.count("*").alias("holders")).groupBy("token").agg(
        F.max(F.struct("holders", by)).alias(f"most_{by}"), F.count("*").alias(f"n_{by}"))
    several = hold.table(most("component").where("n_component > 1").join(most("hub"), "token", "left").select(
        "token", F.when(F.col("most_hub.holders") > F.col("most_component.holders"), F.col("most_hub.hub")).alias("largest_hub"),
        F.col("most_component.component").alias("largest")), "tokens")
    open_entries = hold.table(entries.join(several, "token"), "entries")
    matrix = open_entries.groupBy("token", "group", F.col("hub").alias("of_hub")).agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least_n"), F.max("cap").alias("most_cap"))
    asking = open_entries.where(
        "IF(largest_hub IS NULL, component <> largest, hub IS NULL OR hub <> largest_hub)").select("token", "rep", "component", "hub", "n", "cap")
    return asking.join(matrix, "token").where(
        "(low <> component OR high <> component) AND least_n <= cap AND n <= most_cap AND (hub IS NULL OR of_hub IS NULL OR hub <> of_hub)").select(
        "rep", "group").distinct()


def _met_by_differences(members: DataFrame, shared: DataFrame, percent: int, hold: Scratch) -> DataFrame:
    """(rep, group): sets outside the largest component of their hub and its groups that may hold a linked set of another component."""
    entries = shared.join(members.select("rep", "group", "component", "n", "cap", "far", "reach"), "rep")
    ends = entries.groupBy("hub", "token").agg(F.min("far").alias("least_far"), F.max("reach").alias("most_reach"))
    entries = hold.table(entries.join(ends, ["hub", "token"]).where("far <= most_reach AND least_far <= reach").drop("least_far", "most_reach"), "entries")
    sizes = members.where("hub IS NOT NULL").groupBy("hub", "component").agg(F.count("*").alias("holders"))
    largest = sizes.groupBy("hub").agg(F.max(F.struct("holders", "component"))["component"].alias("largest"))
    asking = entries.join(largest, "hub").where("component <> largest").select("hub", "token", "rep", "component", "n", "cap", "far", "reach")
    matrix = entries.groupBy("hub", "token", "group").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least_n"), F.max("cap").alias("most_cap"),
        F.min("far").alias("least_far"), F.max("reach").alias("most_reach"))
    met = asking.join(matrix, ["hub", "token"]).where(
        "(low <> component OR high <> component) AND least_n <= cap AND n <= most_cap AND least_far <= reach AND far <= most_reach")
    common = met.groupBy("rep", "group").agg(F.count("*").alias("common"), F.min(F.col("far") + F.col("least_far")).alias("apart"))
    return common.where(F.col("common") * (2 * (100 + percent)) >= F.col("apart")).select("rep", "group")


def _searched(sets: DataFrame, joined: DataFrame, apart: DataFrame, percent: int, hold: Scratch, group: int) -> DataFrame:
    """Pairs (a, b) still to be compared: sets of different components, b in a group whose bound reaches the threshold for a."""
    placed = sets.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed, shared = _bounded(placed, apart, percent, hold)
    by_cell = placed.withColumn("cell", F.when(F.col("hub").isNull(), F.col("cells")[0]).otherwise(F.xxhash64("hub")))
    cuts = by_cell.groupBy("cell").agg(F.greatest(F.ceil(F.count("*") / group), F.ceil(F.sum("n") / GROUP_TOKENS)).alias("cuts"))
    members = hold.table(by_cell.join(cuts, "cell").withColumn(
        "group", F.xxhash64("cell", F.pmod(F.xxhash64("rep"), F.col("cuts")))).drop("cell", "cuts", "cells", "weight"), "members")
    groups = members.groupBy("group").agg(
        F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"))

    met = hold.table(_met_by_tokens(members, hold).union(_met_by_differences(members, shared, percent, hold)).distinct(), "met")
    q = members.select("rep", F.col("n").alias("q_n"), F.col("tokens").alias("q_tokens"))
    bound = F.size(F.array_intersect("q_tokens", "tokens"))
    opened = hold.table(met.join(q, "rep").join(groups, "group").where(bound * 100 >= F.col("q_n") * percent).select("rep", "group"), "opened")
    asking = members.select("rep", "component", "n", "cap", "hub", "far", "reach")
    inside = members.select("group", *[F.col(c).alias("b" if c == "rep" else f"b_{c}") for c in asking.columns])
    return opened.join(asking, "rep").join(inside, "group").where(
        "component <> b_component AND n <= b_cap AND b_n <= cap AND (hub IS NULL OR b_hub IS NULL OR hub <> b_hub OR (far <= b_reach AND b_far <= reach))").select(
        F.greatest("rep", "b").alias("a"), F.least("rep", "b").alias("b")).distinct()


def similar_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85,
    chunk_bytes: int = CHUNK_BYTES, part_tokens: int = PART_TOKENS, group: int = GROUP,
) -> DataFrame:
    """One row per document: key, n_shingles and component, the smallest key reachable over links.

    Two documents are linked when ``percent`` of the united shingles are shared. Texts of one set are one class and linked.
    NULL and empty texts and texts without words have no shingles and no links; very long texts count whole. Rows without a
    key have no links and no component; rows that repeat a key are one document, linked by whatever either text is linked by.
    An empty table stays empty; other columns are ignored.
    """
    spark, hold = docs.sparkSession, scratch(docs.sparkSession)
    named = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("body"))
    chunks = hold.table(_packed(named, k, percent, SPARE, chunk_bytes), "sketches")
    rows = chunks.select(F.explode(F.arrays_zip("keys", F.expr("transform(at, i -> ids[i])").alias("set_id"), F.expr("transform(at, i -> n[i])").alias("n"))).alias("r"))
    rows = hold.table(rows.select(F.col("r.keys").alias("key"), "r.set_id", F.col("r.n").cast("bigint").alias("n")), "rows")
    classes = hold.table(rows.where("key IS NOT NULL AND n > 0").groupBy("set_id").agg(F.min("key").alias("rep")), "classes")

    likely = hold.table(_sieve(chunks, percent, SPARE, False, part_tokens).join(classes, "set_id").select(F.col("rep").alias("key"), "set_id"), "likely")
    hold.drop(chunks)
    few = likely.limit(KEYS + 1).count() <= KEYS
    texts = named.join(F.broadcast(likely) if few else likely, "key").select("key", "body", "set_id")
    full = hold.table(_packed(texts, k, percent, None, chunk_bytes), "sets")
    sets = hold.table(_sieve(full, percent, None, True, part_tokens).join(classes, "set_id"), "likely-sets")
    hold.drop(full)

    # Texts under one key are one document.
    of_key = rows.where("key IS NOT NULL AND n > 0").select("key", "set_id").distinct()
    mixed_keys = of_key.groupBy("key").agg(F.count("*").alias("n_sets")).where("n_sets > 1")
    same_key = of_key.join(mixed_keys, "key").join(classes, "set_id").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    stars = hold.table(_stars(sets), "stars")
    pairs = stars.select(F.col("rep").alias("a"), F.col("hub")["rep"].alias("b")).where("a <> b").distinct()
    first = hold.table(_linked(pairs, sets, percent), "links")
    joined = components(first.union(same_key), "a", "b", hold)
    apart = hold.table(_apart(sets, stars, percent, group), "apart")
    late = hold.table(_linked(_searched(sets, joined, apart, percent, hold, group), sets, percent), "late-links")
    joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(late), "a", "b", hold)

    of_class = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component"))
    out = rows.join(of_class, "set_id", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("component", "key")).alias("component"))
