"""Proportional stratified interleaving: every shard gets the mixture of sources that the whole has.

Rows of a source are put in a seeded order; the row of rank r among n gets the
fractional rank (r - 1/2) / n. Sorted by it all sources advance in step, and
cutting the sequence gives shards of the same mixture, one row apart in size.

Neither a source nor the sequence is sorted in one task. The seeded order is a
digest, so its first digits cut a source of any size into equal slices, and a
fractional rank cuts the sequence into equal slices; small tables of slice
counts give what lies before each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from setwise.llm.store import scratch

SEED = "interleave-1"
SLICE_DIGITS = 3  # hex digits: 4096 slices of a source, and of the sequence


def interleave(
    docs: DataFrame, shards: int = 16, source: str = "source", key: str = "doc_id", text: str = "text",
    seed: str = SEED, slice_digits: int = SLICE_DIGITS,
) -> DataFrame:
    """key, source, size (UTF-8 bytes and one), text_crc32, shard and slot (gapless from 0 within a shard).

    Rows without a source are a source of their own; a NULL text has no bytes.
    Rows that repeat a key stand together in an order fixed by their texts'
    checksums; identical rows are interchangeable. An empty table stays empty.
    """
    slices = 16**slice_digits
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"),
        F.when(F.col(source).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(source))).alias("stratum"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("draw"),
        (F.octet_length(body) + F.lit(1)).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
    ).withColumn("slice", F.substring("draw", 1, slice_digits))

    in_slice = Window.partitionBy("stratum", "slice").orderBy("draw", "key", "size", "text_crc32")
    ranked = scratch(docs.sparkSession).table(rows.withColumn("place", F.row_number().over(in_slice).cast("bigint")), "ranked")
    so_far = Window.partitionBy("stratum").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranked.groupBy("stratum", "slice").agg(F.count("*").alias("n")).select(
        "stratum", "slice", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("stratum")).alias("total"))
    position = F.col("before") + F.col("place")
    sequence = ranked.join(counts, ["stratum", "slice"]).select(
        "key", "source", "stratum", "draw", "size", "text_crc32",
        ((2 * position - 1).cast("double") / (2 * F.col("total")).cast("double")).alias("part"),
    ).withColumn("cut", F.floor(F.col("part") * slices).cast("int"))

    # Slices of the sequence: as many rows as there are slices, whatever the input.
    heads = Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = sequence.groupBy("cut").agg(F.count("*").alias("n")).select(
        "cut", F.coalesce(F.sum("n").over(heads), F.lit(0)).alias("ahead"),
        F.sum("n").over(Window.partitionBy()).alias("all"))
    in_cut = Window.partitionBy("cut").orderBy("part", "stratum", "draw", "key", "size", "text_crc32")
    at = F.col("ahead") + F.row_number().over(in_cut) - 1
    placed = sequence.join(F.broadcast(cuts), "cut").select(
        "key", "source", "size", "text_crc32", at.alias("at"), F.expr(f"`all` div {shards}").alias("least"), F.expr(f"`all` % {shards}").alias("larger"))
    # The first ``larger`` shards hold one row more than the others.
    in_larger = F.col("larger") * (F.col("least") + 1)
    shard = F.expr(f"CASE WHEN at < larger * (least + 1) THEN at div (least + 1) ELSE larger + (at - larger * (least + 1)) div least END")
    slot = F.when(F.col("at") < in_larger, F.col("at") % (F.col("least") + 1)).otherwise((F.col("at") - in_larger) % F.col("least"))
    return placed.select(
        F.col("key").alias(key), F.col("source").alias(source),
        "size", "text_crc32", shard.cast("int").alias("shard"), slot.cast("bigint").alias("slot"))


def shards_of(docs: DataFrame, names: Sequence[str] = ("doc_id", "size", "text_crc32"), **options) -> DataFrame:
    """The digest form: ``names`` with the law that holds (``rows``), shard, slot and no grown shard."""
    return interleave(docs, **options).select(
        *names, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
