"""Many snippets searched in stored texts by a trigram index.

Every text is cut into its distinct trigrams of lowered characters. A trigram's
keys are its posting list; keys are dealt by a hash to parts of about LIST, and
a list has a row for each part, so no row grows with a trigram that stands in
every text. Lists are written by bucket of the trigram and
sorted by it, so a search reads the buckets of its trigrams and there only row
groups that can hold them. Keys that stand in all lists looked at are compared
with the text itself, so a search finds what a scan finds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from setwise.functions.texts import contains_text
from setwise.session import materialize, release
from setwise.sources.tables import literal_rows

LIST = 20_000  # keys in a row of a posting list
BUCKETS = 64
PARTS = 32  # parts of a list in a file of a bucket
RAREST = 4  # lists looked at for a snippet


def trigrams(text: Column) -> Column:
    """Distinct three-character pieces of a lowered text; NULL and shorter texts have none."""
    # One pass of a pattern that looks ahead three characters and moves on by one.
    pieces = F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))."), F.lit(1))
    return F.coalesce(F.array_distinct(pieces), F.array().cast("array<string>"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build_index(texts: DataFrame, key: str, text: Column, folder: str, most: int = LIST) -> None:
    """Write posting lists (gram, part, keys, holders) and list sizes (gram, holders) of all texts with a key."""
    keyed = texts.where(F.col(key).isNotNull())
    parts = -(-keyed.count() // most) or 1
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int").alias("part")
    pairs = keyed.select(F.col(key).alias("key"), part, F.explode(trigrams(text)).alias("gram"))
    # Grouped where the texts are read, so that lists are shuffled and not pairs; rows that repeat a key fall into one list.
    lists = materialize(pairs.groupBy("gram", "part").agg(F.collect_set("key").alias("keys")), "lists")
    sizes = lists.groupBy("gram").agg(F.sum(F.size("keys")).alias("holders"))
    # A file for each bucket, or several where it holds many parts, and not one for each bucket and task.
    dealt = F.pmod(F.xxhash64("gram", F.lit("file")), F.lit(-(-parts // PARTS)))
    by = lambda df: df.withColumn("bucket", _bucket(F.col("gram"))).repartition("bucket", dealt).sortWithinPartitions("bucket", "gram")
    by(lists.join(sizes, "gram")).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/lists")
    by(sizes).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/sizes")
    release(lists)


def matching(spark: SparkSession, folder: str, part: str, grams: Sequence[str]) -> DataFrame:
    """Rows of the index for some trigrams: buckets are pruned, and the trigrams reach the file scan."""
    held = spark.read.parquet(f"{folder}/{part}")
    buckets = [r[0] for r in literal_rows(spark, [(g,) for g in grams], "gram string").select(_bucket(F.col("gram"))).distinct().collect()]
    return held.where(F.col("bucket").isin(buckets) & F.col("gram").isin(list(grams)))


def search(texts: DataFrame, key: str, text: Column, folder: str, snippets: Sequence[str], rarest: int = RAREST) -> DataFrame:
    """(snippet, key): the texts that hold each snippet, in any letter case; the snippets are a stated set.

    Snippets of fewer than three characters have no trigram: they are looked
    for in all texts. NULL texts hold nothing; every text holds ''.
    """
    spark = texts.sparkSession
    found = []
    long = sorted({s for s in snippets if len(s.lower()) >= 3})
    if long:
        grams = [(s, g) for s in long for g in sorted({s.lower()[i : i + 3] for i in range(len(s.lower()) - 2)})]
        holders = {r.gram: r.holders for r in matching(spark, folder, "sizes", sorted({g for _, g in grams})).collect()}
        looked = []
        for s in long:
            own = sorted((g for t, g in grams if t == s), key=lambda g: (holders.get(g, 0), g))
            if all(g in holders for g in own):  # a trigram that no text holds settles it
                looked += [(s, g, min(rarest, len(own))) for g in own[:rarest]]
        if looked:
            lists = matching(spark, folder, "lists", sorted({g for _, g, _ in looked})).select("gram", F.explode("keys").alias("key"))
            wanted = literal_rows(spark, looked, "snippet string, gram string, needed int")
            likely = lists.join(wanted, "gram").groupBy("snippet", "needed", "key").agg(F.count(F.lit(1)).alias("n")).where("n = needed")
            held = texts.select(F.col(key).alias("key"), F.lower(text).alias("__text"))
            found.append(likely.join(held, "key").where(F.contains("__text", F.lower("snippet"))).select("snippet", "key").distinct())
    for s in sorted(set(snippets) - set(long)):
        found.append(texts.where(F.col(key).isNotNull() & contains_text(text, s)).select(F.lit(s).alias("snippet"), F.col(key).alias("key")).distinct())
    if not found:
        return texts.select(F.lit("").alias("snippet"), F.col(key).alias("key")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
