"""From raw documents to token ids: quality rules, near-duplicates, benchmark decontamination, personal data, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns they were given, in their order. Extra columns pass through, whatever
their names; NULL texts count as empty; rows without an id are never taken for
a copy of another; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from setwise.llm import bpe, decontaminate, minhash, pii, quality
from setwise.llm.store import prepare, scratch

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Shielded:
    """Documents under column names that no operator makes, and the way back."""

    def __init__(self, docs: DataFrame):
        prepare(docs.sparkSession)
        self.names = docs.columns
        self.safe = {name: f"column_{i}_" for i, name in enumerate(self.names)}
        self.docs, self.columns = docs.toDF(*self.safe.values()), list(self.safe.values())
        self.key, self.text = self.safe["doc_id"], self.safe["text"]

    def back(self, df: DataFrame) -> DataFrame:
        return df.select(*self.columns).toDF(*self.names)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    s = Shielded(docs)
    return s.back(quality.quality(s.docs, s.columns, s.text).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies (five-word shingles, similarity 0.8): the one with the smallest id."""
    s = Shielded(docs)
    copies = minhash.near_duplicates(s.docs, s.key, s.text).where("NOT kept").select(s.key).distinct()
    return s.back(s.docs.join(copies, s.key, "left_anti"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in benchmark windows."""
    s = Shielded(docs)
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return s.back(decontaminate.find_contamination(s.docs, benchmark, s.columns, s.text).where("NOT contaminated"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind in brackets; n_chars follows the text."""
    s = Shielded(docs)
    found = pii.find_personal(s.docs, s.columns, s.text, redacted="redacted")
    found = found.withColumn(s.text, F.col("redacted"))
    if "n_chars" in s.safe:
        old = s.docs.schema[s.safe["n_chars"]].dataType
        found = found.withColumn(s.safe["n_chars"], F.char_length(s.text).cast(old))
    return s.back(found)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with n_tokens, ids and starts (little-endian unsigned 32-bit integers) and whether decoding gives the text back."""
    coded = bpe.encode(docs.select("doc_id", "text"), RANKS, keep=("doc_id", "text"), decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "n_tokens", "ids", "starts", F.sha2("ids", 256).alias("ids_sha256"), same.alias("decodes"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", tokens),
]

# Byte-level BPE cannot be said in SQL: the tests hold the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    hold = scratch(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = hold.table(stage(spark, docs, sf_dir), name)
    return docs
