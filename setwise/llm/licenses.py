"""License scan: an exact set-similarity join of text windows with license templates, in DataFrame operations only.

A window is a run of consecutive words of the whole text, wherever its lines
end, at most ``STRETCH`` times as long as the template. It matches when it holds
``threshold`` of the template's distinct words. Template words are ordered by
the number of documents that hold them, rarest first. A window that matches must
hold one of the first |T| - a + 1 words of the template (a: words needed), so
only words near one of those are looked at; every window that ends in one of
the template's words is then counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from setwise.llm.store import scratch
from setwise.llm.texts import LETTERS

THRESHOLD = 0.85
STRETCH = 2  # words of a window for each word of the template

# The phrases of the base scan and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Usual notices of common licenses, as words.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-header": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}


def plain_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lowered; NULL has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), LETTERS, LETTERS.lower())
    return F.regexp_extract_all(lowered, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))


def phrase_starts(words: str, phrase: Sequence[str]) -> Column:
    """Positions (from 0) in an array of words at which the phrase's words follow each other."""
    same = " AND ".join(f"{words}[i + {k}] = '{w}'" for k, w in enumerate(phrase))
    return F.expr(
        f"CASE WHEN array_contains({words}, '{phrase[-1]}') AND array_contains({words}, '{phrase[0]}') "
        f"THEN filter(sequence(0, greatest(size({words}) - {len(phrase)}, 0)), i -> size({words}) >= i + {len(phrase)} AND {same}) "
        f"ELSE array() END").cast("array<int>")


def _words_array(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def scan_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text", templates: Mapping[str, str] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES, threshold: float = THRESHOLD, stretch: int = STRETCH,
) -> DataFrame:
    """One row per document: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the largest share of a template's words in a window that meets
    the threshold, else 0. NULL and empty texts have no words, no labels and
    score 0. Very long texts are read whole; repeated rows each get their row,
    templates that match equally are all named, and an empty table stays empty.
    Templates and phrases are
    parameters of fixed size; what is broadcast follows from them alone.
    """
    spark, hold = docs.sparkSession, scratch(docs.sparkSession)
    sets = {name: list(dict.fromkeys(t.split())) for name, t in templates.items()}
    needed = {name: math.ceil(threshold * len(words) - 1e-9) for name, words in sets.items()}
    widths = {name: stretch * len(t.split()) for name, t in templates.items()}
    vocabulary = sorted({w for words in sets.values() for w in words})

    starts = {label: phrase_starts("words", phrase.split()) for phrase, label in phrases.items()}
    read = docs.select(F.col(key).alias("key"), F.col(text).alias("body"), plain_words(F.col(text)).alias("words"))
    base = read.select(
        "key", "body", F.size("words").cast("bigint").alias("n_words"),
        *[x.alias(f"at_{i}") for i, x in enumerate(starts.values())],
        F.array_intersect("words", _words_array(vocabulary)).alias("known"))
    places = F.concat(*[F.col(f"at_{i}") for i in range(len(starts))])
    # Only a document that has enough words of some template keeps its text.
    possible = {name: F.size(F.array_intersect("known", _words_array(w))) >= needed[name] for name, w in sets.items()}
    any_of = F.lit(False)
    for p in possible.values():
        any_of = any_of | p
    first = hold.table(base.select(
        F.monotonically_increasing_id().alias("row"), "key", "n_words", F.size(places).cast("bigint").alias("n_base"),
        F.array_min(places).cast("bigint").alias("first_word"), F.array_max(places).cast("bigint").alias("last_word"),
        F.filter(F.array(*[F.when(F.size(f"at_{i}") > 0, label) for i, label in enumerate(starts)]), lambda x: x.isNotNull()).alias("base"),
        "known", F.when(any_of, F.col("body")).alias("body")), "scanned")

    # Global order: words of templates by the documents that hold them, rarest first.
    words = F.explode(_words_array(vocabulary)).alias("word")
    held = first.select(F.explode("known").alias("word")).groupBy("word").agg(F.count("*").alias("held"))
    order = hold.table(spark.range(1).select(words).join(held, "word", "left").select(
        "word", F.row_number().over(Window.orderBy(F.coalesce("held", F.lit(0)), "word")).alias("rank")), "order")
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("template"), _words_array(w).alias("words"), F.lit(len(w)).alias("size"),
                 F.lit(needed[n]).alias("needed"), F.lit(widths[n]).alias("width"))
        for n, w in sets.items()])).alias("t")
    template_words = spark.range(1).select(rows).select("t.*").select("template", "size", "needed", "width", F.explode("words").alias("word")).join(
        F.broadcast(order), "word").withColumn("t_at", F.row_number().over(Window.partitionBy("template").orderBy("rank")))
    template_words = template_words.withColumn("rare", F.col("t_at") <= F.col("size") - F.col("needed") + 1)

    # Positions of a template's words, in cells as long as its windows.
    maybe = F.array(*[F.when(p, name) for name, p in possible.items()]).alias("possible")
    read = first.where("body IS NOT NULL").select("row", maybe, F.posexplode(plain_words(F.col("body"))).alias("at", "word"))
    tokens = hold.table(read.join(F.broadcast(template_words), "word").where("array_contains(possible, template)").select(
        "row", "template", "size", "needed", "width", "at", "word", "rare", F.expr("at div width").alias("cell")), "tokens")
    # A window with a rare word lies in that word's cell and the two beside it.
    cells = tokens.where("rare").select("row", "template", F.explode(F.expr("array(cell - 1, cell, cell + 1)")).alias("cell")).distinct()
    near = tokens.join(cells, ["row", "template", "cell"], "left_semi")
    before = Window.partitionBy("row", "template").orderBy("at").rangeBetween(1 - max(widths.values()), 0)
    shared = F.expr("size(array_distinct(transform(filter(seen, x -> x.at > at - width), x -> x.word)))")
    matches = near.withColumn("seen", F.collect_list(F.struct("at", "word")).over(before)).withColumn("shared", shared).where("shared >= needed")
    found = matches.groupBy("row").agg(
        F.collect_set("template").alias("templates"), F.max(F.col("shared") / F.col("size")).alias("best"))
    none = F.array().cast("array<string>")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return first.drop("body", "known").join(found, "row", "left").select(
        F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.coalesce("templates", none))).alias("labels"), F.coalesce("best", F.lit(0.0)).alias("score"))
