"""License notices wherever lines end, against plain Python."""

import math
import random

from setwise.llm import licenses, texts

BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:"""
ISC = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted"


def by_force(text):
    words = [w.decode() for w in texts.plain_words(text)]
    best = {}
    for name, t in licenses.TEMPLATES.items():
        t = t.split()
        width = licenses.STRETCH * len(t)
        shared = max((len(set(t) & set(words[i : i + width])) for i in range(max(len(words) - width, 0) + 1)), default=0)
        if shared >= math.ceil(licenses.THRESHOLD * len(set(t)) - 1e-9):
            best[name] = shared / len(set(t))
    return best


def scan(spark, rows):
    return {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}


def test_wrapped_and_scattered_notices(spark):
    scattered = " ".join(w + " filler" * 500 for w in "released under the mit license".split())
    got = scan(spark, [(1, "x\n" + BSD), (2, ISC), (3, scattered), (4, scattered + " Released under the MIT\nLicense."), (5, None), (6, "mit")])
    assert [(got[i].labels, got[i].score) for i in range(1, 7)] == [("bsd", 1.0), ("isc", 1.0), ("", 0.0), ("mit", 1.0), ("", 0.0), ("", 0.0)]


def test_windows_by_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(200):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += [rng.choice(("the", "of", "license", "software", "to", "x", "y")) for _ in range(rng.randrange(60))]
            for w in rng.choice(list(licenses.TEMPLATES.values())).split():
                words += ["z"] * rng.choice((0, 0, 0, 1, 3)) + [w] * (rng.random() < 0.93)
        rows.append((i, "".join(w + rng.choice((" ", " ", "\n", ", ")) for w in words)))
    got = scan(spark, rows)
    for i, text in rows:
        want, base = by_force(text), set(filter(None, got[i].base_labels.split(",")))
        assert (got[i].labels, got[i].score) == (",".join(sorted(base | set(want))), max(want.values(), default=0.0)), text
