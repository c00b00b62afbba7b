"""NULLs, empty and long texts, repeated rows, empty tables and clashing extra columns, for every operator."""

import pytest

import corpus_pipeline
from setwise.llm import bpe, decontaminate, language, licenses, minhash, pii, quality, sharding, substrings, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, score string, kept string, bucket int"
LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(60_000))
ROWS = [
    (1, None, None, None, None, "x", None, "y", 1),
    (2, "", "en", "a", 0, "x", "s", "y", 1),
    (3, "plain words here", "en", "a", 16, None, "s", "y", None),
    (3, "plain words here", "en", "a", 16, None, "s", "y", None),
    (None, "plain words here", "de", None, 16, "x", "s", None, 1),
    (4, LONG, "en", "b", len(LONG), "x", "s", "y", 1),
    (5, LONG, "en", "b", len(LONG), "x", "s", "y", 1),
    (6, " \n\t ", "fr", "b", 4, "x", "s", "y", 1),
]


def operators(spark):
    items = spark.createDataFrame([(7, "plain words here"), (8, None), (9, ""), (None, "plain")], "item_id bigint, text string")
    labels = spark.createDataFrame([(3, 0), (4, 1), (None, 1), (5, None)], "doc_id bigint, toxic int")
    return {
        "op1": (lambda d: minhash.near_duplicates(d), 8),
        "op2": (lambda d: pii.find_personal(d, redacted="clean"), 8),
        "op3": (lambda d: sharding.shards_of(d), 8),
        "op4": (lambda d: language.identify(d, language.fit(d)), 8),
        "op5": (lambda d: toxicity.rate(d, toxicity.fit(d, labels)), 8),
        "op6": (lambda d: substrings.remove_repeats(d), 8),
        "op7": (lambda d: licenses.scan_licenses(d), 8),
        "op8": (lambda d: quality.quality(d), 8),
        "op9": (lambda d: decontaminate.find_contamination(d, items), 8),
        "op10": (lambda d: bpe.decode(bpe.encode(d, corpus_pipeline.RANKS), corpus_pipeline.RANKS), 8),
    }


@pytest.mark.parametrize("name", [f"op{n}" for n in range(1, 11)])
def test_edge_rows(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    work, rows = operators(spark)[name]
    found = [r.asDict() for r in work(docs).collect()]
    assert len(found) == rows
    assert sorted(r["doc_id"] or -1 for r in found) == [-1, 1, 2, 3, 3, 4, 5, 6]
    threes = [{k: v for k, v in r.items() if k not in ("slot", "shard")} for r in found if r["doc_id"] == 3]
    assert threes[0] == threes[1]  # repeated rows get the same result


# The text of row 3 is an example of two languages: the first by name is predicted.
# What rows 1 (NULL), 2 (empty), 3 (three words), 4 (very long) and 6 (white space) give.
VALUES = {
    "op1": ("n_shingles", 0, 0, 1, 25922, 0), "op2": ("spans", "", "", "", "", ""), "op3": ("size", 1, 1, 17, len(LONG) + 1, 5),
    "op4": ("lang_pred", "und", "und", "de", "en", "und"), "op6": ("n_removed", 0, 0, 0, 0, 0), "op7": ("n_words", 0, 0, 3, 120_000, 0),
    "op8": ("n_words", 0, 0, 3, 120_000, 0), "op9": ("n_hit", 0, 0, 3, 0, 0), "op10": ("n_tokens", 0, 0, 3, None, None),
}


@pytest.mark.parametrize("name", sorted(VALUES))
def test_edge_values(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    column, *want = VALUES[name]
    found = {r["doc_id"]: r[column] for r in operators(spark)[name][0](docs).collect()}
    assert [found[i] for i, w in zip((1, 2, 3, 4, 6), want, strict=True) if w is not None] == [w for w in want if w is not None]


def test_clashing_names_are_refused(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    with pytest.raises(ValueError, match="n_words"):
        quality.quality(docs, keep=["doc_id", "n_words"])


@pytest.mark.parametrize("name", [f"op{n}" for n in range(1, 11)])
def test_empty_table(spark, name):
    docs = spark.createDataFrame([], SCHEMA)
    assert operators(spark)[name][0](docs).collect() == []


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_edge_rows(spark, tmp_path, stage):
    spark.createDataFrame([(1, "some test item")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = run(spark, docs, str(tmp_path))
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} <= {r[0] for r in ROWS}
    assert run(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).collect() == []
