"""Registered queries against their SQL, and the pipeline stage by stage against plain Python."""

import brute
import pytest
from check import compare

import corpus_pipeline
from setwise.llm import bpe, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, name):
    assert compare(spark, FOLDER, name).startswith("ok" if name in queries.ORACLES else "rows-only"), compare(spark, FOLDER, name)


def test_pipeline(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    kept = {r.doc_id for r in queries.QUERIES["op8_quality"](spark, FOLDER).collect() if r.kept}
    links = brute.similar_pairs([(i, docs[i].text) for i in sorted(kept)], 5, 80)
    least = {i: i for i in kept}
    for a, b in sorted(links) * 3:
        least[a] = least[b] = min(least[a], least[b])
    kept = {i for i in kept if least[i] == i}
    dirty = {r.doc_id for r in queries.QUERIES["op9_contamination"](spark, FOLDER).collect() if r.contaminated}
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == kept - dirty
    spans = {r.doc_id: r.spans for r in queries.QUERIES["op2_personal_data"](spark, FOLDER).collect()}
    tokens = {i: t for t, i in bpe.read_ranks(corpus_pipeline.RANKS).items()}
    assert all(r.decodes for r in rows)
    for r in rows:
        text = b"".join(tokens[int.from_bytes(r.ids[i : i + 4], "little")] for i in range(0, len(r.ids), 4)).decode()
        assert (text == docs[r.doc_id].text) == (not spans[r.doc_id])


def test_license_plan_has_no_python(spark, plan_of):
    plan = plan_of(queries.QUERIES["op7_licenses"](spark, FOLDER))
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
