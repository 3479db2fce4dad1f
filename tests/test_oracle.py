"""Every registered query against its SQL on the smallest tables."""

import os

import oracle
import pytest

from wardline.plans.registry import load_all

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
# Small tables do not fill every branch of these; they are compared at the next size.
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def connections():
    return {folder: oracle.connect(folder) for folder in {FOLDER, LARGER}}


@pytest.mark.parametrize("name", list(load_all()))
def test_query_agrees_with_sql(spark, connections, name):
    problem = oracle.compare(spark, connections[FOLDER], FOLDER, name)
    if problem in ("the SQL returns no rows", "no rows"):
        problem = oracle.compare(spark, connections[LARGER], LARGER, name)
    assert problem is None, problem


def test_whole_queries_hold_what_the_cut_ones_leave_out(spark):
    run = lambda name: load_all()[name].run(oracle.Tables(spark, LARGER))
    several = run("detect_every_offset").groupBy("doc_id", "pattern_id").count().where("count > 1")
    assert several.where("doc_id % 61 = 0").count() > 0
    merged = run("collapse_every_view").where("pattern_id = 'stripe-live'").collect()
    for rest, view in ((0, "newline-fold"), (1, "unicode"), (2, "unicode"), (3, "base64")):
        assert any(r.doc_id % 67 == rest and view in r.views for r in merged), rest
    spans = {(r.doc_id, r.auth_id, r.original_index) for r in merged if r.doc_id % 61 == 0}
    assert len(spans) > len({s[:2] for s in spans})
    blocks = run("document_metrics").agg({"duplicate_blocks": "sum"}).first()[0]
    assert blocks == run("duplicate_blocks").count() > 0
