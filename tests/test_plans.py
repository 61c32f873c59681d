"""Shapes of plans: filters and columns reach the scan, no nested loops over tables, top-k without a full sort."""

from __future__ import annotations

import os

import pytest

from postloom.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_feed(spark):
    p = plan(registry.queries()["feed_topk"](spark, DIR))
    assert "TakeOrderedAndProject" in p and "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,O)" in p and "o_orderdate" not in p


@pytest.mark.parametrize("name", ["star_join_revenue", "undelivered_antijoin", "stage1_matches", "jw_title_pairs", "simhash_pairs", "notify_once", "upsert_latest", "robots_check", "gazetteer_resolve", "p4_found"])
def test_no_nested_loops(spark, name):
    p = plan(registry.queries()[name](spark, DIR))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["pipeline_counts", "role_rule_ladder", "url_canonical", "title_normalize", "comp_percentile_ladder", "yield_ema"])
def test_no_python(spark, name):
    p = plan(registry.queries()[name](spark, DIR))
    assert not any(x in p for x in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow"))


def test_semantic_candidates_are_not_neighbouring_ids(spark, tmp_path):
    """Close vectors whose ids are far apart are compared and come out as one to merge."""
    rows = [(i, [float(j == i % 40) + 0.01 * (i // 40) for j in range(40)], "x") for i in range(80)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label string").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r["a"], r["b"]): r["band"] for r in registry.queries()["semantic_candidate_bands"](spark, str(tmp_path)).collect()}
    assert {p for p, band in got.items() if band == "merge"} == {(i, i + 40) for i in range(40)}


def test_listed_names_are_never_dropped(spark):
    """All names come, however many: they are a table."""
    from postloom.plans.cleaning import listed_names

    ref = spark.read.parquet(f"{DIR}/location_ref.parquet").collect()
    want = {n for r in ref for n in [r["canonical"], *(r["aliases"] or [])]}
    assert {r["name"] for r in listed_names(spark, DIR).collect()} == want and any(" and " in n for n in want)
