"""Drafts, patches, frozen sets and causes on small fixtures."""

import pytest
from pyspark.sql import functions as F

from loomspan import schemas
from loomspan.operators import drafts


def test_drafts_from_a_table(spark):
    rows = spark.createDataFrame([(1, " Sure big profit ", "finance"), (2, " ", "x"), (3, "x", None), (51, "late one", "x")], "row_no int, keyword string, category string")
    cases = drafts.draft_cases(rows, F.lit("2024-01-01 00:00:00").cast("timestamp"), "a.csv")
    got = drafts.drafts(cases, spark.createDataFrame([], schemas.RULE)).orderBy("id").collect()
    assert [r["id"] for r in got] == ["risk_draft_20240101000000", "risk_draft_20240101000001"]
    assert [[g["any_of"] for g in r["conditions"]["all_of"]] for r in got] == [[["sure"], ["profit"]], [["x"], ["to be sorted"]]]
    assert got[0]["risk_domain"] == "finance" and got[0]["review_status"] == "draft" and got[0]["source"]["provenance_status"] == "synthetic_unverified"
    again = spark.createDataFrame(got, schemas.RULE).withColumn("severity_floor", F.lit(80.0)).withColumn("review_status", F.lit("reviewed"))
    copied = drafts.drafts(cases.withColumn("matched_id", F.lit(got[0]["id"])), again).orderBy("id").collect()
    assert len(copied) == 2 and all(r["severity_floor"] == 80 and r["risk_domain"] == "finance" and r["review_status"] == "draft" for r in copied) and copied[1]["surface_meaning"] == "x"


def test_patched(spark):
    base = spark.createDataFrame([("a", 1, "r", ["t"], "s0", "m", "u", "reviewed"), ("b", 1, "q", None, "s0", "m", "u", "draft")], "id string, revision int, risk_reason string, recent_context_tags array<string>, source string, memo string, updated_at string, review_status string")
    sources = spark.createDataFrame([("a", "s1"), ("b", "s2")], "id string, source string")
    changes = spark.createDataFrame([("a", "new")], "id string, risk_reason string")
    got = {r["id"]: r for r in drafts.patched(base, sources, changes, "tag", "note", "now").collect()}
    assert (got["a"]["risk_reason"], got["b"]["risk_reason"]) == ("new", "q") and got["a"]["recent_context_tags"] == ["t", "tag"] and got["b"]["recent_context_tags"] == ["tag"]
    assert all(r["revision"] == 2 and r["review_status"] == "draft" for r in got.values()) and got["b"]["source"] == "s2"
    with pytest.raises(Exception, match="no source for b"):
        drafts.patched(base, sources.where("id = 'a'"), changes, "tag", "note", "now").collect()


def test_frozen_sets(spark):
    rows = [("ad", "u1", "x", "one"), ("ad", "u1", "y", "two"), ("safe", "u2", "x", "three")]
    cases = spark.createDataFrame(rows, "source_type string, source_url string, domain string, text string")
    assert sorted(r["case_id"] for r in drafts.numbered(cases, "text").collect()) == ["FB001", "FB002", "FB003"]
    check = lambda c, **k: drafts.set_checks(c, **({"sizes": {"ad": 2, "safe": 1}, "least_sources": 2, "source_cap": 2, "domains": ("x", "y")} | k)).first()
    assert check(cases)["passed"] and not check(cases, source_cap=1)["source_cap"] and not check(cases.unionByName(cases))["texts_once"]
    assert not check(cases.limit(0))["passed"]


def test_root_causes(spark):
    rows = [("none", "safe"), ("false_positive", "safe"), ("score_mismatch", "risky"), ("false_negative", "risky"), ("false_negative", "ambiguous"), (None, None)]
    got = spark.createDataFrame(rows, "issue string, expected string").select(drafts.root_cause(F.col("issue"), F.col("expected")).alias("c")).collect()
    assert [r["c"] and r["c"]["layer"] for r in got] == [None, "engine", "scoring", "skill_bundle", "evaluation_only", None]
