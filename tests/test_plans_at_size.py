"""What a plan must not do on large tables: parse a text once for each field, or deal texts by their rule."""

from pyspark.sql import functions as F

from loomspan.operators import fusion, interpreter, privacy
from loomspan.plans import book_queries, review_queries

SF = "/root/testdata/sf0.001"


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_records_are_parsed_once(spark):
    for query in (book_queries.export_rules, book_queries.export_rewrites, book_queries.export_sources, book_queries.rules_validated):
        assert _plan(query(spark, SF)).count("from_json(StructField(schema_version") <= 2, query.__name__


def test_drafts_stay_where_their_texts_are(spark):
    plan = review_queries.interpreted_drafts(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_runs_of_cue_words_work_a_text_out_once(spark):
    """one lower form, one search for an expression, a payload parsed for its errors and once for its fields."""
    plan = _plan(interpreter.by_cue_words(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")))
    assert plan.count("from_json(StructField(") <= 2 and plan.count("lower(") == 1 and plan.count("RLIKE(") <= 6 + 6 + 1 + 2


def test_searches_behind_words_are_the_same(spark):
    rows = ["news", "newsy", "Breaking NEWS, now", "butter now", "but then, now", "but", "Yet\nnow", "100  %", "100 % free", "5 cm best", "cm best", "up to best", "exaggerated", "a@b.co", "@", "A.B@C.DE Name: Bob Stone", "Name: bob", "Name:Bob", "Customer: X", "Customer: Xy", None, ""]
    got = fusion.classify_mock(spark.createDataFrame(list(enumerate(rows)), "k int, text string")).withColumn("kinds", F.transform(privacy.mask_ranges(F.col("text")), lambda r: r["kind"]))
    assert got.columns[:3] == ["k", "text", "speech_act"] and not {"_lower", "_strength"} & set(got.columns)
    found = {rows[r["k"]]: r for r in got.collect()}
    assert {t for t, r in found.items() if r["speech_act"] != "claim"} == {"news", "Breaking NEWS, now", "exaggerated"}
    assert {t: r["claim_strength"] for t, r in found.items() if r["claim_strength"] != "none"} == {"100 % free": "absolute", "5 cm best": "strong", "up to best": "limited"}
    assert {t: r["kinds"] for t, r in found.items() if r["kinds"]} == {"a@b.co": ["email"], "A.B@C.DE Name: Bob Stone": ["email", "name"], "Customer: Xy": ["name"]}
