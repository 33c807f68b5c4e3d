"""Bundles, the stored book, repairs, samples and the normal forms in the engine."""

import json

import pytest
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import evaluate, matching, privacy, store
from loomspan.operators.rules import LanguagePack, Policy, Rule
from loomspan.sources import bundle

GOOD = {
    "schema_version": "2.0.0", "id": "risk_one", "category": "c", "pattern_type": "p", "conditions": {"all_of": [{"group_id": "trigger", "any_of": ["ab"]}, {"group_id": "context", "any_of": ["cd"]}]}, "severity_floor": 50.0,
    "confidence": 0.5, "created_at": "t", "updated_at": "t", "review_status": "reviewed", "risk_reason": "r", "safe_rewrite": ["s"], "risk_summary": "x", "risk_domain": "d", "dominant_risk": True, "recent_context_tags": ["n", "m"],
    "source": {"title": "t", "source_id": "i", "url": "https://a.b"},
}


def test_bundle_round_trip(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / bundle.RULES).write_text("\n".join(json.dumps(GOOD | x) for x in ({}, {"id": "risk_two", "category": "e"}, {"id": "bad id"})))
    (folder / bundle.SEVERITY).write_text('{"no_match_score": 3}')
    (folder / bundle.TREND).write_text("[1]")
    (folder / "notes.txt").write_text("x")
    got = bundle.read_bundle(spark, str(folder))
    assert got.policy.no_match_score == 3 and sorted(got.issues) == ["notes.txt: not a file of a bundle", f"{bundle.TREND}: not a JSON object"]
    assert {r["id"] for r in got.rules.collect()} == {"risk_one", "risk_two"} and got.line_issues.count() == 1
    bundle.write_bundle(got.rules, str(tmp_path / "out"), Policy(no_match_score=4))
    again = bundle.read_bundle(spark, str(tmp_path / "out"))
    assert again.issues == [] and again.policy.no_match_score == 4 and again.rules.exceptAll(got.rules).count() == 0 and again.rules.count() == 2
    (tmp_path / "empty").mkdir()
    assert bundle.read_bundle(spark, str(tmp_path / "empty")).issues == [f"{bundle.RULES}: missing"]


def test_store(spark, tmp_path):
    book = spark.createDataFrame([("a", "1", "2", "reviewed"), ("b", "2", "1", "draft")], "id string, created_at string, updated_at string, review_status string")
    assert [r["id"] for r in store.newest_first(book).collect()] == ["a", "b"] and [r["id"] for r in store.page(book).collect()] == ["b", "a"]
    assert store.by_key(book, "id", "b").count() == 1 and store.replaced(book, book.limit(1), confirmed=True).count() == 1
    with pytest.raises(ValueError):
        store.replaced(book, book)
    store.checked_write(book, str(tmp_path / "t"), 2)
    with pytest.raises(RuntimeError):
        store.checked_write(book, str(tmp_path / "u"), 3)
    stored = spark.createDataFrame([('{"id": "x"}',), ("[]",), ("no",), (None,)], "payload string")
    assert [r["id"] for r in store.parsed(stored, "id string").collect()] == ["x"]
    cases = spark.createDataFrame([("1", "k"), ("2", "k"), ("3", "z")], "case_id string, category string")
    own, other = spark.createDataFrame([("1", ["r1"])], "case_id string, rule_ids array<string>"), spark.createDataFrame([("k", ["r2"])], "category string, rule_ids array<string>")
    assert {r["case_id"]: r["rule_ids"] for r in store.related_rules(cases, own, other).collect()} == {"1": ["r1"], "2": ["r2"], "3": []}


def test_samples_take_a_text_once(spark):
    rows = [(k, f"t{k}", "a") for k in range(1, 6)] + [(6, "t6", "a"), (7, "t6", "b"), (8, "t1", "b"), (9, "t9", "b"), (10, "t9", "b")]
    frame = spark.createDataFrame(rows, "id long, text string, stratum string")
    got = sorted((r["stratum"], r["rank"], r["id"]) for r in evaluate.stratified(frame, ["stratum"], "id", 4).collect())
    assert got == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("a", 4, 4), ("b", 1, 7), ("b", 2, 9)]
    assert evaluate.stratified(frame, ["stratum"], "id", {"a": 1, "b": 2}, strict=True).count() == 3
    with pytest.raises(ValueError):
        evaluate.stratified(frame, ["stratum"], "id", 4, strict=True)


def test_compatibility_forms_are_matched_and_mapped_back(spark):
    texts = ["🔥 ＰＲＯＦＩＴ​ １００ is ｃｅｒｔａｉｎ.", "Profit is certain.", "x\r\nProfit  is certain."]
    rule = Rule("risk_a", "c", "p", ("profit",), ("certain",), severity_floor=60)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in matching.analyze(frame, [rule], None, LanguagePack()).collect():
        (m,) = r["matches"]
        cut = texts[r["doc_id"]][m["t_start"] : m["t_end"]], texts[r["doc_id"]][m["c_start"] : m["c_end"]]
        assert (T.unicodedata.normalize("NFKC", cut[0]).lower(), T.unicodedata.normalize("NFKC", cut[1]).lower()) == ("profit", "certain")


def test_long_texts_are_linear(spark):
    import time

    def seconds(n):
        frame = spark.createDataFrame([("word one. " * n + "12 Main Street, a@b.co " * (n // 10),)], "text string").coalesce(1)
        began = time.perf_counter()
        row = frame.select(F.size(T.sentences(T.levelled(F.col("text")))).alias("s"), F.length(privacy.masked(F.col("text"), privacy.mask_ranges(F.col("text")))).alias("m"), F.length("text").alias("n")).first()
        assert row["m"] == row["n"] and row["s"] >= n
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(80_000) < 60  # a text of a megabyte


def test_dead_patterns(spark):
    assert T.pattern_regex("re:(") is None and T.pattern_regex("re:a*") is None and T.pattern_regex("x") is None
    assert T.pattern_regex("re:a+") and T.pattern_regex("re:[a&&[^b]]+")
