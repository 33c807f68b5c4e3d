"""The matching engine, privacy, fusion, evaluation and cache on small fixtures."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import evaluate, fusion, matching, privacy, rulebook
from loomspan.operators.rules import LanguagePack, Policy, Rule
from loomspan.streaming import cache

PACK = LanguagePack()


def analyzed(spark, texts, rules, policy=None):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return matching.analyze(frame, rules, policy, PACK).orderBy("doc_id").collect()


def rule(**more):
    base = {"id": "risk_a", "category": "c", "pattern_type": "p", "triggers": ("profit",), "contexts": ("certain",), "severity_floor": 60}
    return Rule(**(base | more))


def test_scores_by_policy(spark):
    rules = [rule(), rule(id="risk_b", pattern_type="q", contexts=("sure",))]
    text = ["Profit is certain and sure."]
    assert analyzed(spark, text, rules)[0]["final_score"] == 62
    assert analyzed(spark, text, rules, Policy(corroboration_per_pattern=10, max_corroboration=20))[0]["final_score"] == 70


def test_scope_distance_guards_and_nulls(spark):
    texts = [
        "Profit is certain.", "Profit is here. It is certain.", "Profit " + "x " * 40 + "certain.", None, "", "Profits are certain.",
        "Profit is certain, but this is prohibited.", "It is prohibited to say profit is certain.", "PROFIT is CERTAIN",
    ]
    found = [r["status"] for r in analyzed(spark, texts, [rule()])]
    assert found == ["review", "no_match", "no_match", "no_match", "no_match", "no_match", "review", "no_match", "review"]


def test_adjacent_sentences(spark):
    texts = ["Profit grows. All certain.", "Profit grows. No. All certain.", "Profit grows.\n\nAll certain."]
    found = analyzed(spark, texts, [rule(scope="paragraph")])
    assert [len(r["matches"]) for r in found] == [1, 0, 0]


def test_support_and_exclusion(spark):
    r = rule(any_of=("today",), none_of=("maybe",))
    texts = ["Profit is certain today.", "Profit is certain.", "Profit maybe certain today.", "Maybe so, but profit is certain today."]
    assert [len(x["matches"]) for x in analyzed(spark, texts, [r])] == [1, 0, 0, 1]
    assert len(analyzed(spark, ["profit profit"], [rule(contexts=("profit",))])[0]["matches"]) == 1
    assert len(analyzed(spark, ["profit"], [rule(contexts=("profit",))])[0]["matches"]) == 0


def test_rule_order_does_not_matter(spark):
    rules = [rule(), rule(id="risk_b", category="d", severity_floor=82, dominant=True), rule(id="risk_c", category="e", contexts=("is",))]
    a, b = (analyzed(spark, ["Profit is certain."], x)[0].asDict(recursive=True) for x in (rules, rules[::-1]))
    assert a == b and a["status"] == "high" and a["final_score"] == 87
    with pytest.raises(ValueError):
        matching.find_matches(spark.createDataFrame([(1, "x")], "doc_id long, text string"), [rule(review_status="draft")])


def test_highlight_joins_to_the_text(spark):
    hits = "array<struct<start:int,end:int,role:string>>"
    rows = [("abcdef 😀 gh", [(0, 3, "trigger"), (2, 5, "context"), (7, 99, "context")]), ("", []), ("ab", [])]
    got = spark.createDataFrame(rows, f"text string, hits {hits}").select("text", matching.highlight(F.col("text"), F.col("hits")).alias("h")).collect()
    for r in got:
        assert "".join(x["text"] for x in r["h"]) == r["text"]
    assert [x["role"] for x in got[0]["h"]] == ["trigger", "both", "context", "plain", "context"]


def test_segments_and_normal_forms(spark):
    text = "It is 3.5% or a.b.  Next!\n \nLast。 "
    row = spark.createDataFrame([(text,)], "t string").select(T.sentences(F.col("t")).alias("s"), T.squeezed(F.col("t")).alias("n"), T.squeezed_nfkc(F.lit("１００ Ａ")).alias("k"), T.levelled_with_map(F.lit("a\r\n１")).alias("m"), T.utf16_length(F.lit("🔥x")).alias("u")).first()
    assert [x["text"].strip() for x in row["s"]] == ["It is 3.5% or a.b.", "Next!", "Last。"] and [x["par"] for x in row["s"]] == [0, 0, 1]
    assert all(text[x["start"] : x["end"]] == x["text"] for x in row["s"])
    assert row["n"] == "it is 3.5% or a.b. next! last。" and row["k"] == "100 a" and row["m"]["text"] == "a\n1" and row["m"]["ends"][1] == 3 and row["u"] == 3


def test_mask_keeps_the_length(spark):
    text = "Name: Ann Lee, ann@example.org, +1 (555) 123-4567, 1234 5678 9012 3456, 12 Main Street"
    r = privacy.prepare(spark.createDataFrame([(text,), ("",), (None,)], "text string")).collect()
    assert len(r[0]["model_text"]) == len(text) and len(r[0]["mask_ranges"]) == 5 and "example" not in r[0]["model_text"] and not r[1]["is_masked"]


def test_mask_of_whole_texts(spark, tmp_path):
    from loomspan.plans import registry

    pieces = ["Name: Ann Lee", "ann@example.org", "+1 (555) 123-4567", "1234 5678 9012 3456", "12 Main Street", "123-45-67890", "Customer: Bo", "🔥", "x7 of 99", "a@b.co+44 20 1234 5678"]
    rng = random.Random(4)
    long = lambda n: " ".join(rng.choice([*pieces, "plain words", "more, of it"]) for _ in range(n))
    rows = [(1, "word " * 500 + ". " + " ; ".join(pieces)), (2, ""), (3, None), (4, "clean " * 900), *((k, long(rng.randint(1, 300))) for k in range(10, 30))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in registry.queries()["mask_pii_whole"](spark, str(tmp_path)).collect()}
    assert "mask_pii_whole" not in registry.oracle_sql() and got[3]["masked"] is None and got[3]["n_ranges"] == 0
    for doc, text in rows:
        if text is None:
            continue
        hits = []
        for n, (kind, rx) in enumerate(privacy.MASK_PATTERNS):
            if kind == "name":  # Python looks back over one length at a time
                rx = "(?:(?<=Name: )|(?<=Applicant: )|(?<=Customer: ))" + rx.split(": )", 1)[1]
            hits += [(m.start(), -m.end(), n, kind) for m in re.finditer(rx, text)]
        spans, out = [], list(text)
        for start, end, _, kind in sorted(hits):
            if spans and start < spans[-1][2]:
                spans[-1][2] = max(spans[-1][2], -end)
            else:
                spans.append([kind, start, -end])
        for _, start, end in spans:
            out[start:end] = privacy.MASK * (end - start)
        assert (got[doc]["n_ranges"], got[doc]["masked"]) == (len(spans), "".join(out)), doc
        assert got[doc]["ranges"] == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    assert {x.split(":")[0] for x in got[1]["ranges"].split(",")} == {k for k, _ in privacy.MASK_PATTERNS if k != "identifier"} and min(int(x.split(":")[1]) for x in got[1]["ranges"].split(",")) > privacy.MAX_CHARS


def payload(**more):
    base = {
        "schema_version": "1.1.0", "risk_intent": "direct_promotional", "speech_act": "claim", "claim_target": "general", "context_relation": "supports", "actor": "advertiser", "claim_strength": "strong",
        "policy_relevance": "substantiation", "risk_family": "urgency", "confidence": 0.9, "evidence_spans": [{"start": 0, "end": 3, "text": "now"}], "policy_reason": "DIRECT_STRONG_RESULT",
    }
    return json.dumps(base | more)


def test_payload_errors(spark):
    rows = [payload(), payload(schema_version="1.0.0"), payload(extra=1), payload(confidence="0.9"), payload(evidence_spans=[{"start": 0, "end": 2, "text": "now"}]), payload(speech_act="warning"), "[]", None, payload(evidence_spans=[{"start": 4, "end": 7, "text": "●●●"}])]
    frame = spark.createDataFrame([(k, r, "now ●●●", "now abc", [(4, 7, "name")]) for k, r in enumerate(rows)], "k int, raw string, model_text string, original_text string, mask_ranges array<struct<start:int,end:int,kind:string>>")
    got = privacy.validated(frame).orderBy("k").collect()
    assert [r["errors"] for r in got] == [[], ["version"], ["unknown_key"], ["confidence"], ["direct_without_span", "span_text"], ["direct_not_claim", "telling_supports"], ["not_an_object"], ["not_an_object"], ["direct_without_span", "span_masked"]]
    assert got[0]["payload"]["confidence"] == 0.9 and got[1]["payload"] is None


def test_quotes():
    assert privacy.resolve_quotes("a b a", ["a"]) is None
    assert privacy.resolve_quotes("x a b . . . a", ["a", "b"]) == [(2, 3), (4, 5)]
    assert privacy.resolve_quotes("a b a", ["a", "b"]) is None and privacy.resolve_quotes("a", ["q"]) is None


def test_import_and_merge(spark):
    cols = ["id", "revision", "category", "severity_floor"]
    has = spark.createDataFrame([("a", 1, "x", 1.0), ("b", 1, "x", 1.0), ("c", 1, "x", 1.0)], "id string, revision int, category string, severity_floor double")
    new = spark.createDataFrame([("a", 1, "x", 1.0), ("b", 2, "x", 1.0), ("c", 1, "y", 1.0), ("d", 1, "x", 1.0)], has.schema)
    classes = rulebook.import_classes(has, new, cols)
    assert {r["id"]: r["kind"] for r in classes.collect()} == {"a": "same", "b": "update", "c": "conflict", "d": "new"}
    assert rulebook.import_summary(classes, has).first()["final_count"] == 4
    merged = rulebook.merged_book(has, new, cols)
    assert merged.count() == 4 and rulebook.merged_book(merged, new, cols).exceptAll(merged).count() == 0


def test_percentile_and_rates(spark):
    frame = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "v double")
    assert evaluate.nearest_rank(frame, "v", 0.95).first()["at_rank"] == 4
    assert evaluate.nearest_rank(frame.limit(0), "v", 0.95).first()["at_rank"] == 0
    empty = spark.createDataFrame([], "expected string, status string").agg(*evaluate.metrics()).first()
    assert empty["n"] == 0 and empty["recall"] is None


def test_decisions(spark):
    base = {"text": "x", "rule_text": "risk_finance", "rules_status": "high", "final_score": 85.0, "ok": True, "timed_out": False, "exhausted": False, "validation_ms": 0, "risk_intent": "direct_promotional", "speech_act": "claim", "context_relation": "supports", "policy_relevance": "potentially_high", "risk_family": "financial_guarantee", "claim_strength": "strong", "confidence": 0.9, "n_spans": 1}
    rows = [{}, {"risk_family": "legal_outcome"}, {"ok": False, "timed_out": True}, {"risk_intent": "contextual_only", "speech_act": "condition", "context_relation": "conditions"}, {"confidence": 0.3}]
    schema = "k int, text string, rule_text string, rules_status string, final_score double, ok boolean, timed_out boolean, exhausted boolean, validation_ms int, risk_intent string, speech_act string, context_relation string, policy_relevance string, risk_family string, claim_strength string, confidence double, n_spans int"
    frame = spark.createDataFrame([(k, *(base | r).values()) for k, r in enumerate(rows)], schema)
    got = [r["decision"] for r in fusion.careful(fusion.decide(frame)).orderBy("k").collect()]
    assert [(g["status"], g["score"]) for g in got] == [("high", 85.0), ("review", 69.0), ("review", 69.0), ("review", 69.0), ("review", 69.0)]
    assert got[2]["reasons"] == ["interpreter_timeout"] and got[1]["reasons"] == ["risk_family_mismatch"]


def test_cache_batch(spark):
    rows = [("a", 1, 0.0, True), ("a", 2, 899.0, True), ("a", 3, 900.0, False), ("b", 4, 5.0, True), ("a", 5, 1000.0, True), ("a", 6, 1899.5, None)]
    got = cache.cache_hits(spark.createDataFrame(rows, "key string, id long, at double, ok boolean")).orderBy("id").collect()
    # Exactly as old as the time to live is a miss, and an invalid result is not stored.
    assert [r["hit"] for r in got] == [False, True, False, False, False, True]


def plain_cache(rows, ttl, most):
    """One loop over all requests, as a list of [key, expires], the least recently used first."""
    held, out = [], {}
    for at, number, key, ok in sorted((r[2], r[1], r[0], r[3]) for r in rows if r[0] is not None and r[2] is not None):
        entry = next((e for e in held if e[0] == key), None)
        if entry:
            held.remove(entry)
        if entry and entry[1] > at:
            held.append(entry)
            out[number] = True
            continue
        out[number] = False
        if ok:
            held = [e for e in held if e[1] > at]
            held = held[max(0, len(held) - most + 1) :] + [[key, at + ttl]]
    return out


@pytest.mark.parametrize(("ttl", "most", "ranges", "keys"), [(50, 4, 5, 8), (1000, 3, 7, 5), (10, 256, 4, 30), (400, 40, 9, 60), (5, 1, 1, 3)])
def test_lru_cache_is_one_loop(spark, ttl, most, ranges, keys):
    rng = random.Random(ttl)
    rows = [(str(int(rng.paretovariate(0.8)) % keys), k, float(rng.randint(0, 600)), rng.random() < 0.9) for k in range(900)]
    rows += [(None, 1000, 5.0, True), ("1", 1001, None, True)]
    frame = spark.createDataFrame(rows, "key string, id long, at double, ok boolean").repartition(3)
    got = {r["id"]: r["hit"] for r in cache.lru_hits(frame, ttl, most, ranges).collect()}
    want = plain_cache(rows, ttl, most)
    assert got == want and len(set(want.values())) == 2
    assert cache.lru_hits(frame.limit(0), ttl, most, ranges).count() == 0


def test_cache_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 899.0), ("a", 3, 900.0), ("b", 4, 5.0)], "key string, id long, at double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    # A stream with timeouts goes on for ever: it is stopped when it has taken all that is there.
    query = cache.cache_hits_stream(stream).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp")).start()
    until = time.time() + 40
    while spark.table("hits").count() < 4 and time.time() < until:
        time.sleep(0.5)
    query.stop()
    assert [r["hit"] for r in spark.table("hits").orderBy("id").collect()] == [False, True, False, False]


def test_rules_from_lines(spark, tmp_path):
    from loomspan.sources import files

    good = {"schema_version": "2.0.0", "id": "risk_one", "category": "c", "pattern_type": "p", "conditions": {"all_of": [{"group_id": "trigger", "any_of": ["ab"]}, {"group_id": "context", "any_of": ["cd"]}]}, "severity_floor": 50, "confidence": 0.5, "created_at": "t", "updated_at": "t", "review_status": "draft"}
    old = {"id": "risk_two", "category": "c", "patternType": "p", "trigger_patterns": ["ab"], "contextPatterns": ["cd"], "severityFloor": 50, "confidence": 0.5, "createdAt": "t", "updatedAt": "t"}
    lines = [json.dumps(good), json.dumps(old), json.dumps(good), "no json", json.dumps(good | {"id": "risk_six", "schema_version": "9"})]
    (tmp_path / "r.jsonl").write_text("﻿" + "\n".join(lines))
    rules, issues = files.read_rules(spark, str(tmp_path / "r.jsonl"))
    found = {r["id"]: r for r in rules.collect()}
    assert set(found) == {"risk_one", "risk_two"} and found["risk_two"]["conditions"]["max_distance"] == 48 and found["risk_two"]["review_status"] == "draft"
    assert sorted(e for r in issues.collect() for e in r["errors"]) == ["json", "repeated_id", "version"]
    assert files.parse_csv('a,"x ""q"", y\nz"\r\n,\n\nb') == [["a", 'x "q", y\nz'], ["b"]]
