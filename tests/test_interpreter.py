"""Runs of classifiers, quoted payloads, gates of a pilot, and CSV texts."""

import json
import time

import pytest
from pyspark.sql import functions as F

from loomspan import schemas
from loomspan.operators import interpreter, matching, pilot
from loomspan.operators.rules import Rule
from loomspan.sources.files import parse_csv

CLAIM = "We guarantee profit for everyone who invests."


def _payload(**changes):
    base = {k: "none" for k in schemas.PAYLOAD_KEYS} | {
        "schema_version": schemas.PAYLOAD_VERSION, "risk_intent": "contextual_only", "speech_act": "report", "context_relation": "reports", "actor": "reporter", "confidence": 0.9, "evidence_spans": [], "policy_reason": "CONTEXT_REPORT",
    }
    return json.dumps(base | changes)


def _by(rows, key="id"):
    return {r[key]: r for r in rows.collect()}


def test_cue_words(spark):
    texts = spark.createDataFrame([(1, CLAIM), (2, "The court reported a ruling."), (3, None), (4, ""), (5, "  \n "), (6, CLAIM)], "id int, text string")
    got = _by(interpreter.by_cue_words(texts))
    assert len(got) == 6 and all(r["ok"] for r in got.values()) and all(r["errors"] == [] for r in got.values())
    span = got[1]["payload"]["evidence_spans"][0]
    assert got[1]["payload"]["risk_intent"] == "direct_promotional" and span["text"] == CLAIM[span["start"] : span["end"]] == CLAIM
    assert got[2]["payload"]["speech_act"] == "report" and got[3]["payload"]["evidence_spans"] == [] and got[1]["text"] == CLAIM
    assert interpreter.by_cue_words(texts.limit(0)).count() == 0


def test_masked_evidence_fails_the_check(spark):
    texts = spark.createDataFrame([(1, CLAIM + " Write to a.b@example.com")], "id int, text string")
    got = interpreter.by_cue_words(texts).first()
    assert not got["ok"] and got["payload"] is None and "direct_without_span" in got["errors"] and "a.b@" in got["text"]


def test_first_span(spark):
    rows = spark.createDataFrame([(1, "  one two one  ", []), (2, "one two", [(0, 3, "name")]), (3, " ", []), (4, "zero", [])], "id int, t string, r array<struct<start:int,end:int,kind:string>>")
    got = _by(rows.select("id", interpreter.first_span(F.col("t"), F.col("r"), "one").alias("s")))
    spans = {k: [(s["start"], s["end"], s["text"]) for s in r["s"]] for k, r in got.items()}
    assert spans == {1: [(2, 5, "one")], 2: [], 3: [], 4: [(0, 4, "zero")]}


def test_replay(spark):
    texts = spark.createDataFrame([(1, "known"), (2, "unknown"), (3, "broken"), (4, "known")], "id int, text string")
    log = texts.where("id in (1, 3)").select(F.sha2("text", 256).alias("input_hash"), F.when(F.col("id") == 1, F.lit(_payload())).otherwise("{").alias("payload"), F.lit(1).alias("seq"))
    got = _by(interpreter.by_replay(log)(texts))
    assert {k: r["ok"] for k, r in got.items()} == {1: True, 2: False, 3: False, 4: True}


def test_provider(spark):
    good = _payload()
    texts = spark.createDataFrame([(1, "fine"), (2, "slow"), (3, "busy"), (4, "refused"), (5, "breaks"), (6, "nonsense"), (7, "fine"), (8, None)], "id int, text string")

    def complete(text, seen=[]):  # noqa: B006 (the worker's own memory)
        if text == "slow":
            time.sleep(3)
        if text == "busy" and text not in seen:
            seen.append(text)
            raise interpreter.ResourceExhausted(0.01)
        if text == "refused":
            raise interpreter.ResourceExhausted()
        if text == "breaks":
            raise OSError("no")
        return "nonsense" if text == "nonsense" else good

    got = _by(interpreter.by_provider(complete, lanes=2, timeout=1.0)(texts))
    assert {k: (r["ok"], r["timed_out"], r["exhausted"], r["calls"]) for k, r in got.items()} == {
        1: (True, False, False, 1), 2: (False, True, False, 1), 3: (True, False, False, 2), 4: (False, False, True, 1), 5: (False, False, False, 1), 6: (False, False, False, 1), 7: (True, False, False, 1), 8: (True, False, False, 1),
    }


def test_quoted_payloads(spark):
    text = "Sure gain. Sure thing, sure gain twice."
    direct = {"risk_intent": "direct_promotional", "speech_act": "claim", "claim_target": "finance", "context_relation": "supports", "actor": "advertiser", "claim_strength": "strong", "policy_relevance": "substantiation", "risk_family": "financial_guarantee", "policy_reason": "DIRECT_STRONG_RESULT"}

    def raw(quotes, **more):
        found = json.loads(_payload(**direct, **more))
        del found["evidence_spans"]
        return json.dumps(found | {"evidence_quotes": quotes})

    cases = [(1, raw(["Sure gain."])), (2, raw(["not there"])), (3, raw(["gain"])), (4, raw(["Sure gain."], extra=1)), (5, _payload()), (6, "{"), (7, None), (8, raw(["Sure thing", "sure gain"]))]
    rows = spark.createDataFrame([(k, r, text, text, []) for k, r in cases], "id int, raw string, model_text string, original_text string, mask_ranges array<struct<start:int,end:int,kind:string>>")
    got = _by(interpreter.quoted(rows))
    assert [(s["start"], s["end"]) for s in got[1]["payload"]["evidence_spans"]] == [(0, 10)]
    assert [s["text"] for s in got[8]["payload"]["evidence_spans"]] == ["Sure thing", "sure gain"]
    assert all(got[k]["payload"] is None for k in (2, 3, 4, 5, 6, 7))
    assert "quote_unclear" in got[2]["errors"] and "quote_unclear" in got[3]["errors"] and all(got[k]["errors"] == ["not_a_quoted_payload"] for k in (4, 5, 6, 7))


def _runs(spark, rows):
    return spark.createDataFrame(rows, "expected string, domain string, status string, annotated_act string, speech_act string, valid boolean, latency_ms double")


def test_pilot_gate(spark):
    domains = ("health", "finance", "education", "legal", "privacy", "general")
    good = [("risky", d, "high", "", None, True, 10.0) for d in domains] + [("safe", d, "no_match", "", None, True, 20.0) for d in domains]
    gate = lambda rows: pilot.pilot_gate(pilot.pilot_metrics(_runs(spark, rows))).first()
    assert gate(good)["passed"] and gate(good)["near"] and gate(good)["mean_ms"] == 15 and gate(good)["p95_ms"] == 20
    warned = gate([*good, ("safe", "legal", "high", "warning", None, True, 1.0)])
    assert warned["warned_high"] == 1 and not warned["passed"] and not warned["near"]  # one of seven safe cases
    assert not gate([r for r in good if r[1] != "legal"])["gate_domain_recall"]
    empty = gate([])
    assert empty["recall"] is None and not empty["passed"] and empty["p95_ms"] == 0


def test_rerun_gate(spark):
    runs = [("risky", "health", "high", "", None, True, 1.0), ("safe", "health", "no_match", "", None, True, 1.0)]
    metrics = pilot.pilot_metrics(_runs(spark, runs))
    base = spark.createDataFrame([("a", "direct_promotional", "high"), ("b", "direct_promotional", "high")], "case_id string, risk_intent string, status string")
    again = spark.createDataFrame([("a", "contextual_only", "no_match")], base.schema)
    assert pilot.rerun_gate(metrics, base, again, base.where("case_id = 'a'")).first()["viable"]
    assert not pilot.rerun_gate(metrics, base, again, base).first()["viable"]  # b was not run again
    assert pilot.rerun_gate(metrics, base, again, base.limit(0)).first()["all_improved"]


def test_cases_and_smoke(spark):
    a = spark.createDataFrame([(1, "x", "risky"), (2, "y", "safe")], "case_id int, text string, expected_class string")
    both = pilot.cases({"a": a, "b": a.select("case_id", "text")})
    assert {r["case_id"] for r in both.collect()} == {"a:1", "a:2", "b:1", "b:2"} and both.where("dataset = 'b' AND expected_class = ''").count() == 2
    checks = pilot.case_checks(both, 4).first()
    assert checks["count_ok"] and checks["ids_once"] and not pilot.case_checks(both.unionByName(both), 8).first()["ids_once"] and not pilot.case_checks(both.limit(0), 1).first()["count_ok"]
    with pytest.raises(ValueError, match="no source"):
        pilot.cases({})
    runs = spark.createDataFrame([(True, False, False)] * 5, "valid boolean, exhausted boolean, timed_out boolean")
    assert pilot.smoke(runs).first()["passed"] and not pilot.smoke(runs.limit(4)).first()["complete"]


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ('a"b,c"d,e', [["ab,cd", "e"]]), ('﻿x,y\r\n1,"a""b"\r\r\n', [["x", "y"], ["1", 'a"b']]), (",\n\na", [["a"]]), ('a,"open\nrest', [["a", "open\nrest"]]), ("", []), ('""', []), ('a,""', [["a", ""]]), ("a,b\nc", [["a", "b"], ["c"]]), (" \n", [[" "]]),
    ],
)
def test_csv_texts(text, rows):
    assert parse_csv(text) == rows


def test_hybrid(spark):
    rule = Rule("risk_sure_gain", "finance", "sure + profit", ("guarantee",), ("profit",), severity_floor=85, confidence=0.9, domain="finance")
    texts = spark.createDataFrame([(1, CLAIM), (2, "A quiet day."), (3, None)], "id int, text string")
    analyzed = matching.analyze(texts, [rule])
    runs = interpreter.by_cue_words(texts)
    got = _by(interpreter.hybrid(analyzed, runs, "id"))
    assert (got[1]["rules_status"], got[1]["decision"]["status"], got[1]["decision"]["score"]) == ("high", "high", 85.0)
    assert got[2]["decision"]["status"] == got[3]["decision"]["status"] == "no_match" and got[3]["ok"]
    lost = _by(interpreter.hybrid(analyzed, runs.where("id = 2"), "id"))
    assert lost[1]["decision"]["status"] == "review" and lost[1]["decision"]["reasons"] == ["interpreter_provider_failed"] and lost[1]["decision"]["suppressed_high"] and not lost[3]["ok"]
