"""Forms of verdicts, drafts by the engine, variants as data, bundles as engines, intake, and what is reported of runs."""

import hashlib
import re
import unicodedata
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from loomspan import schemas
from loomspan.operators import drafts, evaluate, fusion, matching, privacy, rulebook, verdicts
from loomspan.operators.rules import LanguagePack, Policy, Rule, exported, rules_from, with_variants
from loomspan.sources import bundle, files

RULES = [
    Rule("risk_sure_gain", "finance", "gain + sure", ("profit",), ("guaranteed",), severity_floor=82, confidence=0.9, domain="finance", reason="A gain is promised.", rewrites=("Say what it rests on.",)),
    Rule("risk_cure_all", "health", "cure + all", ("cure",), ("everyone",), severity_floor=66, confidence=0.8, domain="health", reason="A cure is promised.", rewrites=("Name the evidence.",), review_status="draft"),
]


def test_verdicts_against_a_loop(spark):
    rows = [(e, c, s, x, lo, hi, rule, due, ok) for e in ("risky", "safe", "ambiguous", None) for c in ("high", "low") for s, x in (("high", 85.0), ("attention", 72.0), ("review", 40.0), ("no_match", 0.0)) for lo, hi in ((0.0, 79.0), (60.0, 100.0)) for rule in (None, "a", "b") for due in ("no_match", "review") for ok in (True, False)]
    frame = spark.createDataFrame(rows, "e string, c string, s string, x double, lo double, hi double, rule string, due string, ok boolean")
    c = F.col
    got = frame.select(
        "*", verdicts.strict(c("e"), c("s")).alias("v1"), verdicts.by_score(c("e"), c("c"), c("x")).alias("v2"),
        verdicts.by_target(c("s"), c("x"), F.array(F.lit("a")), c("due"), c("lo"), c("hi"), c("rule")).alias("v3"), verdicts.by_repeat(c("e"), c("s"), c("x"), c("lo"), c("hi"), c("ok")).alias("v4"),
    ).collect()
    seen = [set(), set(), set(), set()]
    for r in got:
        kind = r.e if r.e in ("risky", "safe") else "ambiguous"
        strict = {"risky": r.s != "high" and "false_negative", "safe": r.s != "no_match" and "false_positive", "ambiguous": r.s == "high" and "ambiguous_overhigh"}[kind] or ""
        score = {"risky": r.c == "high" and r.x < 70 and "false_negative", "safe": r.x >= 70 and "false_positive", "ambiguous": r.x >= 80 and "ambiguous_high"}[kind] or ""
        hit = r.s == r.due and r.lo <= r.x <= r.hi and (not r.rule or r.rule == "a")
        target = "" if hit else "false_positive" if r.x >= 70 and r.due == "no_match" else "false_negative_or_mismatch"
        last = {"risky": r.s == "no_match" and "false_negative", "safe": r.s != "no_match" and "false_positive", "ambiguous": r.s == "high" and "boundary_overhigh"}[kind] or ""
        repeat = "inconsistent_repeat" if not r.ok else "outside_expected_range" if not r.lo <= r.x <= r.hi else last
        for k, (v, want) in enumerate(((r.v1, strict), (r.v2, score), (r.v3, target), (r.v4, repeat))):
            assert (v.failure_type, v.verdict) == (want, "FAIL" if want else "PASS"), (k, r)
            seen[k].add(want)
    assert [len(x) for x in seen] == [4, 4, 3, 6]
    missing = spark.createDataFrame([("risky", None, None), ("safe", None, None)], "e string, s string, x double").select(verdicts.strict(c("e"), c("s"))["verdict"], verdicts.by_score(c("e"), F.lit("high"), c("x"))["verdict"], verdicts.by_repeat(c("e"), c("s"), c("x"), F.lit(0.0), F.lit(9.0), F.lit(True))["failure_type"])
    assert [tuple(r) for r in missing.collect()] == [("FAIL", "FAIL", "outside_expected_range")] * 2


def test_repeats_have_to_be_there_and_agree(spark):
    one = spark.createDataFrame([(1, 5.0), (2, None), (3, 1.0), (4, 1.0)], "k int, s double")
    two = spark.createDataFrame([(1, 5.0), (2, None), (3, 2.0)], "k int, s double")
    assert {r["k"]: r["consistent"] for r in verdicts.repeat_agreement([one, two], "k", ["s"]).collect()} == {1: True, 2: True, 3: False, 4: False}
    with pytest.raises(ValueError):
        verdicts.repeat_agreement([], "k", ["s"])


def test_drafts_from_the_engine(spark):
    rows = [("Guaranteed profit for you.", "an ad", None, "note"), ("We cure everyone.", None, "", None), ("odd words about a court", "seen", "", None), ("x", "", "own field", None), (None, None, None, None), ("", "track them", None, None)]
    cases = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "text string, description string, domain string, memo string, k int")
    cases = cases.select("text", "description", "domain", F.lit(None).cast("string").alias("occurred_at"), F.lit("https://a.example").alias("source_url"), "memo", F.timestamp_seconds("k").alias("at"), F.lit(1).alias("matches"))
    got = [r for r in drafts.interpreted(cases, RULES, exported(spark, RULES)).orderBy("id").collect()]
    assert [(r["category"], r["risk_domain"]) for r in got] == [("finance", "finance"), ("health", "health"), ("professional services", "legal"), ("reputation", "own field"), ("reputation", "campaign"), ("privacy", "privacy")]
    assert got[0]["severity_floor"] == 82 and got[0]["memo"] == "note" and got[0]["surface_meaning"] == rows[0][0] and got[1]["pattern_type"] == "cure + all"
    words = [[g["any_of"] for g in r["conditions"]["all_of"]] for r in got]
    assert words[0] == [["profit"], ["guaranteed"]] and words[2] == [["odd"], ["court"]] and words[3] == [["x"], ["own field"]] and words[4] == [[], ["campaign"]]
    assert {r["review_status"] for r in got} == {"draft"} and {r["revision"] for r in got} == {1} and got[0]["source"]["provenance_status"] == "provided"
    assert drafts.interpreted(cases.limit(0), RULES, exported(spark, RULES)).count() == 0
    assert set(got[0].asDict()) == {f.split()[0] for f in drafts._NAMES}


def test_variants_as_a_table(spark):
    table = spark.createDataFrame([("gain + sure", "context", "no risk"), ("gain + sure", "context", "no risk"), ("gain + sure", "trigger", "re:earn[a-z]*"), ("other", "trigger", "x"), ("gain + sure", "trigger", None)], "pattern_type string, role string, pattern string")
    pack = with_variants(LanguagePack(variants={("gain + sure", "context"): ("certain",)}), table)
    assert pack.variants["gain + sure", "context"] == ("certain", "no risk")
    texts = spark.createDataFrame([(1, "Earnings at no risk."), (2, "Earnings at some risk.")], "k int, text string")
    scores = lambda p: {r["k"]: r["final_score"] for r in matching.analyze(texts, RULES, Policy(), p).collect()}
    assert scores(LanguagePack()) == {1: 0, 2: 0} and scores(pack)[1] > 80 and scores(pack)[2] == 0
    with pytest.raises(ValueError, match="role"):
        with_variants(LanguagePack(), table.withColumn("role", F.lit("exclusion")))
    rules = spark.createDataFrame([("r", "gain + sure", ["b", "", "b"], None), ("s", None, ["b"], ["c"])], "id string, pattern_type string, trigger array<string>, context array<string>")
    got = {(r["id"], r["role"]): r["patterns"] for r in rulebook.effective_patterns(rules, table).collect()}
    assert got == {("r", "trigger"): ["b", "re:earn[a-z]*"], ("r", "context"): ["no risk"], ("s", "trigger"): ["b"], ("s", "context"): ["c"]}


def test_a_bundle_as_an_engine(spark, tmp_path):
    good = str(tmp_path / "good")
    bundle.write_bundle(exported(spark, RULES), good, Policy(no_match_score=3))
    engine = bundle.load_engine(spark, good)
    assert [r.id for r in engine.rules] == ["risk_sure_gain"] and engine.rules[0].triggers == ("profit",) and engine.policy.no_match_score == 3
    texts = spark.createDataFrame([(1, "Guaranteed profit."), (2, "We cure everyone.")], "k int, text string")
    assert {r["k"]: r["status"] for r in engine.analyze(texts).collect()} == {1: "high", 2: "review"}
    assert rules_from(exported(spark, RULES).orderBy("id")) == sorted((replace(r, reason=r.reason) for r in RULES), key=lambda r: r.id)
    drafts_only = tmp_path / "drafts"
    drafts_only.mkdir()
    (drafts_only / bundle.RULES).write_text("\n".join(r["value"] for r in rulebook.rules_jsonl(exported(spark, RULES[1:]), drafts=True).collect()))
    with pytest.raises(ValueError, match="no reviewed rule"):
        bundle.load_engine(spark, str(drafts_only))
    (drafts_only / bundle.RULES).write_text("no json")
    with pytest.raises(ValueError, match="json"):
        bundle.load_engine(spark, str(drafts_only))
    (drafts_only / "notes.txt").write_text("x")
    with pytest.raises(ValueError, match="notes.txt"):
        bundle.load_engine(spark, str(drafts_only))


def test_files_chosen_one_by_one(spark, tmp_path):
    lines = "\n".join(r["value"] for r in rulebook.rules_jsonl(exported(spark, RULES), drafts=True).collect())
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / bundle.RULES).write_text(lines)
    (tmp_path / "b" / "readme.md").write_text("x")
    one = bundle.read_selected(spark, [f"{tmp_path}/a/{bundle.RULES}", f"{tmp_path}/b/readme.md", f"{tmp_path}/b/{bundle.TREND}"])
    assert one.usable and one.rules.count() == 2 and one.issues == ["readme.md: not a file of a bundle", f"{bundle.TREND}: cannot be read"]
    two = bundle.read_selected(spark, [f"{tmp_path}/a/{bundle.RULES}", f"{tmp_path}/b/{bundle.RULES}"])
    assert not two.usable and two.issues == [f"{bundle.RULES}: chosen twice"] and two.rules.count() == 2
    assert not bundle.read_selected(spark, [f"{tmp_path}/none/{bundle.RULES}"]).usable and bundle.read_selected(spark, []).issues == [f"{bundle.RULES}: missing"]


def test_summary_of_a_table_against_a_loop(spark):
    headers = ["Δ name", " Category", "root_word "]
    rows = [["A  b", " X ", "Root"], ["a b", "x", "root"], ["a b", "X", "ｒｏｏｔ"], ["a", "X"], [" ", "", "\u00a0"], ["a", "", "  "], ["a", "Y", ""], [None, "Y", "r2"], [], ["", "Y", "r2"]]
    frame = spark.createDataFrame([(r,) for r in rows], "cells array<string>")
    level = lambda c: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", c or "").lower()).strip()
    valid = [r for r in rows if len(r) == 3 and any((c or "").strip() for c in r)]
    keys = [tuple(level(c) for c in r) for r in valid]
    want = ("false_advertising", len(rows), len(valid), len(rows) - len(valid), len(keys) - len(set(keys)), len({level(r[2]) for r in valid if (r[2] or "").strip()} - {""}), len(valid))
    got = evaluate.csv_summary(frame, headers).first()
    assert tuple(got[c] for c in ("profile", "total", "valid", "invalid", "duplicates", "unique_roots", "preview")) == want
    assert {(r["name"], r["n"]) for r in evaluate.csv_categories(frame, headers).collect()} == {("X", 2), ("x", 1), ("Y", 3)}
    none = evaluate.csv_summary(frame.limit(0), ["a"]).first()
    assert (none["profile"], none["total"], none["valid"], none["duplicates"], none["preview"]) == ("generic", 0, 0, 0, 0) and evaluate.csv_categories(frame, ["a", "b", "c"]).count() == 0


def test_csv_bytes(spark, tmp_path):
    rows = spark.createDataFrame([("a,b", 'say "x"', " plain "), ("one\ntwo", "", None)], "a string, b string, c string").coalesce(1)
    text = lambda p: next(p.glob("*.csv")).read_bytes().decode()
    one = lambda p: next(p.glob("*.txt")).read_bytes().decode()
    files.write_crlf_csv(rows, str(tmp_path / "crlf"))
    assert one(tmp_path / "crlf") == 'a,b,c\r\n"a,b","say ""x""", plain \r\n"one\ntwo",,\r\n'
    files.write_crlf_csv(rows.limit(0), str(tmp_path / "empty"))
    assert one(tmp_path / "empty") == "a,b,c\r\n"
    files.write_crlf_csv(rows.repartition(2), str(tmp_path / "two"))
    assert all(p.read_bytes().startswith(b"a,b,c\r\n") for p in (tmp_path / "two").glob("*.txt"))
    files.write_csv(rows, str(tmp_path / "all"), quote_all=True)
    assert text(tmp_path / "all").startswith('"a","b","c"\n"a,b","say ""x"""," plain "\n')


def test_labels_of_runs(spark):
    rows = [(True, False, False, True, [], 0), (True, False, False, False, [], 0), (False, True, True, False, [], 3), (False, False, True, False, [], 3), (False, False, False, False, [fusion.NO_SECRET], 3), (False, False, False, False, [], 3), (False, False, False, False, None, None)]
    frame = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "ok boolean, late boolean, full boolean, cached boolean, errors array<string>, ms int, k int").orderBy("k")
    c = F.col
    got = frame.select(fusion.provider_status(c("ok"), c("late"), c("full"), c("cached"), c("errors"), c("ms")).alias("s"), fusion.fallback_kind(c("late"), c("full"), c("ok"), c("ms")).alias("f")).collect()
    assert [r["s"] for r in got] == ["cached", "ready", "timeout", "resource_exhausted", "secret_unavailable", "validation_error", "provider_error"]
    assert [r["f"] for r in got][2:] == ["timeout", "resource_exhausted", "validation", "validation", "provider_error"]


def test_keys_of_masked_input(spark):
    texts = ["write ann@example.org now", "write bob@example.org now", "a" * 3000, "a" * 2000 + "b"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = privacy.prepare(frame).select("k", "model_text", privacy.cache_key(F.col("model_text")).alias("key")).orderBy("k").collect()
    assert [r["key"] for r in got] == [hashlib.sha256(f"{schemas.PAYLOAD_VERSION}:1:{r['model_text']}".encode()).hexdigest() for r in got]
    assert got[0]["key"] != got[2]["key"] == got[3]["key"] and "ann@" not in got[0]["model_text"]
