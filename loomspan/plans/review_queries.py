"""Queries over forms of verdicts, drafts by the engine, bundles as engines, intake and variants, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import drafts, evaluate, fusion, matching, privacy, rulebook, verdicts
from loomspan.operators.rules import DEMO_PACK, DEMO_RULES, Policy, exported
from loomspan.plans import data_queries
from loomspan.plans import matching_sql as S
from loomspan.sources import bundle
from loomspan.sources.tables import new_path
from loomspan.sources.tables import table as _table

#: A second run's policy: it gives further categories more weight.
_OTHER = Policy(second_weight=0.5, third_weight=0.25)
_REVIEWED = [r for r in DEMO_RULES if r.review_status == "reviewed"]
_HEADERS = ["keyword", " Category ", "root_word"]


def engine_verdicts(spark, sf_dir):
    """The engine's results against the labels in each form of a verdict; the repeat is a run by another policy."""
    texts = _table(spark, sf_dir, "documents", "doc_id", "text")
    first, second = (matching.analyze(texts, DEMO_RULES, p, DEMO_PACK) for p in (Policy(), _OTHER))
    agreed = verdicts.repeat_agreement([first, second], "doc_id", ["final_score", "status"])
    cases = data_queries._cases(spark, sf_dir).select("doc_id", "expected", F.when(F.length("text") % 2 == 0, "high").otherwise("low").alias("confidence"))
    run = first.select("doc_id", "final_score", F.col("status"), F.transform("matches", lambda m: m["rule_id"]).alias("rule_ids"))
    rows = cases.join(run, "doc_id").join(agreed, "doc_id")
    c, risky, safe = F.col, F.col("expected") == "risky", F.col("expected") == "safe"
    least, most = F.when(risky, 60.0).otherwise(0.0), F.when(risky, 100.0).when(safe, 0.0).otherwise(79.0)
    due = F.when(safe, "no_match").otherwise("review")
    forms = {
        "strict": verdicts.strict(c("expected"), c("status")), "by_score": verdicts.by_score(c("expected"), c("confidence"), c("final_score")),
        "by_target": verdicts.by_target(c("status"), c("final_score"), c("rule_ids"), due, least, most, F.when(risky, "risk_on_was")),
        "by_repeat": verdicts.by_repeat(c("expected"), c("status"), c("final_score"), least, most, c("consistent")),
    }
    return rows.select("doc_id", "consistent", *(v["failure_type"].alias(k) for k, v in forms.items()), *(v["verdict"].alias(f"{k}_verdict") for k, v in forms.items()))


def _verdicts_sql() -> str:
    target = "status = due AND final_score BETWEEN lo AND hi AND (expected <> 'risky' OR contains('|' || rule_ids || '|', '|risk_on_was|'))"
    kinds = {
        "strict": "CASE WHEN expected = 'risky' AND status <> 'high' THEN 'false_negative' WHEN expected = 'safe' AND status <> 'no_match' THEN 'false_positive' WHEN expected = 'ambiguous' AND status = 'high' THEN 'ambiguous_overhigh' ELSE '' END",
        "by_score": "CASE WHEN expected = 'risky' AND n_text % 2 = 0 AND final_score < 70 THEN 'false_negative' WHEN expected = 'safe' AND final_score >= 70 THEN 'false_positive' WHEN expected = 'ambiguous' AND final_score >= 80 THEN 'ambiguous_high' ELSE '' END",
        "by_target": f"CASE WHEN {target} THEN '' WHEN final_score >= 70 AND due = 'no_match' THEN 'false_positive' ELSE 'false_negative_or_mismatch' END",
        "by_repeat": "CASE WHEN NOT consistent THEN 'inconsistent_repeat' WHEN NOT final_score BETWEEN lo AND hi THEN 'outside_expected_range' WHEN expected = 'risky' AND status = 'no_match' THEN 'false_negative' WHEN expected = 'safe' AND status <> 'no_match' THEN 'false_positive' WHEN expected = 'ambiguous' AND status = 'high' THEN 'boundary_overhigh' ELSE '' END",
    }
    expected = "CASE WHEN toxic = 1 THEN 'risky' WHEN quality = 1 THEN 'safe' ELSE 'ambiguous' END"
    return f""", again AS (WITH {S.scores_sql(_OTHER)} SELECT doc_id, final_score, status FROM scored),
named AS (SELECT doc_id, string_agg(rule_id, '|') AS rule_ids FROM m GROUP BY doc_id),
j AS (SELECT s.doc_id, s.status, s.final_score, {expected} AS expected, length(d.text) AS n_text, coalesce(rule_ids, '') AS rule_ids, s.final_score = a.final_score AND s.status = a.status AS consistent
      FROM scored s JOIN again a ON a.doc_id = s.doc_id JOIN documents d ON d.doc_id = s.doc_id JOIN labels l ON l.doc_id = s.doc_id LEFT JOIN named n ON n.doc_id = s.doc_id),
b AS (SELECT *, CASE expected WHEN 'risky' THEN 60 ELSE 0 END AS lo, CASE expected WHEN 'risky' THEN 100 WHEN 'safe' THEN 0 ELSE 79 END AS hi, CASE expected WHEN 'safe' THEN 'no_match' ELSE 'review' END AS due FROM j),
k AS (SELECT doc_id, consistent, {", ".join(f"{v} AS {n}" for n, v in kinds.items())} FROM b)
SELECT *, {", ".join(f"CASE {n} WHEN '' THEN 'PASS' ELSE 'FAIL' END AS {n}_verdict" for n in kinds)} FROM k"""


def interpreted_drafts(spark, sf_dir):
    """A draft rule of every document: a copy of the rule that it matches best, or one from its words."""
    nothing = F.lit(None).cast("string")
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "source")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))
    cases = docs.select("text", F.col("source").alias("description"), nothing.alias("domain"), nothing.alias("occurred_at"), nothing.alias("source_url"), nothing.alias("memo"), at.alias("at"))
    got = drafts.interpreted(cases, _REVIEWED, exported(spark, _REVIEWED), Policy(), DEMO_PACK)
    words = lambda k: F.array_join(F.get("conditions.all_of", F.lit(k))["any_of"], "|")
    return got.select("id", "category", "risk_domain", "pattern_type", "severity_floor", words(0).alias("triggers"), words(1).alias("contexts"), "review_status")


def _drafts_sql() -> str:
    text, plain = "coalesce(d.text, '')", S.squeezed("concat_ws(' ', d.text, d.source)")
    told = lambda k: "CASE " + " ".join(f"WHEN regexp_matches(told, '{c[0]}') THEN '{c[k + 1]}'" for c in drafts.CASCADE) + f" ELSE '{drafts.OTHERWISE[k]}' END"
    rule = lambda take: "CASE primary_rule " + " ".join(f"WHEN '{r.id}' THEN {S._quoted(take(r)) if isinstance(take(r), str) else take(r)}" for r in _REVIEWED) + " END"
    return f""", x AS (SELECT d.doc_id, primary_rule, {text} AS t, {plain} AS told, list_filter(regexp_split_to_array({S.squeezed(text)}, '[^\\p{{L}}\\p{{N}}%·.]+'), lambda w: length(w) >= 2) AS ws FROM documents d JOIN scored s ON s.doc_id = d.doc_id),
y AS (SELECT *, {told(0)} AS cat, {told(1)} AS dom FROM x)
SELECT 'risk_draft_' || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id), '%Y%m%d%H%M%S') AS id, coalesce({rule(lambda r: r.category)}, cat) AS category, coalesce({rule(lambda r: r.domain or r.category)}, dom) AS risk_domain,
 coalesce({rule(lambda r: r.pattern_type)}, '{drafts.TEMPLATE["pattern_type"]}') AS pattern_type, coalesce({rule(lambda r: r.severity_floor)}, {drafts.SEVERITY_FLOOR})::DOUBLE AS severity_floor,
 coalesce({rule(lambda r: "|".join(r.triggers))}, CASE WHEN len(ws) >= 2 THEN ws[1] ELSE trim(t) END) AS triggers, coalesce({rule(lambda r: "|".join(r.contexts))}, CASE WHEN len(ws) >= 2 THEN ws[len(ws)] ELSE dom END) AS contexts, 'draft' AS review_status FROM y"""


def bundle_engine_scores(spark, sf_dir):
    """The demonstration book written as a bundle, loaded as an engine, and every document judged by it."""
    where = new_path(spark, "bundle")
    bundle.write_bundle(exported(spark, DEMO_RULES), where)
    judged = bundle.load_engine(spark, where).analyze(_table(spark, sf_dir, "documents", "doc_id", "text"), DEMO_PACK)
    return judged.select("doc_id", F.size("matches").cast("long").alias("n_matches"), "final_score", "grade", "status")


def _cells(spark, sf_dir):
    """Rows of a table of words: some too short, some blank, many alike but for case and spaces."""
    n = F.col("p_partkey")
    whole = F.array(F.when(n % 2 == 0, F.upper("p_brand")).otherwise(F.concat(F.lit("  "), F.lower("p_brand"))), F.concat(F.lit(" "), F.col("p_type"), F.lit(" ")), F.when(n % 3 == 0, " ").otherwise(F.split_part("p_name", F.lit(" "), F.lit(1))))
    return _table(spark, sf_dir, "part").select(F.when(n % 9 == 0, F.slice(whole, 1, 2)).when(n % 11 == 0, F.array(F.lit(""), F.lit(" "), F.lit(""))).otherwise(whole).alias("cells"))


_CELLS = """w AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 9 = 0 OR p_partkey % 11 = 0 THEN NULL ELSE lower(p_brand) END AS a, p_type AS b, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE lower(split_part(p_name, ' ', 1)) END AS r FROM part)"""


def csv_intake_summary(spark, sf_dir):
    return evaluate.csv_summary(_cells(spark, sf_dir), _HEADERS)


def csv_intake_categories(spark, sf_dir):
    return evaluate.csv_categories(_cells(spark, sf_dir), _HEADERS)


def effective_patterns(spark, sf_dir):
    """Every rule's patterns with the variants of its type, from a table of variants."""
    p = _table(spark, sf_dir, "part")
    kind = lambda k: F.concat(F.lit("type_"), (F.col("p_size") % k).cast("string"))
    rules = p.select(F.concat(F.lit("risk_part_"), "p_partkey").alias("id"), kind(6).alias("pattern_type"), F.array("p_type").alias("trigger"), F.array("p_brand", F.lit("")).alias("context"))
    variants = p.select(kind(4).alias("pattern_type"), F.when(F.col("p_partkey") % 2 == 0, "trigger").otherwise("context").alias("role"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_type")).alias("pattern"))
    return rulebook.effective_patterns(rules, variants).select("id", "role", F.array_join("patterns", "|").alias("patterns"))


def provider_statuses(spark, sf_dir):
    """What is reported of runs whose fields are made from numbers of the documents."""
    n, c = F.col("doc_id"), F.col
    flags = {"ok": n % 2 == 0, "cached": n % 7 == 0, "timed_out": n % 5 == 0, "exhausted": n % 11 == 0, "valid": n % 4 < 3, "errors": F.when(n % 3 == 0, F.array(F.lit(fusion.NO_SECRET))).otherwise(F.array().cast("array<string>")), "ms": c("n_chars") % 4}
    runs = _table(spark, sf_dir, "documents", "doc_id", "n_chars").withColumns(flags)
    status = fusion.provider_status(c("ok"), c("timed_out"), c("exhausted"), c("cached"), c("errors"), c("ms"))
    return runs.select("doc_id", status.alias("status"), F.when(~c("ok"), fusion.fallback_kind(c("timed_out"), c("exhausted"), c("valid"), c("ms"))).alias("fallback"))


def masked_cache_keys(spark, sf_dir):
    """The keys of a model's masked input, its 2,000 characters: masks need look-around, so no SQL."""
    return privacy.prepare(_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", privacy.cache_key(F.col("model_text")).alias("key"))


def queries():
    return {f.__name__: f for f in (engine_verdicts, interpreted_drafts, bundle_engine_scores, csv_intake_summary, csv_intake_categories, effective_patterns, provider_statuses, masked_cache_keys)}


def oracle_sql():
    scored = S.chain(S.SENTENCES, S.WINDOWS, S.hits_sql(), S.candidates_sql(), S.matches_sql(), S.scores_sql())
    return {
        "engine_verdicts": scored + _verdicts_sql(),
        "interpreted_drafts": scored + _drafts_sql(),
        "bundle_engine_scores": scored + " SELECT doc_id, n_matches, final_score, grade, status FROM scored",
        "csv_intake_summary": f"""WITH {_CELLS} SELECT 'false_advertising' AS profile, count(*) AS total, count(a) AS valid, count(*) - count(a) AS invalid, count(a) - count(DISTINCT CASE WHEN a IS NOT NULL THEN a || '|' || lower(b) || '|' || r END) AS duplicates,
 count(DISTINCT CASE WHEN a IS NOT NULL AND r <> '' THEN r END) AS unique_roots, least(count(a), {evaluate.PREVIEW}) AS preview FROM w""",
        "csv_intake_categories": f"WITH {_CELLS} SELECT b AS name, count(*) AS n FROM w WHERE a IS NOT NULL GROUP BY b",
        "effective_patterns": """WITH v AS (SELECT 'type_' || (p_size % 4) AS pt, CASE WHEN p_partkey % 2 = 0 THEN 'trigger' ELSE 'context' END AS role, list_sort(list(DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END)) AS added FROM part GROUP BY 1, 2),
o AS (SELECT 'risk_part_' || p_partkey AS id, 'type_' || (p_size % 6) AS pt, 'trigger' AS role, p_type AS own FROM part UNION ALL SELECT 'risk_part_' || p_partkey, 'type_' || (p_size % 6), 'context', p_brand FROM part)
SELECT id, o.role, array_to_string(list_concat([own], list_filter(coalesce(added, []), lambda x: x <> own)), '|') AS patterns FROM o LEFT JOIN v ON v.pt = o.pt AND v.role = o.role""",
        "provider_statuses": f"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'cached' WHEN doc_id % 2 = 0 THEN 'ready' WHEN doc_id % 5 = 0 THEN 'timeout' WHEN doc_id % 11 = 0 THEN 'resource_exhausted' WHEN doc_id % 3 = 0 THEN 'secret_unavailable' WHEN n_chars % 4 > 0 THEN 'validation_error' ELSE 'provider_error' END AS status,
 CASE WHEN doc_id % 2 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'timeout' WHEN doc_id % 11 = 0 THEN 'resource_exhausted' WHEN doc_id % 4 = 3 AND n_chars % 4 > 0 THEN 'validation' ELSE 'provider_error' END AS fallback FROM documents""",
    }
