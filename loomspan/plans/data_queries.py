"""Queries over rule books, decisions and evaluations, with their SQL.

Rule books are made from ``part`` (a rule for each part), decisions from ``documents``, labels
from ``labels``: the same expressions in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan import schemas
from loomspan.functions import text as T
from loomspan.operators import evaluate, fusion, privacy, rulebook, store
from loomspan.plans.matching_sql import squeezed as squeezed_sql
from loomspan.sources.tables import table as _table
from loomspan.streaming import cache


# ---- rule books --------------------------------------------------------------------------

_COLUMNS = ["id", "revision", "category", "severity_floor"]


def _book(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("risk_part_"), F.col("p_partkey")).alias("id"), (F.col("p_size") % 5 + 1).alias("revision"), F.col("p_brand").alias("category"), F.col("p_size").cast("double").alias("severity_floor"),
        (F.col("p_size") % 7 == 0).alias("dominant_risk"), F.array("p_type", "p_brand").alias("recent_context_tags"), F.when(F.col("p_size") % 4 == 0, "draft").otherwise("reviewed").alias("review_status"),
    )


def _incoming(book):
    n = F.regexp_extract("id", "([0-9]+)", 1).cast("long")
    changed = book.withColumns({"revision": F.when(n % 3 == 1, F.col("revision") + 1).otherwise(F.col("revision")), "severity_floor": F.when(n % 3 == 0, F.col("severity_floor")).otherwise(F.col("severity_floor") + 1), "id": F.when(n % 10 == 7, F.concat("id", F.lit("_new"))).otherwise(F.col("id"))})
    return changed.where(n % 2 == 1)


_BOOK = """
b AS (SELECT 'risk_part_' || p_partkey AS id, (p_size % 5 + 1)::INT AS revision, p_brand AS category, p_size::DOUBLE AS severity_floor, p_size % 7 = 0 AS dominant_risk,
      [p_type, p_brand] AS tags, CASE WHEN p_size % 4 = 0 THEN 'draft' ELSE 'reviewed' END AS review_status, p_partkey AS n FROM part),
i AS (SELECT CASE WHEN n % 10 = 7 THEN id || '_new' ELSE id END AS id, (CASE WHEN n % 3 = 1 THEN revision + 1 ELSE revision END)::INT AS revision, category,
      CASE WHEN n % 3 = 0 THEN severity_floor ELSE severity_floor + 1 END AS severity_floor FROM b WHERE n % 2 = 1),
k AS (SELECT i.id, CASE WHEN b.id IS NULL THEN 'new' WHEN b.revision = i.revision AND b.category = i.category AND b.severity_floor = i.severity_floor THEN 'same' WHEN i.revision > b.revision THEN 'update' ELSE 'conflict' END AS kind
      FROM i LEFT JOIN b ON b.id = i.id)"""


def import_preview(spark, sf_dir):
    book = _book(spark, sf_dir)
    return rulebook.import_classes(book, _incoming(book), _COLUMNS)


def import_summary(spark, sf_dir):
    return rulebook.import_summary(import_preview(spark, sf_dir), _book(spark, sf_dir))


def merge_final(spark, sf_dir):
    book = _book(spark, sf_dir).select(*_COLUMNS)
    return rulebook.merged_book(book, _incoming(_book(spark, sf_dir)), _COLUMNS)


def export_trend_context(spark, sf_dir):
    found = rulebook.trend_context(_book(spark, sf_dir))
    return found.select("tag", F.array_join("rule_ids", "|").alias("rule_ids"), F.array_join("categories", "|").alias("categories"))


def export_severity(spark, sf_dir):
    found = rulebook.severity_export(_book(spark, sf_dir))
    return found.select("category", "max_floor", F.array_join("dominant_ids", "|").alias("dominant_ids"))


# ---- decisions ---------------------------------------------------------------------------

_CYCLE = lambda n, values: F.element_at(F.array(*(F.lit(v) for v in values)), (n % len(values) + 1).cast("int"))
_FIELDS = {
    "risk_intent": (7, ("direct_promotional", "contextual_only", "uncertain", "direct_promotional")),
    "speech_act": (11, ("claim", "warning", "condition", "report", "claim")),
    "context_relation": (13, ("supports", "negates", "conditions", "reports", "warns_about")),
    "policy_relevance": (17, ("none", "substantiation", "potentially_high", "none", "potentially_high", "uncertain")),
    "risk_family": (19, ("none", "legal_outcome", "financial_guarantee", "general_substantiation")),
    "claim_strength": (23, ("absolute", "strong", "limited")),
}


def hybrid_decision(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    n = F.col("n_chars")
    fields = {k: _CYCLE(F.floor(n * m / 5).cast("long"), v) for k, (m, v) in _FIELDS.items()}
    score = F.when(n % 4 == 0, 0.0).otherwise((n % 101).cast("double"))
    rows = d.withColumns(fields | {"final_score": score, "confidence": (n % 50).cast("double") / 50, "n_spans": (n % 3).cast("int"), "ok": n % 9 != 0, "timed_out": n % 18 == 0, "exhausted": n % 27 == 0, "validation_ms": (n % 2).cast("int")})
    rows = rows.withColumn("rules_status", F.when(score >= 80, "high").when(score >= 70, "attention").when(score > 0, "review").otherwise("no_match"))
    rows = rows.withColumn("rule_text", F.when(F.col("rules_status") != "no_match", F.concat(F.lit("risk_"), _CYCLE(n, ("finance", "legal", "retail")))))
    d = F.col("decision")
    return fusion.careful(fusion.decide(rows)).select("doc_id", d["status"].alias("status"), d["score"].alias("score"), d["conflict"].alias("conflict"), F.array_join(d["reasons"], "|").alias("reasons"), d["suppressed_high"].alias("suppressed_high"))


def _decision_sql() -> str:
    cycle = lambda n, values: "[" + ", ".join(f"'{v}'" for v in values) + f"][{n} % {len(values)} + 1]"
    fields = ", ".join(cycle(f"(n_chars * {m} // 5)", v) + f" AS {k}" for k, (m, v) in _FIELDS.items())
    cta = fusion.CALL_TO_ACTION.replace("'", "''")
    families = " ".join(f"WHEN regexp_matches(rule_text, '{p}') THEN '{f}'" for f, p in fusion.FAMILIES)
    clamp = "greatest(55, least(69, coalesce(nullif(final_score, 0), 55)))::DOUBLE"
    return f"""
WITH r AS (SELECT doc_id, text, n_chars AS n, {fields}, CASE WHEN n_chars % 4 = 0 THEN 0.0 ELSE n_chars % 101 END::DOUBLE AS final_score, (n_chars % 50)::DOUBLE / 50 AS confidence, n_chars % 3 AS n_spans,
           n_chars % 9 <> 0 AS ok, n_chars % 18 = 0 AS timed_out, n_chars % 27 = 0 AS exhausted, n_chars % 2 AS validation_ms FROM documents),
s AS (SELECT *, CASE WHEN final_score >= 80 THEN 'high' WHEN final_score >= 70 THEN 'attention' WHEN final_score > 0 THEN 'review' ELSE 'no_match' END AS rs FROM r),
t AS (SELECT *, CASE WHEN rs <> 'no_match' THEN 'risk_' || {cycle("n", ("finance", "legal", "retail"))} END AS rule_text FROM s),
u AS (SELECT *, CASE WHEN rule_text IS NULL THEN 'none' {families} ELSE 'general_substantiation' END AS fam, rs = 'no_match' AS nm, policy_relevance <> 'none' AS rel, confidence < 0.55 AS low FROM t),
v AS (SELECT *, CASE
  WHEN NOT ok THEN 'fail'
  WHEN risk_intent = 'contextual_only' AND speech_act IN ('warning', 'criticism', 'report', 'definition') AND context_relation IN ('negates', 'warns_about', 'reports', 'defines') AND NOT rel AND confidence >= 0.80 AND NOT regexp_matches(text, '{cta}') THEN 'context'
  WHEN risk_intent = 'contextual_only' AND speech_act = 'condition' AND context_relation IN ('conditions', 'negates') AND confidence >= 0.82 THEN 'condition'
  WHEN rule_text IS NOT NULL AND rel AND risk_family <> 'none' AND risk_family <> fam THEN 'mismatch'
  WHEN risk_intent = 'uncertain' OR policy_relevance = 'uncertain' OR (low AND NOT (nm AND NOT rel AND confidence >= 0.50)) THEN 'unsure'
  WHEN nm AND NOT rel THEN 'clear' WHEN nm THEN 'only'
  WHEN risk_intent = 'direct_promotional' AND speech_act = 'claim' AND context_relation = 'supports' AND policy_relevance = 'potentially_high' AND risk_family = fam AND claim_strength IN ('absolute', 'strong') AND confidence >= 0.82 AND n_spans > 0 THEN 'high'
  WHEN NOT rel THEN 'disagree' ELSE 'rest' END AS b FROM u)
SELECT doc_id,
  CASE WHEN b IN ('context', 'clear') OR (b = 'condition' AND nm) THEN 'no_match' WHEN b = 'high' THEN 'high' ELSE 'review' END AS status,
  (CASE WHEN b IN ('context', 'clear') OR (b = 'condition' AND nm) THEN 0 WHEN b = 'high' THEN greatest(80, final_score) ELSE {clamp} END)::DOUBLE AS score,
  CASE WHEN b IN ('fail', 'mismatch', 'disagree') THEN TRUE WHEN b IN ('context', 'condition') THEN NOT nm WHEN b = 'unsure' THEN rs <> 'review' ELSE FALSE END AS conflict,
  CASE WHEN b = 'fail' THEN CASE WHEN timed_out THEN 'interpreter_timeout' WHEN exhausted THEN 'interpreter_resource_exhausted' WHEN validation_ms > 0 THEN 'interpreter_validation_failed' ELSE 'interpreter_provider_failed' END
       WHEN b = 'context' AND NOT nm THEN 'context_policy_suppression' WHEN b = 'condition' AND NOT nm THEN 'legitimate_condition_suppresses_rules' WHEN b = 'mismatch' THEN 'risk_family_mismatch'
       WHEN b = 'unsure' THEN CASE WHEN low THEN 'interpreter_low_confidence' ELSE 'interpreter_uncertain' END
       WHEN b = 'only' THEN CASE WHEN policy_relevance = 'substantiation' THEN 'ai_only_substantiation' ELSE 'ai_only_potentially_high' END
       WHEN b = 'disagree' THEN 'rules_interpreter_disagreement' ELSE '' END AS reasons,
  CASE WHEN b IN ('clear', 'high') THEN FALSE ELSE rs = 'high' END AS suppressed_high
FROM v"""


def replay_join(spark, sf_dir):
    """Documents with the result recorded for their text's hash: what benchmark items and labelled documents left."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels")
    recorded = d.join(labels, "doc_id").select(F.sha2("text", 256).alias("input_hash"), F.col("doc_id").alias("seq"), F.col("quality").cast("string").alias("payload"))
    return fusion.replayed(d, recorded).select("doc_id", "ok", F.col("run.payload").alias("payload"))


# ---- evaluation --------------------------------------------------------------------------


def _cases(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    expected = evaluate.expected_class(F.when(F.col("toxic") == 1, "detect").when(F.col("quality") == 1, "safe").otherwise("boundary"))
    n = F.col("n_chars")
    status = F.when(n % 5 == 0, "high").when(n % 5 == 1, "review").otherwise("no_match")
    return rows.select("doc_id", "source", "lang", "text", expected.alias("expected"), status.alias("status"))


_CASES = """c AS (SELECT d.doc_id, source, lang, text, CASE WHEN toxic = 1 THEN 'risky' WHEN quality = 1 THEN 'safe' ELSE 'ambiguous' END AS expected,
 CASE WHEN n_chars % 5 = 0 THEN 'high' WHEN n_chars % 5 = 1 THEN 'review' ELSE 'no_match' END AS status FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""
_METRICS = """count(*) AS n, count_if(expected = 'risky' AND status <> 'no_match') AS true_found, count_if(expected = 'safe' AND status <> 'no_match') AS false_found, count_if(expected = 'risky' AND status = 'no_match') AS missed,
 round(count_if(expected = 'risky' AND status <> 'no_match') / nullif(count_if(expected = 'risky'), 0), 9)::DOUBLE AS recall, round(count_if(expected = 'safe' AND status = 'high') / nullif(count_if(expected = 'safe'), 0), 9)::DOUBLE AS false_high_rate,
 round(count_if(status = 'review') / count(*), 9)::DOUBLE AS review_rate"""


def eval_by_slice(spark, sf_dir):
    return evaluate.by_slice(_cases(spark, sf_dir), "source", "lang")


def eval_confusion(spark, sf_dir):
    c = _cases(spark, sf_dir)
    return c.groupBy("expected", "status", evaluate.verdict(F.col("expected"), F.col("status")).alias("verdict")).agg(F.count("*").alias("n"))


def eval_gates(spark, sf_dir):
    one = _cases(spark, sf_dir).agg(*evaluate.metrics())
    return evaluate.gates(one, recall__min=0.3, false_high_rate__max=0.5, review_rate__max=0.1).select("recall__min", "false_high_rate__max", "review_rate__max", "passed")


def p95_nearest_rank(spark, sf_dir):
    return evaluate.nearest_rank(_table(spark, sf_dir, "events"), "value", 0.95, "event_type")


def stratified_sample(spark, sf_dir):
    return evaluate.stratified(_cases(spark, sf_dir), ["lang", "expected"], "doc_id", 4).select("lang", "expected", F.col("rank").cast("long").alias("rank"), "doc_id")


def leakage_semi_join(spark, sf_dir):
    """Lines of documents that stand in the benchmark."""
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    items = _table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("text"))
    return evaluate.leaked(lines, items, ["text"]).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


def repeat_consistency(spark, sf_dir):
    return evaluate.consistent(_table(spark, sf_dir, "conversations").withColumn("role", F.col("role")), "conv_id", ["role"])


def csv_profile(spark, sf_dir):
    return evaluate.table_profile(_table(spark, sf_dir, "documents"), ["text"])


def source_facet(spark, sf_dir):
    return evaluate.facet(_table(spark, sf_dir, "documents"), "source")


def lru_cache_hits(spark, sf_dir):
    """At most 256 entries over all keys, one sequence: SQL has no form of it; tests hold it against a loop."""
    e = _table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    valid = F.col("event_type") != "error"
    return cache.lru_hits(e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), at.alias("at"), valid.alias("ok")), 172_800.0)


def ttl_cache_hits(spark, sf_dir):
    """Sequential by key, so SQL has no form of it; tests hold it against a loop."""
    e = _table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return cache.cache_hits(e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), at.alias("at")), 86_400.0)


# ---- the store and the release report ------------------------------------------------------------


def book_counters(spark, sf_dir):
    return store.counters(_book(spark, sf_dir))


def library_filter(spark, sf_dir):
    return store.library(_book(spark, sf_dir), status="reviewed", query="BRAND#1").select("id", "category")


def size_limits(spark, sf_dir):
    d = _table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", store.within_limits(F.col("text"), F.col("text")).alias("issue"))


def replay_log(spark, sf_dir):
    d = _table(spark, sf_dir, "documents", "doc_id", "text").join(_table(spark, sf_dir, "labels"), "doc_id")
    return store.replay_log(d.select("text", F.col("quality").cast("string").alias("payload"), (F.col("toxic") == 0).alias("ok"), F.col("doc_id").alias("seq")))


def labels_repaired(spark, sf_dir):
    """Labels whose confidence cell holds a reason for every third document, and overrides for every tenth."""
    c = _cases(spark, sf_dir).withColumn("case_id", F.col("doc_id"))
    labels = c.select("case_id", "expected", F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("low").alias("confidence"), F.lit("as read").alias("reason"))
    return store.repaired(labels, c.where("doc_id % 10 = 0").select("case_id", F.lit("ambiguous").alias("expected"), F.lit("looked at again").alias("reason")))


def status_distribution(spark, sf_dir):
    return evaluate.distribution(_cases(spark, sf_dir), "status", ("no_match", "review", "attention", "high"))


def recall_by_domain(spark, sf_dir):
    return evaluate.recall_by_domain(_cases(spark, sf_dir).withColumn("domain", evaluate.domain_of(F.col("text"))))


def failing_cases(spark, sf_dir):
    return evaluate.failing(_cases(spark, sf_dir), "doc_id")


def failure_types(spark, sf_dir):
    c = _cases(spark, sf_dir).withColumn("score", (F.col("doc_id") % 101).cast("double"))
    kind = evaluate.failure_type(F.col("expected"), F.col("status"), F.col("score"), F.lit(0.0), F.lit(90.0))
    return c.groupBy(kind.alias("failure_type")).agg(F.count("*").alias("n"))


def before_after(spark, sf_dir):
    """Verdicts as they are, and as they would be if every document of an even id were called no_match."""
    c = _cases(spark, sf_dir)
    judged = lambda status: c.select("doc_id", evaluate.verdict(F.col("expected"), status).alias("verdict"))
    again = judged(F.when(F.col("doc_id") % 2 == 0, "no_match").otherwise(F.col("status"))).where("doc_id % 2 = 0")
    return evaluate.before_after(judged(F.col("status")), again, "doc_id")


def mean_values(spark, sf_dir):
    return evaluate.means(_table(spark, sf_dir, "documents"), "n_chars")


# ---- the classifier's payloads -------------------------------------------------------------------


def mock_payload(spark, sf_dir):
    d = fusion.classify_mock(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return d.select("doc_id", "speech_act", "claim_target", "claim_strength", "policy_relevance", F.col("confidence").cast("double").alias("confidence"))


def payload_errors(spark, sf_dir):
    """Payloads made from the mock classifier, some of them broken by the document's number, and what is wrong with them."""
    d = fusion.classify_mock(_table(spark, sf_dir, "documents", "doc_id", "text"))
    n = F.col("doc_id")
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    fields = {
        "schema_version": F.when(n % 7 == 0, "1.0.0").otherwise(schemas.PAYLOAD_VERSION), "risk_intent": F.lit("uncertain"), "speech_act": F.col("speech_act"), "claim_target": F.col("claim_target"), "context_relation": F.lit("unclear"),
        "actor": F.when(n % 5 == 0, "nobody").otherwise("unknown"), "claim_strength": F.col("claim_strength"), "policy_relevance": F.lit("none"), "risk_family": F.lit("none"), "confidence": F.when(n % 3 == 0, 1.5).otherwise(0.5),
        "evidence_spans": none, "policy_reason": F.lit("UNCERTAIN_INTENT"),
    }
    raw = F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))
    rows = d.select("doc_id", F.when(n % 11 == 0, "[]").otherwise(raw).alias("raw"), F.lit("").alias("text"))
    errors = privacy.payload_errors(F.col("raw"), F.col("text"), F.array().cast("array<struct<start:int,end:int,kind:string>>"))
    return rows.select("doc_id", F.array_join(errors, "|").alias("errors"))


def normalize_nfkc(spark, sf_dir):
    """The normal form of every text written in full-width letters and digits, some with a character without width."""
    d = _table(spark, sf_dir, "documents", "doc_id", "text")
    narrow = "".join(chr(c) for c in (*range(48, 58), *range(65, 91), *range(97, 123)))
    wide = F.translate("text", narrow, "".join(chr(ord(c) + 0xFEE0) for c in narrow))
    return d.select("doc_id", T.squeezed_nfkc(F.concat(F.lit("\u200b"), wide)).alias("normalized"))


def queries():
    return {f.__name__: f for f in (mock_payload, payload_errors, normalize_nfkc, book_counters, library_filter, size_limits, replay_log, labels_repaired, status_distribution, recall_by_domain, failing_cases, failure_types, before_after, mean_values, import_preview, import_summary, merge_final, export_trend_context, export_severity, hybrid_decision, replay_join, eval_by_slice, eval_confusion, eval_gates, p95_nearest_rank, stratified_sample, leakage_semi_join, repeat_consistency, csv_profile, source_facet, lru_cache_hits, ttl_cache_hits)}


def _stratified_sql(sizes: int = 4, most: int = 40) -> str:
    """Greedy over the strata in order, one step for each, for as many strata at least."""
    steps = []
    for k in range(1, most + 1):
        taken = "".join(f" AND text NOT IN (SELECT text FROM p{j})" for j in range(1, k))
        steps.append(f"p{k} AS (SELECT * EXCLUDE (t), row_number() OVER (ORDER BY doc_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS t FROM s WHERE st = {k}{taken}) WHERE t = 1 QUALIFY row_number() OVER (ORDER BY doc_id) <= {sizes})")
    every = " UNION ALL ".join(f"SELECT lang, expected, rank, doc_id FROM p{k}" for k in range(1, most + 1))
    return f"WITH {_CASES}, s AS (SELECT doc_id, lang, expected, coalesce(text, '') AS text, dense_rank() OVER (ORDER BY lang NULLS FIRST, expected) AS st FROM c), " + ", ".join(steps) + f" SELECT lang, expected, rank::BIGINT AS rank, doc_id FROM ({every})"


_VERDICT = "CASE expected WHEN 'risky' THEN CASE WHEN STATUS <> 'no_match' THEN 'PASS' ELSE 'FAIL' END WHEN 'safe' THEN CASE WHEN STATUS = 'no_match' THEN 'PASS' ELSE 'FAIL' END ELSE CASE WHEN STATUS = 'high' THEN 'FAIL' ELSE 'REVIEW' END END"


def oracle_sql():
    domain = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{w}') THEN '{d}'" for d, w in evaluate._DOMAIN_WORDS) + " ELSE 'unclassified' END"
    judged = lambda status: _VERDICT.replace("STATUS", status)
    rank = lambda v: f"CASE {v} WHEN 'PASS' THEN 2 WHEN 'REVIEW' THEN 1 ELSE 0 END"
    clean = lambda x: f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"
    return {
        "normalize_nfkc": f"SELECT doc_id, {squeezed_sql('text')} AS normalized FROM documents",
        "payload_errors": "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'not_an_object' ELSE concat_ws('|', CASE WHEN doc_id % 3 = 0 THEN 'confidence' END, CASE WHEN doc_id % 5 = 0 THEN 'value:actor' END, CASE WHEN doc_id % 7 = 0 THEN 'version' END) END AS errors FROM documents",
        "book_counters": f"WITH {_BOOK} SELECT count_if(review_status = 'reviewed') AS reviewed, count_if(review_status = 'draft') AS draft, count_if(review_status = 'rejected') AS rejected, count_if(review_status = 'reviewed' AND dominant_risk) AS dominant FROM b",
        "library_filter": f"WITH {_BOOK} SELECT id, category FROM b WHERE review_status = 'reviewed' AND contains(lower(id || ' ' || category), 'brand#1')",
        "size_limits": f"SELECT doc_id, CASE WHEN octet_length(encode(text)) > {store.MAX_ANALYSIS} THEN 'payload_too_large' WHEN length(trim(text)) = 0 THEN 'text_empty' WHEN length(text) > {store.MAX_TEXT} THEN 'text_too_long' END AS issue FROM documents",
        "replay_log": "SELECT sha256(text) AS input_hash, max_by(quality, d.doc_id)::VARCHAR AS payload FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE toxic = 0 GROUP BY 1",
        "labels_repaired": f"WITH {_CASES} SELECT doc_id AS case_id, CASE WHEN doc_id % 10 = 0 THEN 'ambiguous' ELSE expected END AS expected, CASE WHEN doc_id % 3 <> 0 THEN 'low' WHEN doc_id % 10 = 0 OR expected = 'ambiguous' THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN doc_id % 10 = 0 THEN 'looked at again' WHEN doc_id % 3 = 0 THEN coalesce(source, 'as read') ELSE 'as read' END AS reason FROM c",
        "status_distribution": f"WITH {_CASES}, v AS (SELECT unnest(['no_match', 'review', 'attention', 'high']) AS value) SELECT value, count(status) AS n FROM v LEFT JOIN c ON status = value GROUP BY value",
        "recall_by_domain": f"WITH {_CASES}, v AS (SELECT unnest({list(evaluate.DOMAINS)!r}) AS domain), x AS (SELECT {domain} AS domain, status FROM c WHERE expected = 'risky') SELECT v.domain, count(status) AS risky, count_if(coalesce(status <> 'no_match', FALSE)) AS found, round(count_if(coalesce(status <> 'no_match', FALSE)) / nullif(count(status), 0), 9)::DOUBLE AS recall FROM v LEFT JOIN x ON x.domain = v.domain GROUP BY v.domain",
        "failing_cases": f"WITH {_CASES} SELECT 'FAIL' AS verdict, doc_id FROM c WHERE {judged('status')} = 'FAIL'",
        "failure_types": f"WITH {_CASES} SELECT CASE WHEN expected = 'risky' AND status = 'no_match' THEN 'false_negative' WHEN expected = 'safe' AND status <> 'no_match' THEN 'false_positive' WHEN expected = 'ambiguous' AND status = 'high' THEN 'over_confident' WHEN doc_id % 101 > 90 THEN 'score_mismatch' END AS failure_type, count(*) AS n FROM c GROUP BY 1",
        "before_after": f"WITH {_CASES}, x AS (SELECT doc_id, {judged('status')} AS before, {judged(chr(39) + 'no_match' + chr(39))} AS after FROM c WHERE doc_id % 2 = 0) SELECT doc_id, before, after, before <> after AS changed, {rank('after')} > {rank('before')} AS improved FROM x",
        "mean_values": "SELECT round(avg(n_chars), 9) AS mean_n_chars FROM documents",
        "import_preview": f"WITH {_BOOK} SELECT * FROM k",
        "import_summary": f"WITH {_BOOK} SELECT count_if(kind = 'new') AS new, count_if(kind = 'same') AS same, count_if(kind = 'update') AS \"update\", count_if(kind = 'conflict') AS conflict, count_if(kind = 'conflict') AS skipped, (SELECT count(*) FROM b) + count_if(kind = 'new') AS final_count FROM k",
        "merge_final": f"WITH {_BOOK}, x AS (SELECT id FROM k WHERE kind IN ('new', 'update')) SELECT id, revision, category, severity_floor FROM b WHERE id NOT IN (SELECT id FROM x) UNION ALL SELECT id, revision, category, severity_floor FROM i WHERE id IN (SELECT id FROM x)",
        "export_trend_context": f"WITH {_BOOK}, e AS (SELECT DISTINCT unnest(tags) AS tag, id, category FROM b WHERE review_status = 'reviewed') SELECT tag, string_agg(DISTINCT id, '|' ORDER BY id) AS rule_ids, string_agg(DISTINCT category, '|' ORDER BY category) AS categories FROM e GROUP BY tag",
        "export_severity": f"WITH {_BOOK} SELECT category, max(severity_floor) AS max_floor, coalesce(string_agg(CASE WHEN dominant_risk THEN id END, '|' ORDER BY id), '') AS dominant_ids FROM b WHERE review_status = 'reviewed' GROUP BY category",
        "hybrid_decision": _decision_sql(),
        "replay_join": "WITH r AS (SELECT sha256(text) AS h, max_by(quality, d.doc_id)::VARCHAR AS payload FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1) SELECT doc_id, payload IS NOT NULL AS ok, payload FROM documents LEFT JOIN r ON r.h = sha256(text)",
        "eval_by_slice": f"WITH {_CASES} SELECT source, lang, {_METRICS} FROM c GROUP BY GROUPING SETS ((), (source), (lang))",
        "eval_confusion": f"WITH {_CASES} SELECT expected, status, CASE expected WHEN 'risky' THEN CASE WHEN status <> 'no_match' THEN 'PASS' ELSE 'FAIL' END WHEN 'safe' THEN CASE WHEN status = 'no_match' THEN 'PASS' ELSE 'FAIL' END ELSE CASE WHEN status = 'high' THEN 'FAIL' ELSE 'REVIEW' END END AS verdict, count(*) AS n FROM c GROUP BY ALL",
        "eval_gates": f"WITH {_CASES}, m AS (SELECT {_METRICS} FROM c) SELECT recall >= 0.3 AS recall__min, false_high_rate <= 0.5 AS false_high_rate__max, review_rate <= 0.1 AS review_rate__max, recall >= 0.3 AND false_high_rate <= 0.5 AND review_rate <= 0.1 AS passed FROM m",
        "p95_nearest_rank": "SELECT event_type, quantile_disc(value, 0.95) AS at_rank, count(value) AS n FROM events GROUP BY event_type",
        "stratified_sample": _stratified_sql(),
        "leakage_semi_join": f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents), i AS (SELECT DISTINCT {clean('x')} AS v FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM benchmark)), h AS (SELECT doc_id, text FROM l WHERE {clean('text')} <> '' AND {clean('text')} IN (SELECT v FROM i)) SELECT doc_id, count(*) AS n_lines FROM h GROUP BY doc_id",
        "repeat_consistency": "SELECT conv_id, count(*) AS n_runs, count(DISTINCT role) = 1 AS consistent FROM conversations GROUP BY conv_id",
        "csv_profile": f"WITH k AS (SELECT {clean('text')} AS v, count(*) AS n FROM documents GROUP BY 1) SELECT sum(n)::BIGINT AS total, sum(CASE WHEN v <> '' THEN n ELSE 0 END)::BIGINT AS valid, sum(CASE WHEN v = '' THEN n ELSE 0 END)::BIGINT AS invalid, sum(CASE WHEN v <> '' THEN n - 1 ELSE 0 END)::BIGINT AS duplicates FROM k",
        "source_facet": "SELECT trim(source) AS name, count(*) AS n FROM documents WHERE trim(source) <> '' GROUP BY 1",
    }
