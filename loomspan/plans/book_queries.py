"""Queries over stored rule books, drafts, runs of a classifier and pilots, with their SQL.

As in ``data_queries``, inputs are made from the tables by the same expressions in both engines.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan import schemas
from loomspan.functions import text as T
from loomspan.operators import drafts, evaluate, fusion, interpreter, pilot, privacy, rulebook, store
from loomspan.plans.data_queries import _BOOK, _CASES, _VERDICT, _book, _cases
from loomspan.plans.matching_sql import squeezed as squeezed_sql
from loomspan.operators.versions import RuleStore, VersionedTable
from loomspan.sources.tables import new_path
from loomspan.sources.tables import table as _table
from loomspan.streaming import cache, runs

_START = "2024-01-01 00:00:00"


def _documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents", "doc_id", "text", "source", "n_chars")


# ---- the stored book -------------------------------------------------------------------------

_STORED = ["id", "revision", "category", "created_at", "updated_at"]


def _stored(spark, sf_dir):
    """A stored book; every second rule was touched after it was made."""
    n = F.regexp_extract("id", "([0-9]+)", 1).cast("long")
    return _book(spark, sf_dir).select("id", "revision", "category", F.lit("t0").alias("created_at"), F.when(n % 2 == 0, "t1").otherwise("t0").alias("updated_at"))


def _fresh(spark, sf_dir):
    """Rules to store: every third of the book at a higher revision, and as many new ones."""
    n = F.regexp_extract("id", "([0-9]+)", 1).cast("long")
    rows = _stored(spark, sf_dir).where(n % 3 == 0).withColumns({"revision": F.col("revision") + 1, "created_at": F.lit("t2"), "updated_at": F.lit("t2")})
    return rows.unionByName(rows.withColumn("id", F.concat("id", F.lit("_new"))))


_STORE = f"""WITH {_BOOK}, o AS (SELECT id, revision, category, 't0' AS created_at, CASE WHEN n % 2 = 0 THEN 't1' ELSE 't0' END AS updated_at, n FROM b),
f0 AS (SELECT id, (revision + 1)::INT AS revision, category, 't2' AS created_at, 't2' AS updated_at FROM o WHERE n % 3 = 0), f AS (SELECT * FROM f0 UNION ALL SELECT id || '_new', revision, category, created_at, updated_at FROM f0)
"""


def rules_upserted(spark, sf_dir):
    return rulebook.upserted(_stored(spark, sf_dir), _fresh(spark, sf_dir), F.lit("t9"))


def store_round_trip(spark, sf_dir):
    """A book that is seeded, changed, merged into and deleted from, version by version, and read back."""
    book = RuleStore(VersionedTable(spark, new_path(spark, "book")), errors=None)
    book.seeded(_stored(spark, sf_dir))
    book.upsert(_fresh(spark, sf_dir).where("id NOT LIKE '%_new'"), F.lit("t9"), 1)
    book.merge(_fresh(spark, sf_dir), 2)
    book.delete("risk_part_7", 3)
    return book.rules()


def runs_in_batches(spark, sf_dir):
    """Runs of the cue words over all documents, those of one language in a batch before: each case has one run. Masks need look-around: no SQL."""
    table = VersionedTable(spark, new_path(spark, "runs"))
    cases = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    for batch in (cases.where("lang = 'en'"), cases):
        runs.run_batch(batch, interpreter.by_cue_words, table, "doc_id")
    return table.read().select("doc_id", "ok", "text_hash", F.lit(table.version()).alias("version"))


def store_migrated(spark, sf_dir):
    """Payloads stored under the first schema, read and written under the third, and both versions' rows counted."""
    n = F.regexp_extract("id", "([0-9]+)", 1).cast("long")
    status = F.when(n % 4 == 0, '{"reviewStatus":"reviewed"}').when(n % 4 == 1, '{"reviewStatus":"rejected"}').when(n % 4 == 2, '{"reviewStatus":"odd"}').otherwise("no json")
    where = new_path(spark, "payloads")
    VersionedTable(spark, where).commit(_stored(spark, sf_dir).select("id", "revision", status.alias("payload")), 0)
    told = F.get_json_object("payload", "$.reviewStatus")
    catalog = {1: lambda r: r.withColumn("review_status", F.when(told.isin("reviewed", "rejected"), told).otherwise("draft")), 2: lambda r: r.drop("payload")}
    table = VersionedTable(spark, where, catalog)
    table.migrate(1)
    return table.read().withColumn("stored_rows", F.lit(table.manifest(1)["rows"]).cast("long"))


def rules_inserted(spark, sf_dir):
    return rulebook.inserted_if_absent(_stored(spark, sf_dir), _fresh(spark, sf_dir))


def rule_deleted(spark, sf_dir):
    return rulebook.deleted(_stored(spark, sf_dir), "risk_part_7")


def seeds_upgraded(spark, sf_dir):
    return rulebook.seed_upgraded(_stored(spark, sf_dir), _fresh(spark, sf_dir))


def newest_page(spark, sf_dir):
    """The page of the twenty newest: the limit is the feature."""
    return store.page(_stored(spark, sf_dir)).select("id", "created_at")


def stored_payloads(spark, sf_dir):
    """Rows stored as JSON, every fifth of them no object, read back."""
    n = F.regexp_extract("id", "([0-9]+)", 1).cast("long")
    rows = _stored(spark, sf_dir).select(F.when(n % 5 == 0, "[1]").otherwise(F.to_json(F.struct("id", "revision"))).alias("payload"))
    return store.parsed(rows, "id string, revision int")


def rule_by_key(spark, sf_dir):
    return store.by_key(_stored(spark, sf_dir), "id", "risk_part_5")


# ---- whole rules -------------------------------------------------------------------------------


def _legacy(spark, sf_dir):
    """Records of rules in both versions and both ways of writing names, made from ``part``."""
    p = _table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    none = F.lit(None).cast("string")
    old = F.struct(
        F.concat(F.lit("risk_part_"), n).alias("id"), F.col("p_brand").alias("category"), F.col("p_type").alias("patternType"), F.array("p_name").alias("triggerPatterns"), F.array("p_type").alias("context_patterns"),
        F.col("p_size").cast("double").alias("severityFloor"), F.when(n % 4 == 0, 12.5).alias("max_distance"), F.when(n % 6 == 0, "paragraph").alias("conditionScope"), F.when(n % 7 == 0, "gone").when(n % 2 == 0, "rejected").otherwise("draft").alias("reviewStatus"),
        F.when(n % 9 == 0, "3.0.0").when(n % 9 == 1, "1.0.0").alias("schema_version"), F.lit(0.5).alias("confidence"), none.alias("memo"),
    )
    # Generated rows: what is asked of the fields later is not asked below of the text, once more parsed for each field.
    return p.select(F.inline(F.array(F.from_json(F.to_json(old), schemas.RULE_INPUT))))


def rules_migrated(spark, sf_dir):
    found = rulebook.migrated(_legacy(spark, sf_dir))
    groups = F.array_join(F.transform("conditions.all_of", lambda g: F.concat_ws(":", g["group_id"], F.array_join(g["any_of"], "+"))), "|")
    return found.select("id", "revision", "category", "pattern_type", "severity_floor", "review_status", "version_ok", groups.alias("groups"), F.col("conditions.scope").alias("scope"), F.col("conditions.max_distance").alias("max_distance"), F.col("source.source_id").alias("source_id"))


def rules_validated(spark, sf_dir):
    """What is wrong with the migrated rules after some of their fields were spoilt."""
    n = F.regexp_extract("id", "([0-9]+)", 1).cast("long")
    found = rulebook.migrated(_legacy(spark, sf_dir))
    spoilt = found.withColumns({"category": F.when(n % 5 == 0, " ").otherwise(F.col("category")), "severity_floor": F.when(n % 11 == 0, 101.0).otherwise(F.col("severity_floor")), "created_at": F.lit("t0"), "updated_at": F.when(n % 13 == 0, "").otherwise("t0"), "review_status": F.when(n % 3 == 0, "reviewed").otherwise("draft")})
    return spoilt.select("id", F.array_join(rulebook.rule_errors(), "|").alias("errors"))


def _reviewed(spark, sf_dir):
    """Migrated rules, every third of them reviewed and whole."""
    n = F.regexp_extract("id", "([0-9]+)", 1).cast("long")
    say = lambda x: F.lit(x)
    found = rulebook.migrated(_legacy(spark, sf_dir)).where("version_ok").drop("version_ok")
    source = F.struct(say("part").alias("title"), say("https://example.com/").alias("url"), say("").alias("date"), F.concat(F.lit("s"), n).alias("source_id"), say("verified").alias("provenance_status"))
    filled = {"created_at": say("t0"), "updated_at": say("t0"), "risk_reason": say("r"), "risk_summary": say("s"), "risk_domain": say("d"), "safe_rewrite": F.array(F.col("category")), "source": source, "review_status": F.when(n % 3 == 0, "reviewed").otherwise("draft")}
    return found.withColumns(filled)


def export_rewrites(spark, sf_dir):
    return rulebook.rewrite_templates(_reviewed(spark, sf_dir)).withColumn("safe_rewrite", F.array_join("safe_rewrite", "|"))


def export_sources(spark, sf_dir):
    return rulebook.source_index(_reviewed(spark, sf_dir))


def export_rules(spark, sf_dir):
    """The exported lines read back: ids, and the expressions of both groups."""
    lines = rulebook.rules_jsonl(_reviewed(spark, sf_dir)).select(F.from_json("value", schemas.RULE).alias("r"))
    return lines.select("r.id", "r.review_status", F.get("r.conditions.all_of", F.lit(0))["any_of"][0].alias("trigger"), F.get("r.conditions.all_of", F.lit(1))["any_of"][0].alias("context"))


def rules_patched(spark, sf_dir):
    base = _book(spark, sf_dir).select("id", "revision", "category", "recent_context_tags", F.lit("old").alias("source"), F.lit("").alias("memo"), F.lit("t0").alias("updated_at"), "review_status")
    n = F.regexp_extract("id", "([0-9]+)", 1).cast("long")
    changed = base.where(n % 4 == 1).select("id", F.lit("patched").alias("category"))
    found = drafts.patched(base, base.select("id", F.concat(F.lit("source of "), "id").alias("source")), changed, "seen", "note", "t1")
    return found.withColumn("recent_context_tags", F.array_join("recent_context_tags", "|"))


def drafts_from_table(spark, sf_dir):
    """Drafts from the first fifty rows of a table, those without a keyword left out after the cut: the preview is the feature."""
    n = F.col("p_partkey")
    rows = _table(spark, sf_dir, "part").select((n + 1).alias("row_no"), F.when(n % 8 == 3, " ").otherwise(F.col("p_name")).alias("keyword"), F.when(n % 5 == 0, "").otherwise(F.col("p_brand")).alias("category"))
    cases = drafts.draft_cases(rows, F.lit(_START).cast("timestamp"), "part")
    made = drafts.drafts(cases, spark.createDataFrame([], schemas.RULE))
    word = lambda k: F.get("conditions.all_of", F.lit(k))["any_of"][0]
    return made.select("id", "surface_meaning", "risk_domain", "review_status", word(0).alias("trigger"), word(1).alias("context"))


def frozen_cases(spark, sf_dir):
    return drafts.numbered(_cases(spark, sf_dir).select("doc_id", "expected"), "doc_id", width=9)


def frozen_checks(spark, sf_dir):
    c = _cases(spark, sf_dir)
    rows = c.select(F.col("expected").alias("source_type"), F.col("source").alias("source_url"), F.col("lang").alias("domain"), F.concat_ws(" ", "doc_id", F.lit("case")).alias("text"))
    return drafts.set_checks(rows, {"risky": 10, "safe": 10, "ambiguous": 10}, 2, 1_000_000, ("en", "de"))


def root_causes(spark, sf_dir):
    c = _cases(spark, sf_dir)
    kind = evaluate.failure_type(F.col("expected"), F.col("status"), F.lit(50.0), F.lit(0.0), F.lit(90.0))
    found = c.select(drafts.root_cause(kind, F.col("expected")).alias("c"))
    return found.groupBy(F.col("c.cause").alias("cause"), F.col("c.layer").alias("layer")).agg(F.count("*").alias("n"))


# ---- small functions ---------------------------------------------------------------------------


def draft_words(spark, sf_dir):
    edge = drafts.edge_words(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.get(edge, F.lit(0)).alias("first_word"), F.get(edge, F.lit(1)).alias("last_word"))


def score_ranges(spark, sf_dir):
    n = F.col("p_partkey")
    text = F.when(n % 4 == 0, F.col("p_name")).otherwise(F.concat(F.lit(" "), "p_size", F.lit(" - "), F.col("p_size") + 10))
    r = T.score_range(text)
    return _table(spark, sf_dir, "part").select("p_partkey", r["low"].alias("low"), r["high"].alias("high"))


def compact_times(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", T.compact_time(F.col("ts")).alias("compact"))


def web_urls(spark, sf_dir):
    n = F.col("page_id")
    url = F.when(n % 3 == 0, F.concat(F.lit("ftp://example.com/"), n)).when(n % 3 == 1, F.lit("no address")).otherwise(F.col("url"))
    return _table(spark, sf_dir, "pages", "page_id", "url").select("page_id", T.is_web_url(url).alias("is_web"))


def text_search(spark, sf_dir):
    return _documents(spark, sf_dir).where(T.contains_any(" THE ", F.col("text"), F.col("source"))).select("doc_id")


def domains_of_texts(spark, sf_dir):
    return _documents(spark, sf_dir).groupBy(evaluate.domain_of(F.col("text")).alias("domain")).agg(F.count("*").alias("n"))


def domain_hints(spark, sf_dir):
    n = F.col("p_partkey")
    name = F.when(n % 3 == 0, F.concat(F.lit("Finance "), "p_brand")).when(n % 3 == 1, F.col("p_brand")).otherwise("")
    return _table(spark, sf_dir, "part").select("p_partkey", interpreter.domain_hint(name).alias("hint"))


def cache_keys(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", privacy.cache_key(F.col("text")).alias("key"))


def secret_scan(spark, sf_dir):
    return privacy.secrets_found(_documents(spark, sf_dir), ["text", "source"], ["AKIA", "password"]).select("doc_id")


def token_costs(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.round(fusion.token_cost(F.col("n_chars"), F.lit(100), 0.25, 1.5), 9).alias("cost"))


def quote_spans(spark, sf_dir):
    """Where two quotes stand that texts have more than once: the nearest pair; a tie, or a quote that is not there, is no place."""
    text = F.concat(F.lit("①"), F.coalesce("text", F.lit("")), F.lit("②①"), F.when(F.col("doc_id") % 5 == 0, "②").otherwise(""))
    quotes = F.array(F.lit("①"), F.when(F.col("doc_id") % 3 == 0, "③").otherwise("②"))
    found = _documents(spark, sf_dir).select("doc_id", privacy.resolved_quotes(text, quotes).alias("q"))
    return found.select("doc_id", F.get("q", F.lit(0))["start"].alias("first_start"), F.get("q", F.lit(1))["start"].alias("last_start"), F.get("q", F.lit(1))["end"].alias("last_end"))


def names_in_utf16_order(spark, sf_dir):
    """Places of names with characters on both sides of the surrogates, in the order of UTF-16 code units."""
    mark = F.when(F.col("doc_id") % 4 == 0, "\U0001f600").when(F.col("doc_id") % 4 == 1, "\uff01").when(F.col("doc_id") % 4 == 2, "\ue000").otherwise("é")
    names = _documents(spark, sf_dir).select("doc_id", F.concat("source", mark, F.col("doc_id").cast("string")).alias("name"))
    place = F.row_number().over(Window.partitionBy(F.col("doc_id") % 64).orderBy(T.utf16_key(F.col("name"))))
    return names.select("doc_id", "name", place.cast("long").alias("place"))


# ---- runs of a classifier -----------------------------------------------------------------------


def classifier_runs(spark, sf_dir):
    """Runs by cue words over every text, checked; masks need look-around, so SQL has no form: tests hold it."""
    runs = interpreter.by_cue_words(_documents(spark, sf_dir))
    return runs.select("doc_id", "ok", F.array_join("errors", "|").alias("errors"), F.col("payload.risk_intent").alias("risk_intent"), F.size("payload.evidence_spans").cast("long").alias("n_spans"))


def statuses_of_runs(spark, sf_dir):
    n = F.col("n_chars")
    fields = {
        "ok": n % 4 != 0, "timed_out": n % 8 == 0, "exhausted": n % 12 == 0, "cached": n % 5 == 0, "confidence": (n % 10).cast("double") / 10, "risk_intent": F.when(n % 7 == 0, "uncertain").otherwise("contextual_only"),
        "policy_relevance": F.when(n % 3 == 0, "none").otherwise("substantiation"),
    }
    rows = _documents(spark, sf_dir).withColumns(fields)
    label = fusion.run_label(F.col("ok"), F.col("timed_out"), F.col("exhausted"), F.col("cached"))
    return rows.select("doc_id", fusion.classifier_status(rows).alias("status"), label.alias("label"))


def failed_decisions(spark, sf_dir):
    n = F.col("n_chars")
    d = interpreter.failed_decision(F.when(n % 2 == 0, "high").otherwise("review"), (n % 101).cast("double"))
    return _documents(spark, sf_dir).select("doc_id", d["status"].alias("status"), d["score"].alias("score"), d["suppressed_high"].alias("suppressed_high"))


def runs_overlaid(spark, sf_dir):
    c = _cases(spark, sf_dir).select("doc_id", "expected", "status")
    again = c.where("doc_id % 4 = 0").select("doc_id", F.lit("no_match").alias("status"))
    return evaluate.overlaid(c, again, "doc_id")


def runs_to_do(spark, sf_dir):
    """Cases without a finished record; the records of every fifth are of another text."""
    d = _documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("hash"))
    done = d.where("doc_id % 2 = 0").withColumn("hash", F.when(F.col("doc_id") % 5 == 0, "other").otherwise(F.col("hash")))
    return cache.still_to_do(d, done, "doc_id", "hash").select("doc_id")


# ---- cases and pilots --------------------------------------------------------------------------


def _sources(spark, sf_dir):
    c = _cases(spark, sf_dir).select(F.col("doc_id").alias("case_id"), "text", F.col("expected").alias("expected_class"))
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), "text", F.lit("safe").alias("expected_class"), F.lit("general").alias("domain"))
    return {"labelled": c, "benchmark": items}


def case_union(spark, sf_dir):
    return pilot.cases(_sources(spark, sf_dir)).select("case_id", "dataset", "expected_class", "domain", "annotated_speech_act", F.length("text").cast("long").alias("n_chars"))


def case_union_checks(spark, sf_dir):
    return pilot.case_checks(pilot.cases(_sources(spark, sf_dir)), 1)


_ACTS = ("claim", "warning", "criticism")
_RUNS = """r AS (SELECT *, CASE doc_id % 7 WHEN 0 THEN 'health' WHEN 1 THEN 'finance' WHEN 2 THEN 'education' WHEN 3 THEN 'legal' WHEN 4 THEN 'privacy' ELSE 'general' END AS domain,
 CASE WHEN doc_id % 5 = 0 THEN 'warning' ELSE '' END AS annotated_act, CASE doc_id % 3 WHEN 0 THEN 'claim' WHEN 1 THEN 'warning' ELSE 'criticism' END AS speech_act, doc_id % 50 <> 0 AS valid, (doc_id % 97)::DOUBLE AS latency_ms, (doc_id % 101)::DOUBLE AS score FROM c)"""


def _runs(spark, sf_dir):
    n = F.col("doc_id")
    names = F.array(*(F.lit(d) for d in ("health", "finance", "education", "legal", "privacy", "general", "general")))
    act = F.element_at(F.array(*(F.lit(a) for a in _ACTS)), (n % 3 + 1).cast("int"))
    fields = {"domain": F.element_at(names, (n % 7 + 1).cast("int")), "annotated_act": F.when(n % 5 == 0, "warning").otherwise(""), "speech_act": act, "valid": n % 50 != 0, "latency_ms": (n % 97).cast("double"), "score": (n % 101).cast("double")}
    return _cases(spark, sf_dir).withColumns(fields)


def pilot_metrics(spark, sf_dir):
    return pilot.pilot_metrics(_runs(spark, sf_dir))


def pilot_gate(spark, sf_dir):
    found = pilot.pilot_gate(pilot_metrics(spark, sf_dir))
    return found.select(*(c for c in found.columns if c.startswith("gate_")), "passed", "near")


def rerun_gate(spark, sf_dir):
    base = _cases(spark, sf_dir).select(F.col("doc_id").alias("case_id"), F.lit("direct_promotional").alias("risk_intent"), "status")
    again = base.where("case_id % 4 = 0").withColumns({"risk_intent": F.lit("contextual_only"), "status": F.lit("no_match")})
    found = pilot.rerun_gate(pilot_metrics(spark, sf_dir), base, again, base.where("case_id % 8 = 0"))
    return found.select(*(c for c in found.columns if c.startswith("gate_")), "all_improved", "viable")


def safe_distribution(spark, sf_dir):
    return pilot.class_distribution(_cases(spark, sf_dir), "safe")


def smoke_checks(spark, sf_dir):
    n = F.col("doc_id")
    return pilot.smoke(_cases(spark, sf_dir).select(F.lit(True).alias("valid"), (n < 0).alias("exhausted"), (n % 20 == 0).alias("timed_out")), 5)


def development_summary(spark, sf_dir):
    return pilot.summary(_runs(spark, sf_dir))


def result_table(spark, sf_dir):
    n = F.col("doc_id")
    status = F.col("status")
    fields = {
        "case_id": n, "rules_status": status, "rules_score": n % 101, "risk_intent": F.when(n % 2 == 0, "uncertain"), "confidence": F.lit(None).cast("double"), "score": n % 101, "verdict": evaluate.verdict(F.col("expected"), status),
        "rule_ids": F.array(F.lit("risk_a"), F.concat(F.lit("risk_"), n)), "cost": (n % 7).cast("double") / 8, "dataset": F.col("lang"), "input_hash": F.sha2("text", 256), "conflict": n % 2 == 0,
    }
    return pilot.result_rows(_runs(spark, sf_dir).withColumns(fields))


def queries():
    return {
        f.__name__: f
        for f in (
            rules_upserted, store_round_trip, store_migrated, runs_in_batches, rules_inserted, rule_deleted, seeds_upgraded, newest_page, stored_payloads, rule_by_key, rules_migrated, rules_validated, export_rewrites, export_sources, export_rules, rules_patched, drafts_from_table, frozen_cases,
            frozen_checks, root_causes, draft_words, score_ranges, compact_times, web_urls, text_search, domains_of_texts, domain_hints, cache_keys, secret_scan, token_costs, quote_spans, names_in_utf16_order, classifier_runs, statuses_of_runs, failed_decisions,
            runs_overlaid, runs_to_do, case_union, case_union_checks, pilot_metrics, pilot_gate, rerun_gate, safe_distribution, smoke_checks, development_summary, result_table,
        )
    }


def _rate(part: str, whole: str) -> str:
    return f"round(count_if({part}) / nullif(count_if({whole}), 0), 9)::DOUBLE"


def _pilot_sql() -> str:
    domains = ", ".join(_rate(f"expected = 'risky' AND status <> 'no_match' AND domain = '{d}'", f"expected = 'risky' AND domain = '{d}'") + f" AS recall_{d}" for d in evaluate.DOMAINS)
    return f"""m AS (SELECT count(*) AS n, count_if(expected = 'risky') AS risky, count_if(expected = 'safe') AS safe, count_if(expected = 'ambiguous') AS ambiguous, {_rate("expected = 'risky' AND status <> 'no_match'", "expected = 'risky'")} AS recall,
 {_rate("expected = 'safe' AND status <> 'no_match'", "expected = 'safe'")} AS false_positive_rate, {_rate("status = 'review'", "TRUE")} AS review_rate,
 count_if(expected = 'safe' AND status = 'high' AND (annotated_act IN ('warning', 'criticism') OR speech_act IN ('warning', 'criticism'))) AS warned_high, {_rate("valid", "TRUE")} AS valid_rate, {domains},
 round(avg(latency_ms), 9) AS mean_ms, quantile_disc(latency_ms, 0.95) AS p95_ms FROM r)"""


def _gates_sql(bounds: dict[str, float]) -> dict[str, str]:
    tests = {"recall": f"coalesce(recall, 0) >= {bounds['recall']}", "false_positive_rate": f"coalesce(false_positive_rate, 1) <= {bounds['false_positive_rate']}"}
    if "warned_high" in bounds:
        tests["warned_high"] = f"warned_high <= {bounds['warned_high']}"
    if "domain_recall" in bounds:
        tests["domain_recall"] = " AND ".join(f"coalesce(recall_{d}, 0) >= {bounds['domain_recall']}" for d in evaluate.DOMAINS)
    return tests | {"valid_rate": f"coalesce(valid_rate, 0) >= {bounds['valid_rate']}"}


def oracle_sql():
    domain = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{w}') THEN '{d}'" for d, w in evaluate._DOMAIN_WORDS) + " ELSE 'unclassified' END"
    words = f"list_filter(regexp_split_to_array({squeezed_sql('text')}, '[^\\p{{L}}\\p{{N}}%·.]+'), lambda w: length(w) >= 2)"
    strict, near, rerun = _gates_sql(pilot.PILOT), _gates_sql(pilot.NEAR), _gates_sql(pilot.RERUN)
    every = lambda tests: " AND ".join(f"({t})" for t in tests.values())
    named = lambda tests: ", ".join(f"({t}) AS gate_{k}" for k, t in tests.items())
    legacy = """g AS (SELECT 'risk_part_' || p_partkey AS id, p_partkey AS n, p_brand AS category, p_type AS pattern_type, p_name, p_size::DOUBLE AS severity_floor,
 CASE WHEN p_partkey % 7 = 0 THEN 'draft' WHEN p_partkey % 2 = 0 THEN 'rejected' ELSE 'draft' END AS review_status, p_partkey % 9 <> 0 AS version_ok FROM part)"""
    verdict = _VERDICT.replace("STATUS", "status")
    draft_row = """p AS (SELECT p_partkey + 1 AS row_no, CASE WHEN p_partkey % 8 = 3 THEN ' ' ELSE p_name END AS keyword, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS category FROM part),
q AS (SELECT *, row_number() OVER (ORDER BY row_no) - 1 AS k FROM p WHERE row_no <= 50 AND trim(keyword) <> ''),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(trim(keyword)), '[^\\p{L}\\p{N}%·.]+'), lambda x: length(x) >= 2) AS ws, CASE WHEN trim(category) = '' THEN 'to be sorted' ELSE category END AS dom FROM q)"""
    return {
        "rules_upserted": f"{_STORE} SELECT id, revision, category, created_at, updated_at FROM o WHERE id NOT IN (SELECT id FROM f) UNION ALL SELECT f.id, f.revision, f.category, coalesce(o.created_at, 't9'), 't9' FROM f LEFT JOIN o ON o.id = f.id",
        # The merge brings in only what is new, and none of it over what the upsert made of one revision.
        "store_round_trip": f"{_STORE} SELECT id, revision, category, created_at, updated_at FROM o WHERE id NOT IN (SELECT id FROM f) AND id <> 'risk_part_7' UNION ALL SELECT f.id, f.revision, f.category, CASE WHEN o.id IS NULL THEN f.created_at ELSE o.created_at END, CASE WHEN o.id IS NULL THEN f.updated_at ELSE 't9' END FROM f LEFT JOIN o ON o.id = f.id WHERE f.id <> 'risk_part_7'",
        "store_migrated": f"{_STORE} SELECT id, revision, CASE n % 4 WHEN 0 THEN 'reviewed' WHEN 1 THEN 'rejected' ELSE 'draft' END AS review_status, (SELECT count(*) FROM o) AS stored_rows FROM o",
        "rules_inserted": f"{_STORE} SELECT id, revision, category, created_at, updated_at FROM o UNION ALL SELECT * FROM f WHERE id NOT IN (SELECT id FROM o)",
        "rule_deleted": f"{_STORE} SELECT id, revision, category, created_at, updated_at FROM o WHERE id <> 'risk_part_7'",
        "seeds_upgraded": f"{_STORE}, u AS (SELECT f.* FROM f JOIN o ON o.id = f.id WHERE o.created_at = o.updated_at AND f.revision > o.revision) SELECT id, revision, category, created_at, updated_at FROM o WHERE id NOT IN (SELECT id FROM u) UNION ALL SELECT * FROM u",
        "newest_page": f"{_STORE} SELECT id, created_at FROM o ORDER BY created_at DESC, id DESC LIMIT 20",
        "stored_payloads": f"{_STORE} SELECT id, revision FROM o WHERE n % 5 <> 0",
        "rule_by_key": f"{_STORE} SELECT id, revision, category, created_at, updated_at FROM o WHERE id = 'risk_part_5'",
        "rules_migrated": f"WITH {legacy} SELECT id, 1 AS revision, category, pattern_type, severity_floor, review_status, version_ok, 'trigger:' || p_name || '|context:' || pattern_type AS groups, CASE WHEN n % 6 = 0 THEN 'paragraph' ELSE 'sentence' END AS scope, CASE WHEN n % 4 = 0 THEN 13 ELSE 48 END AS max_distance, 'legacy_' || id AS source_id FROM g",
        "rules_validated": f"WITH {legacy} SELECT id, concat_ws('|', CASE WHEN n % 5 = 0 THEN 'category' END, CASE WHEN n % 11 = 0 THEN 'severity_floor' END, CASE WHEN n % 13 = 0 THEN 'updated_at' END, CASE WHEN n % 3 = 0 THEN 'risk_reason|safe_rewrite|risk_summary|risk_domain|source_title' END) AS errors FROM g",
        "export_rewrites": f"WITH {legacy} SELECT id, category, pattern_type, category AS safe_rewrite FROM g WHERE version_ok AND n % 3 = 0",
        "export_sources": f"WITH {legacy} SELECT id, 's' || n AS source_id, 'part' AS title, 'https://example.com/' AS url, '' AS date, 'verified' AS provenance_status FROM g WHERE version_ok AND n % 3 = 0",
        "export_rules": f"WITH {legacy} SELECT id, 'reviewed' AS review_status, p_name AS trigger, pattern_type AS context FROM g WHERE version_ok AND n % 3 = 0",
        "rules_patched": f"WITH {_BOOK} SELECT id, 2 AS revision, CASE WHEN n % 4 = 1 THEN 'patched' ELSE category END AS category, array_to_string(tags, '|') || '|seen' AS recent_context_tags, 'source of ' || id AS source, 'note' AS memo, 't1' AS updated_at, 'draft' AS review_status FROM b",
        "drafts_from_table": f"WITH {draft_row} SELECT 'risk_draft_' || strftime(TIMESTAMP '{_START}' + to_seconds(k), '%Y%m%d%H%M%S') AS id, trim(keyword) AS surface_meaning, dom AS risk_domain, 'draft' AS review_status, CASE WHEN len(ws) >= 2 THEN ws[1] ELSE trim(keyword) END AS trigger, CASE WHEN len(ws) >= 2 THEN ws[-1] ELSE dom END AS context FROM w",
        "frozen_cases": f"WITH {_CASES} SELECT doc_id, expected, 'FB' || lpad(row_number() OVER (ORDER BY doc_id)::VARCHAR, 9, '0') AS case_id FROM c",
        "frozen_checks": f"WITH {_CASES}, x AS (SELECT count(*) = 30 AND count_if(expected = 'risky') = 10 AND count_if(expected = 'safe') = 10 AND count_if(expected = 'ambiguous') = 10 AS composition, count(DISTINCT source) >= 2 AS enough_sources, TRUE AS source_cap, count(DISTINCT CASE WHEN lang IN ('en', 'de') THEN lang END) = 2 AS all_domains, TRUE AS texts_once FROM c) SELECT *, composition AND enough_sources AND source_cap AND all_domains AND texts_once AS passed FROM x",
        "root_causes": f"WITH {_CASES}, x AS (SELECT CASE WHEN expected = 'risky' AND status = 'no_match' THEN 'missing_skill' WHEN expected = 'safe' AND status <> 'no_match' THEN 'engine_context' WHEN expected = 'ambiguous' AND status = 'high' THEN 'scoring_or_output' END AS cause FROM c) SELECT cause, CASE cause WHEN 'missing_skill' THEN 'skill_bundle' WHEN 'engine_context' THEN 'engine' WHEN 'scoring_or_output' THEN 'evaluation_only' END AS layer, count(*) AS n FROM x GROUP BY cause",
        "draft_words": f"WITH x AS (SELECT doc_id, {words} AS ws FROM documents) SELECT doc_id, CASE WHEN len(ws) >= 2 THEN ws[1] END AS first_word, CASE WHEN len(ws) >= 2 THEN ws[-1] END AS last_word FROM x",
        "score_ranges": "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS low, CASE WHEN p_partkey % 4 <> 0 THEN p_size + 10 END AS high FROM part",
        "compact_times": "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS compact FROM events",
        "web_urls": "SELECT page_id, page_id % 3 = 2 AND coalesce(regexp_matches(url, '(?i)^https?://'), FALSE) AS is_web FROM pages",
        "text_search": "SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', text, source)), 'the')",
        "domains_of_texts": f"SELECT {domain} AS domain, count(*) AS n FROM documents GROUP BY 1",
        "domain_hints": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'finance' WHEN 1 THEN 'general' END AS hint FROM part",
        "cache_keys": f"SELECT doc_id, sha256('{schemas.PAYLOAD_VERSION}:1' || coalesce(':' || text, '')) AS key FROM documents",
        "secret_scan": "SELECT doc_id FROM documents WHERE contains(coalesce(text, ''), 'AKIA') OR contains(coalesce(text, ''), 'password') OR contains(coalesce(source, ''), 'AKIA') OR contains(coalesce(source, ''), 'password')",
        "token_costs": "SELECT doc_id, round((n_chars * 0.25::DOUBLE + 150) / 1e6, 9) AS cost FROM documents",
        "quote_spans": "SELECT doc_id, CASE WHEN placed THEN n + 2 END AS first_start, CASE WHEN placed THEN n + 1 END AS last_start, CASE WHEN placed THEN n + 2 END AS last_end FROM (SELECT doc_id, length(coalesce(text, ''))::INT AS n, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND length(coalesce(text, '')) > 0 AS placed FROM documents)",
        "names_in_utf16_order": """WITH s AS (SELECT doc_id, source || CASE doc_id % 4 WHEN 0 THEN chr(128512) WHEN 1 THEN chr(65281) WHEN 2 THEN chr(57344) ELSE 'é' END || doc_id AS name FROM documents)
SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id % 64 ORDER BY list_aggregate(list_transform(string_split(name, ''), lambda c: CASE WHEN ord(c) >= 65536 THEN printf('%04X%04X', 55296 + ((ord(c) - 65536) >> 10), 56320 + ((ord(c) - 65536) & 1023)) ELSE printf('%04X', ord(c)) END), 'string_agg', '')) AS place FROM s""",
        "statuses_of_runs": "SELECT doc_id, CASE WHEN n_chars % 4 = 0 OR n_chars % 7 = 0 THEN 'review' WHEN n_chars % 3 = 0 AND n_chars % 10 >= 5 THEN 'no_match' ELSE 'review' END AS status, CASE WHEN n_chars % 4 <> 0 THEN CASE WHEN n_chars % 5 = 0 THEN 'cache_hit' ELSE 'success' END WHEN n_chars % 8 = 0 THEN 'timeout' WHEN n_chars % 12 = 0 THEN 'rate_limited' ELSE 'failed' END AS label FROM documents",
        "failed_decisions": "SELECT doc_id, 'review' AS status, CASE WHEN n_chars % 101 = 0 THEN 55 ELSE greatest(55, least(69, n_chars % 101)) END::DOUBLE AS score, n_chars % 2 = 0 AS suppressed_high FROM documents",
        "runs_overlaid": f"WITH {_CASES} SELECT doc_id, expected, CASE WHEN doc_id % 4 = 0 THEN 'no_match' ELSE status END AS status FROM c",
        "runs_to_do": "SELECT doc_id FROM documents WHERE doc_id % 2 = 1 OR doc_id % 5 = 0 OR text IS NULL",
        "case_union": f"WITH {_CASES} SELECT 'labelled:' || doc_id AS case_id, 'labelled' AS dataset, expected AS expected_class, '' AS domain, '' AS annotated_speech_act, length(coalesce(text, '')) AS n_chars FROM c UNION ALL SELECT 'benchmark:' || item_id, 'benchmark', 'safe', 'general', '', length(coalesce(text, '')) FROM benchmark",
        "case_union_checks": "SELECT n, n = 1 AS count_ok, TRUE AS ids_once FROM (SELECT (SELECT count(*) FROM documents d JOIN labels l ON l.doc_id = d.doc_id) + (SELECT count(*) FROM benchmark) AS n)",
        "pilot_metrics": f"WITH {_CASES}, {_RUNS}, {_pilot_sql()} SELECT * FROM m",
        "pilot_gate": f"WITH {_CASES}, {_RUNS}, {_pilot_sql()} SELECT {named(strict)}, {every(strict)} AS passed, {every(near)} AS near FROM m",
        "rerun_gate": f"WITH {_CASES}, {_RUNS}, {_pilot_sql()} SELECT {named(rerun)}, TRUE AS all_improved, {every(rerun)} AS viable FROM m",
        "safe_distribution": f"WITH {_CASES}, v AS (SELECT unnest(['high', 'review', 'attention', 'no_match']) AS value) SELECT value, count(status) AS n FROM v LEFT JOIN (SELECT status FROM c WHERE expected = 'safe') ON status = value GROUP BY value",
        "smoke_checks": f"WITH {_CASES}, x AS (SELECT count(*) = 5 AS complete, TRUE AS all_valid, TRUE AS none_exhausted, count_if(doc_id % 20 = 0) = 0 AS none_timed_out FROM c) SELECT *, complete AND none_timed_out AS passed FROM x",
        "development_summary": f"WITH {_CASES}, {_RUNS} SELECT count(*) AS n, count_if(expected = 'risky' AND status = 'high') AS risky_high, count_if(expected = 'risky' AND status <> 'no_match') AS risky_found, count_if(expected = 'safe' AND status = 'no_match') AS safe_clear, count_if(expected = 'ambiguous' AND status <> 'high') AS ambiguous_open, min(score) AS least_score, max(score) AS most_score FROM r",
        "result_table": f"""WITH {_CASES}, {_RUNS} SELECT doc_id::VARCHAR AS case_id, expected, status AS rules_status, (doc_id % 101)::VARCHAR AS rules_score, CASE WHEN doc_id % 2 = 0 THEN 'uncertain' ELSE '' END AS risk_intent, speech_act, '' AS confidence,
 valid::VARCHAR AS valid, status, (doc_id % 101)::VARCHAR AS score, {verdict} AS verdict, 'risk_a|risk_' || doc_id AS rule_ids, printf('%.3f', latency_ms) AS latency_ms, printf('%.8f', (doc_id % 7)::DOUBLE / 8) AS cost,
 'dataset=' || coalesce(lang, '') || ';domain=' || domain || ';input_hash=' || coalesce(sha256(text), '') || ';conflict=' || (doc_id % 2 = 0)::VARCHAR AS notes FROM r""",
    }
