"""Names, callables and SQL of the queries over the rule engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import evaluate, interpreter, matching, privacy
from loomspan.operators.rules import DEMO_PACK, DEMO_RULES, Policy
from loomspan.plans import book_queries, data_queries, review_queries
from loomspan.plans import matching_sql as S
from loomspan.sources.tables import table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def _analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.analyze(_texts(spark, sf_dir), DEMO_RULES, Policy(), DEMO_PACK)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final score, grade, status and speech act of every document."""
    first = F.get("matches", F.lit(0))["rule_id"]
    return _analyzed(spark, sf_dir).select("doc_id", F.size("matches").cast("long").alias("n_matches"), first.alias("primary_rule"), "dominant_floor", "final_score", "grade", "status", "speech_act")


def normalize_ws_lower(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", T.squeezed(F.col("text")).alias("normalized"))


def text_fingerprint(spark, sf_dir):
    cut = F.substring("text", 1, privacy.MAX_CHARS)
    return _texts(spark, sf_dir).select("doc_id", T.fingerprint(F.col("text")).alias("sha256"), cut.alias("head"), T.utf16_length(F.col("text")).cast("long").alias("units"))


def sentence_split(spark, sf_dir):
    found = _texts(spark, sf_dir).select("doc_id", F.posexplode_outer(T.sentences(T.levelled(F.col("text")))).alias("sid", "s")).where("sid IS NOT NULL")
    return found.select("doc_id", "sid", F.col("s.start").alias("st"), F.col("s.end").alias("en"), F.col("s.par").alias("par"), F.col("s.text").alias("sentence"))


def adjacent_windows(spark, sf_dir):
    found = matching.with_windows(_texts(spark, sf_dir)).select("doc_id", F.explode_outer("_windows").alias("w")).where("w IS NOT NULL")
    return found.select("doc_id", F.col("w.idx").alias("idx"), F.col("w.pair").alias("pair"), F.col("w.start").alias("st"), F.col("w.end").alias("en"), F.length("w.text").alias("n_chars"))


def pattern_hits(spark, sf_dir):
    """Hits of all patterns of all usable rules, in every window that the rule looks at."""
    found = matching.all_hits(matching.usable(DEMO_RULES), DEMO_PACK)
    hits = _texts(spark, sf_dir).select("doc_id", F.explode(found("text")).alias("h"))
    return hits.select("doc_id", "h.rule_id", "h.role", "h.idx", "h.pattern", F.col("h.start").alias("hs"), F.col("h.end").alias("he"))


def combination_candidates(spark, sf_dir):
    """All combinations within distance that no exclusion or guard drops."""
    rules = matching.usable(DEMO_RULES)
    found = matching.with_candidates(_texts(spark, sf_dir), rules, DEMO_PACK).select("doc_id", F.explode_outer("_candidates").alias("c")).where("c IS NOT NULL")
    return found.select("doc_id", F.col("c.rule_id").alias("rule_id"), *(F.col(f"c.{a}").alias(b) for a, b in (("gap", "gap"), ("envelope", "envelope"), ("start", "start"), ("end", "end_at"), ("trigger", "trigger"), ("context", "context"), ("window", "window_no"))))


def best_matches(spark, sf_dir):
    found = matching.find_matches(_texts(spark, sf_dir), DEMO_RULES, DEMO_PACK).select("doc_id", F.posexplode_outer("matches").alias("k", "m")).where("k IS NOT NULL")
    fields = ("rule_id", "category", "score", "gap", "envelope", "trigger", "context", "start", "t_start", "t_end", "c_start", "c_end", "s_start", "s_end")
    return found.select("doc_id", (F.col("k") + 1).cast("long").alias("rank"), *(F.col(f"m.{f}").alias(f) for f in fields))


def category_scores(spark, sf_dir):
    found = _analyzed(spark, sf_dir).select("doc_id", F.explode_outer("category_scores").alias("c")).where("c IS NOT NULL")
    return found.select("doc_id", F.col("c.category").alias("category"), F.col("c.score").alias("score"), F.array_join("c.rule_ids", "|").alias("rule_ids"))


def grade_distribution(spark, sf_dir):
    return flagship(spark, sf_dir).groupBy("grade", "status").agg(F.count("*").alias("n"), F.round(F.avg("final_score"), 6).alias("mean_score"))


def highlight_segments(spark, sf_dir):
    first = F.get("matches", F.lit(0))
    found = matching.find_matches(_texts(spark, sf_dir), DEMO_RULES, DEMO_PACK)
    segments = F.when(F.size("matches") > 0, matching.highlight(F.col("text"), matching.evidence_of(first)))
    found = found.select("doc_id", F.posexplode_outer(segments).alias("k", "h")).where("k IS NOT NULL")
    return found.select("doc_id", F.col("k").cast("long").alias("k"), F.col("h.start").alias("st"), F.col("h.end").alias("en"), F.col("h.role").alias("role"), F.col("h.text").alias("segment"))


_SIMPLE = tuple(x for x in privacy.MASK_PATTERNS if x[0] in ("email", "address"))


def mask_ranges_merged(spark, sf_dir):
    found = _texts(spark, sf_dir).withColumn("_r", privacy.mask_ranges(F.col("text"), _SIMPLE))
    return found.select("doc_id", F.size("_r").cast("long").alias("n_ranges"), privacy.masked(F.col("text"), F.col("_r")).alias("masked"))


def mask_pii_prepared(spark, sf_dir):
    """All kinds of ranges over the first characters; rows alone are checked, as RE2 has no look-around."""
    return privacy.prepare(_texts(spark, sf_dir)).select("doc_id", "input_hash", "model_text", F.size("mask_ranges").alias("n_ranges"), "is_masked", "is_cut")


def mask_pii_whole(spark, sf_dir):
    """All kinds of ranges over whole texts; without SQL, as RE2 has no look-around."""
    found = _texts(spark, sf_dir).withColumn("_r", privacy.mask_ranges(F.col("text")))
    kinds = F.array_join(F.transform("_r", lambda r: F.concat_ws(":", r["kind"], r["start"], r["end"])), ",")
    return found.select("doc_id", F.size("_r").cast("long").alias("n_ranges"), kinds.alias("ranges"), privacy.masked(F.col("text"), F.col("_r")).alias("masked"))


def advice_texts(spark, sf_dir):
    """What is said about a text: its first rule's reason under the speech act, a rewrite, and the advice."""
    return _analyzed(spark, sf_dir).select("doc_id", "reason", "rewrite", "advice")


def engine_eval(spark, sf_dir):
    """The engine's own statuses against the labels, by slice."""
    cases = data_queries._cases(spark, sf_dir).drop("status").join(flagship(spark, sf_dir).select("doc_id", "status"), "doc_id")
    return evaluate.by_slice(cases, "source", "lang")


def engine_hybrid(spark, sf_dir):
    """Rules and cue words together, over every text. The runs' masks need look-around: no SQL."""
    runs = interpreter.by_cue_words(_texts(spark, sf_dir))
    d = F.col("decision")
    return interpreter.hybrid(_analyzed(spark, sf_dir), runs, "doc_id").select("doc_id", "rules_status", "ok", d["status"].alias("status"), d["score"].alias("score"), F.array_join(d["reasons"], "|").alias("reasons"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {
        "final_scores": flagship,
        "normalize_ws_lower": normalize_ws_lower,
        "text_fingerprint": text_fingerprint,
        "sentence_split": sentence_split,
        "adjacent_windows": adjacent_windows,
        "pattern_hits": pattern_hits,
        "combination_candidates": combination_candidates,
        "best_matches": best_matches,
        "category_scores": category_scores,
        "grade_distribution": grade_distribution,
        "highlight_segments": highlight_segments,
        "mask_ranges_merged": mask_ranges_merged,
        "mask_pii_prepared": mask_pii_prepared,
        "mask_pii_whole": mask_pii_whole,
        "advice_texts": advice_texts,
        "engine_eval": engine_eval,
        "engine_hybrid": engine_hybrid,
    }
    return own | data_queries.queries() | book_queries.queries() | review_queries.queries()


def oracle_sql() -> dict[str, str]:
    matched = (S.SENTENCES, S.WINDOWS, S.hits_sql(), S.candidates_sql(), S.matches_sql())
    scored = (*matched, S.scores_sql())
    mask = lambda x: f"regexp_replace({x}, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{{2,}}|(?-i)[0-9]{{1,5}} [A-Z][a-z]+ (?:Street|Road|Avenue|Lane)', chr(2), 'g')"
    found = lambda x: f"regexp_extract_all({x}, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{{2,}}|(?-i)[0-9]{{1,5}} [A-Z][a-z]+ (?:Street|Road|Avenue|Lane)')"
    return {
        "final_scores": S.chain(*scored) + " SELECT * FROM scored",
        "normalize_ws_lower": f"SELECT doc_id, {S.squeezed('text')} AS normalized FROM documents",
        "text_fingerprint": f"SELECT doc_id, sha256(text) AS sha256, substring(text, 1, {privacy.MAX_CHARS}) AS head, length(text)::BIGINT AS units FROM documents",
        "sentence_split": S.chain(S.SENTENCES) + " SELECT doc_id, sid, st, en, par, s AS sentence FROM sent",
        "adjacent_windows": S.chain(S.SENTENCES, S.WINDOWS) + " SELECT doc_id, idx, pair, st, en, length(wt)::INT AS n_chars FROM win",
        "pattern_hits": S.chain(S.SENTENCES, S.WINDOWS, S.hits_sql()) + " SELECT DISTINCT doc_id, rule_id, role, idx, pattern, hs, he FROM hit",
        "combination_candidates": S.chain(*matched[:4]) + f" SELECT doc_id, rule_id, gap, envelope, start, end_at, trigger, context, window_no FROM cand c WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = c.doc_id AND c.rule_id IN ('risk_and_this', 'risk_with_for') AND regexp_matches({S.squeezed('x.text')}, '{DEMO_PACK.bare_amount}') AND NOT regexp_matches({S.squeezed('x.text')}, '{DEMO_PACK.sparing}'))",
        "best_matches": S.chain(*matched) + " SELECT doc_id, rank, rule_id, category, score, gap, envelope, trigger, context, start, t_start, t_end, c_start, c_end, s_start, s_end FROM m",
        "category_scores": S.chain(*scored) + " SELECT doc_id, category, score, rule_ids FROM cat",
        "grade_distribution": S.chain(*scored) + " SELECT grade, status, count(*) AS n, round(avg(final_score), 6) AS mean_score FROM scored GROUP BY grade, status",
        "advice_texts": S.chain(*scored) + _advice_sql(),
        "engine_eval": S.chain(*scored) + _engine_eval_sql(),
        "highlight_segments": S.chain(*matched) + _HIGHLIGHT,
        "mask_ranges_merged": f"""
SELECT doc_id, len({found('text')})::BIGINT AS n_ranges,
       array_to_string(list_transform(range(1, len(string_split({mask('text')}, chr(2))) + 1), lambda i: string_split({mask('text')}, chr(2))[i] || repeat('●', coalesce(length({found('text')}[i]), 0)::INT)), '') AS masked
FROM documents""",
    } | data_queries.oracle_sql() | book_queries.oracle_sql() | review_queries.oracle_sql()


def _advice_sql() -> str:
    silent = "speech_act IN ('warning', 'criticism', 'quotation')"
    prefix = "CASE speech_act WHEN 'condition' THEN 'Stated under conditions; check what they rest on. ' WHEN 'statement' THEN 'Stated as a fact; check its basis and scope. ' ELSE '' END"
    reason = "CASE primary_rule " + " ".join(f"WHEN '{r.id}' THEN '{r.reason}'" for r in DEMO_RULES) + " END"
    rewrite = "CASE primary_rule " + " ".join(f"WHEN '{r.id}' THEN '{r.rewrites[0]}'" for r in DEMO_RULES if r.rewrites) + " END"
    return f""" SELECT doc_id, CASE WHEN n_matches > 0 AND NOT {silent} THEN trim({prefix} || {reason}) END AS reason, CASE WHEN n_matches > 0 AND NOT {silent} THEN {rewrite} END AS rewrite,
 CASE WHEN n_matches = 0 THEN 'none_found' WHEN final_score >= 70 THEN 'revise' ELSE 'check' END AS advice FROM scored"""


def _engine_eval_sql() -> str:
    expected = "CASE WHEN toxic = 1 THEN 'risky' WHEN quality = 1 THEN 'safe' ELSE 'ambiguous' END"
    return f""", judged AS (SELECT x.source, x.lang, {expected} AS expected, s.status FROM documents x JOIN labels l ON l.doc_id = x.doc_id JOIN scored s ON s.doc_id = x.doc_id)
SELECT source, lang, {data_queries._METRICS} FROM judged GROUP BY GROUPING SETS ((), (source), (lang))"""


_HIGHLIGHT = """,
ev AS (SELECT doc_id, t_start AS a, t_end AS b, 'trigger' AS role FROM m WHERE rank = 1 UNION ALL SELECT doc_id, c_start, c_end, 'context' FROM m WHERE rank = 1
       UNION ALL SELECT doc_id, s_start, s_end, 'context' FROM m WHERE rank = 1 AND s_start IS NOT NULL),
pt AS (SELECT doc_id, a AS x FROM ev UNION SELECT doc_id, b FROM ev UNION SELECT doc_id, 0 FROM ev UNION SELECT e.doc_id, length(t) FROM ev e JOIN d ON d.doc_id = e.doc_id),
sgm AS (SELECT doc_id, x AS a, lead(x) OVER (PARTITION BY doc_id ORDER BY x) AS b FROM pt),
rl AS (SELECT s.doc_id, s.a, s.b, CASE WHEN bool_or(e.role = 'trigger') AND bool_or(e.role = 'context') THEN 'both' ELSE coalesce(max(e.role), 'plain') END AS role
       FROM sgm s LEFT JOIN ev e ON e.doc_id = s.doc_id AND e.a < s.b AND e.b > s.a WHERE s.b IS NOT NULL GROUP BY s.doc_id, s.a, s.b),
nv AS (SELECT *, lag(role) OVER (PARTITION BY doc_id ORDER BY a) IS DISTINCT FROM role AS fresh FROM rl),
nw AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY a) AS isle FROM nv),
hl AS (SELECT doc_id, isle, role, min(a)::INT AS st, max(b)::INT AS en FROM nw GROUP BY doc_id, isle, role)
SELECT h.doc_id, (isle - 1)::BIGINT AS k, st, en, role, substring(x.text, st + 1, en - st) AS segment FROM hl h JOIN documents x ON x.doc_id = h.doc_id"""
