"""Labelled cases of several sources as one table, and the gates and result tables of a pilot run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan import schemas
from loomspan.operators.evaluate import DOMAINS, distribution, rate
from loomspan.operators.ranks import nearest_rank

_CASE_COLUMNS = [field.split()[0] for field in schemas.CASE.split(", ")]
#: Bounds of the pilot's gate, of the looser one, and of a rerun.
PILOT = {"recall": 0.85, "false_positive_rate": 0.05, "warned_high": 0, "domain_recall": 0.6, "valid_rate": 0.99}
NEAR = {"recall": 0.8, "false_positive_rate": 0.1, "warned_high": 1, "domain_recall": 0.5, "valid_rate": 0.95}
RERUN = {"recall": 0.85, "false_positive_rate": 0.1, "valid_rate": 0.95}


def cases(sources: dict[str, DataFrame]) -> DataFrame:
    """One table of the sources' cases (``schemas.CASE``); a case is named source:case_id. What a source does not have is empty."""
    out = None
    for name, rows in sources.items():
        known = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("") for c in _CASE_COLUMNS}
        known |= {"dataset": F.lit(name), "case_id": F.concat(F.lit(f"{name}:"), F.col("case_id").cast("string"))}
        part = rows.select(*(known[c].alias(c) for c in _CASE_COLUMNS))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no source of cases")
    return out


def case_checks(found: DataFrame, expected: int) -> DataFrame:
    """One row: how many cases there are, whether as many as expected, and whether each id is one case's."""
    per_id = found.groupBy("case_id").agg(F.count("*").alias("k"))
    one = per_id.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.max("k"), F.lit(0)).alias("most"))
    return one.select("n", (F.col("n") == expected).alias("count_ok"), (F.col("most") <= 1).alias("ids_once"))


def pilot_metrics(runs: DataFrame) -> DataFrame:
    """One row of figures of runs (expected, domain, status, annotated_act, speech_act, valid, latency_ms)."""
    c = F.col
    risky, safe, found = c("expected") == "risky", c("expected") == "safe", c("status") != "no_match"
    told = F.coalesce(c("annotated_act").isin("warning", "criticism"), F.lit(False)) | F.coalesce(c("speech_act").isin("warning", "criticism"), F.lit(False))
    n = F.count_if
    by_domain = [rate(n(risky & found & (c("domain") == d)), n(risky & (c("domain") == d))).alias(f"recall_{d}") for d in DOMAINS]
    one = runs.agg(
        F.count("*").alias("n"), n(risky).alias("risky"), n(safe).alias("safe"), n(c("expected") == "ambiguous").alias("ambiguous"), rate(n(risky & found), n(risky)).alias("recall"),
        rate(n(safe & found), n(safe)).alias("false_positive_rate"), rate(n(c("status") == "review"), F.count("*")).alias("review_rate"), n(safe & told & (c("status") == "high")).alias("warned_high"),
        rate(n(c("valid")), F.count("*")).alias("valid_rate"), *by_domain, F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 9).alias("mean_ms"),
    )
    return one.crossJoin(nearest_rank(runs, "latency_ms", 0.95).select(F.col("at_rank").alias("p95_ms")))  # single rows


def _tests(bounds: dict[str, float]) -> dict[str, Column]:
    """A figure that is missing fails its bound."""
    c = F.col
    tests = {"recall": F.coalesce(c("recall"), F.lit(0.0)) >= bounds["recall"], "false_positive_rate": F.coalesce(c("false_positive_rate"), F.lit(1.0)) <= bounds["false_positive_rate"]}
    if "warned_high" in bounds:
        tests["warned_high"] = c("warned_high") <= bounds["warned_high"]
    if "domain_recall" in bounds:
        tests["domain_recall"] = F.forall(F.array(*(c(f"recall_{d}") for d in DOMAINS)), lambda r: F.coalesce(r, F.lit(0.0)) >= bounds["domain_recall"])
    return tests | {"valid_rate": F.coalesce(c("valid_rate"), F.lit(0.0)) >= bounds["valid_rate"]}


def _all(tests: dict[str, Column]) -> Column:
    return F.forall(F.array(*tests.values()), lambda t: t)


def pilot_gate(metrics: DataFrame) -> DataFrame:
    """The metrics with gate_<name> for each bound, passed, and near: whether the looser bounds hold."""
    tests = _tests(PILOT)
    return metrics.withColumns({f"gate_{k}": t for k, t in tests.items()} | {"passed": _all(tests), "near": _all(_tests(NEAR))})


def rerun_gate(metrics: DataFrame, base: DataFrame, rerun: DataFrame, watched: DataFrame, key: str = "case_id") -> DataFrame:
    """The metrics with gates of a rerun, and whether it is worth going on.

    base and rerun hold (key, risk_intent, status); each watched case must no longer be judged
    promotional, and come out as no_match. A watched case without a rerun counts as it was.
    """
    before = watched.select(key).join(base.select(key, "risk_intent", "status"), key, "left")
    after = before.join(rerun.select(key, F.col("risk_intent").alias("_i"), F.col("status").alias("_s")), key, "left")
    better = (F.coalesce("_i", "risk_intent") != "direct_promotional") & (F.coalesce("_s", "status") == "no_match")
    improved = after.agg(F.coalesce(F.bool_and(F.coalesce(better, F.lit(False))), F.lit(True)).alias("all_improved"))
    tests = _tests(RERUN)
    joined = metrics.crossJoin(improved)  # single rows
    both = tests | {"all_improved": F.col("all_improved")}
    return joined.withColumns({f"gate_{k}": t for k, t in tests.items()} | {"viable": _all(both)})


def class_distribution(runs: DataFrame, expected: str, statuses: tuple[str, ...] = ("high", "review", "attention", "no_match")) -> DataFrame:
    """(value, n) of the statuses of one class, those that do not occur with 0."""
    return distribution(runs.where(F.col("expected") == expected), "status", statuses)


def smoke(runs: DataFrame, due: int = 5) -> DataFrame:
    """One row of checks of a few first runs (valid, exhausted, timed_out): all are there, valid, and none was refused."""
    n = F.count_if
    one = runs.agg(F.count("*").alias("n"), n(F.col("valid")).alias("valid"), n(F.col("exhausted")).alias("exhausted"), n(F.col("timed_out")).alias("timed_out"))
    checks = {"complete": F.col("n") == due, "all_valid": F.col("valid") == F.col("n"), "none_exhausted": F.col("exhausted") == 0, "none_timed_out": F.col("timed_out") == 0}
    return one.select(*(t.alias(k) for k, t in checks.items())).withColumn("passed", _all({k: F.col(k) for k in checks}))


def summary(runs: DataFrame) -> DataFrame:
    """One row: how many cases of each class come out as due, at what range of scores."""
    e, s = F.col("expected"), F.col("status")
    n = F.count_if
    return runs.agg(
        F.count("*").alias("n"), n((e == "risky") & (s == "high")).alias("risky_high"), n((e == "risky") & (s != "no_match")).alias("risky_found"), n((e == "safe") & (s == "no_match")).alias("safe_clear"),
        n((e == "ambiguous") & (s != "high")).alias("ambiguous_open"), F.min("score").alias("least_score"), F.max("score").alias("most_score"),
    )


def result_rows(runs: DataFrame) -> DataFrame:
    """The result table of runs, all strings: ids joined by |, milliseconds of three places, cost of eight, notes key=value."""
    c = F.col
    text = lambda name: F.coalesce(c(name).cast("string"), F.lit(""))
    places = lambda name, k: F.format_string(f"%.{k}f", F.coalesce(c(name).cast("double"), F.lit(0.0)))
    notes = F.concat_ws(";", *(F.concat(F.lit(f"{k}="), text(k)) for k in ("dataset", "domain", "input_hash", "conflict")))
    plain = ("case_id", "expected", "rules_status", "rules_score", "risk_intent", "speech_act", "confidence", "valid", "status", "score", "verdict")
    return runs.select(*(text(n).alias(n) for n in plain), F.coalesce(F.array_join("rule_ids", "|"), F.lit("")).alias("rule_ids"), places("latency_ms", 3).alias("latency_ms"), places("cost", 8).alias("cost"), notes.alias("notes"))
