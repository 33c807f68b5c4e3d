"""The other forms of a verdict: by score, by what a case expects, and over repeated runs.

Each takes columns and gives struct<verdict, failure_type>; failure_type is empty for a PASS.
``evaluate.verdict`` is the form that leaves ambiguous cases for review. A null status, score or
expectation fails what asks for it; a class that is none of the three is judged as ambiguous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From these scores on, a safe case is a false positive, and an ambiguous one is over-high.
FOUND, OVER = 70, 80


def _told(*failures: tuple[Column, str]) -> Column:
    """The first failure whose test holds; a test that is null holds."""
    kind = F.lit("")
    for test, name in reversed(failures):
        kind = F.when(F.coalesce(test, F.lit(True)), F.lit(name)).otherwise(kind)
    return F.struct(F.when(kind == "", "PASS").otherwise("FAIL").alias("verdict"), kind.alias("failure_type"))


def _classes(expected: Column) -> tuple[Column, Column, Column]:
    risky, safe = (F.coalesce(expected == x, F.lit(False)) for x in ("risky", "safe"))
    return risky, safe, ~(risky | safe)


def strict(expected: Column, status: Column) -> Column:
    """Risky cases have to come out as high; nothing else may."""
    risky, safe, open_ = _classes(expected)
    return _told(
        (risky & F.coalesce(status != "high", F.lit(True)), "false_negative"), (safe & F.coalesce(status != "no_match", F.lit(True)), "false_positive"), (open_ & F.coalesce(status == "high", F.lit(True)), "ambiguous_overhigh"),
    )


def by_score(expected: Column, confidence: Column, score: Column) -> Column:
    """By score alone; risky cases count where their label is sure."""
    risky, safe, open_ = _classes(expected)
    sure = F.coalesce(confidence == "high", F.lit(False))
    return _told((risky & sure & F.coalesce(score < FOUND, F.lit(True)), "false_negative"), (safe & F.coalesce(score >= FOUND, F.lit(True)), "false_positive"), (open_ & F.coalesce(score >= OVER, F.lit(True)), "ambiguous_high"))


def by_target(status: Column, score: Column, rule_ids: Column, due_status: Column, least: Column, most: Column, due_rule: Column) -> Column:
    """A case expects a status, a range of scores and, unless it is null or empty, a rule."""
    no_rule = F.coalesce(due_rule, F.lit("")) == ""
    right = F.coalesce(status == due_status, F.lit(False)) & F.coalesce(score.between(least, most), F.lit(False)) & (no_rule | F.coalesce(F.array_contains(rule_ids, due_rule), F.lit(False)))
    return _told((~right & F.coalesce((score >= FOUND) & (due_status == "no_match"), F.lit(False)), "false_positive"), (~right, "false_negative_or_mismatch"))


def by_repeat(expected: Column, status: Column, score: Column, least: Column, most: Column, consistent: Column) -> Column:
    """Runs have to agree, then the score to lie in its range, then the class to come out."""
    risky, safe, open_ = _classes(expected)
    return _told(
        (~consistent, "inconsistent_repeat"), (~score.between(least, most), "outside_expected_range"), (risky & F.coalesce(status == "no_match", F.lit(True)), "false_negative"),
        (safe & F.coalesce(status != "no_match", F.lit(True)), "false_positive"), (open_ & F.coalesce(status == "high", F.lit(True)), "boundary_overhigh"),
    )


def repeat_agreement(runs: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """(key, consistent): whether a case has a row in each run, and all its rows agree in the columns."""
    if not runs:
        raise ValueError("no run")
    every = None
    for n, run in enumerate(runs):
        part = run.select(key, F.lit(n).alias("_run"), F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("_print"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(key).agg(((F.min("_print") == F.max("_print")) & (F.count_distinct("_run") == len(runs))).alias("consistent"))
