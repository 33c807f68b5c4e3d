"""Evaluation over labelled sets: classes, verdicts, rates by slice, percentiles, samples, checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import SPACE, squeezed_nfkc
from loomspan.operators.ranks import first_rows, nearest_rank as nearest_rank

DOMAINS = ("health", "finance", "education", "legal", "privacy", "general")
_DOMAIN_WORDS = (("health", "health|medic|cure|beauty"), ("finance", "financ|invest|loan|money"), ("education", "educat|school|exam"), ("legal", "legal|law|court"), ("privacy", "privacy|surveil|tracking"), ("general", "general|other|retail"))


def expected_class(label: Column) -> Column:
    name = F.lower(F.trim(label))
    return (
        F.when(name.isin("risky", "detect", "high"), "risky").when(name.isin("safe", "no_match", "none"), "safe").when(name.isin("ambiguous", "boundary", "review"), "ambiguous").otherwise("invalid")
    )


def domain_of(text: Column) -> Column:
    out = None
    for name, words in _DOMAIN_WORDS:
        test = F.lower(text).rlike(words)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit("unclassified"))


def verdict(expected: Column, status: Column) -> Column:
    """PASS or FAIL; ambiguous cases are for REVIEW unless they are called high."""
    return (
        F.when(expected == "risky", F.when(status.isin("high", "attention", "review"), "PASS").otherwise("FAIL"))
        .when(expected == "safe", F.when(status == "no_match", "PASS").otherwise("FAIL"))
        .when(expected == "ambiguous", F.when(status == "high", "FAIL").otherwise("REVIEW"))
        .otherwise("NOT_GATED")
    )


def rate(part: Column, whole: Column) -> Column:
    """Rounded to nine places; null where there is nothing to divide by."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), 9)


def metrics() -> list[Column]:
    """Counts and rates over rows of (expected, status)."""
    e, s = F.col("expected"), F.col("status")
    n = lambda test: F.count_if(test)
    found = s != "no_match"
    return [
        F.count("*").alias("n"), n((e == "risky") & found).alias("true_found"), n((e == "safe") & found).alias("false_found"), n((e == "risky") & ~found).alias("missed"),
        rate(n((e == "risky") & found), n(e == "risky")).alias("recall"), rate(n((e == "safe") & (s == "high")), n(e == "safe")).alias("false_high_rate"), rate(n(s == "review"), F.count("*")).alias("review_rate"),
    ]


def by_slice(cases: DataFrame, *slices: str) -> DataFrame:
    """Metrics overall and by each slice: grouping sets of one pass."""
    sets = [[], *([s] for s in slices)]
    return cases.groupingSets([[F.col(c) for c in x] for x in sets], *slices).agg(*metrics())


def stratified(frame: DataFrame, strata: list[str], order: str, sizes: int | dict[str, int], text: str = "text", strict: bool = False) -> DataFrame:
    """The first rows of each stratum by order, with their rank. Strata go in order, and a text that
    one of them has taken is not taken again, by itself or by a later one.

    sizes is a number, or a number by the value of the last stratum column; with strict a stratum
    that comes out short is an error. A stratum needs its first different texts alone, as many as it and
    all before it may take, and none behind as many that no other stratum has as it takes itself: these
    are found in one pass, whatever the number of strata, and the choice among them is made on the
    driver, which holds little more than the sample.
    """
    if isinstance(sizes, int):
        size = F.lit(sizes)
    else:
        of = F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair)) if sizes else F.create_map().cast("map<string,int>")
        size = F.coalesce(F.try_element_at(of, F.col(strata[-1]).cast("string")), F.lit(0))
    columns = [F.col(c) for c in frame.columns]
    keyed = frame.withColumn("_h", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    once = keyed.groupBy(*strata, "_h").agg(F.min_by(F.struct(*columns), F.struct(F.col(order), F.to_json(F.struct(*columns)))).alias("_r"))
    groups = once.select(*strata).distinct().withColumn("_size", size)
    so_far = Window.orderBy(*strata).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each stratum
    groups = groups.withColumns({"_most": F.sum("_size").over(so_far), "_number": F.row_number().over(Window.orderBy(*strata))})
    other = groups.select(*(F.col(c).alias(f"_s{k}") for k, c in enumerate(strata)), "_size", "_most", "_number")
    same = F.lit(True)
    for k, c in enumerate(strata):
        same = same & F.col(c).eqNullSafe(F.col(f"_s{k}"))
    ready = once.join(F.broadcast(other) if groups.limit(10_001).count() <= 10_000 else other, same)
    ready = ready.withColumns({"_alone": F.count("*").over(Window.partitionBy("_h")) == 1, "_o": F.col("_r")[order]})
    ranked = first_rows(ready.select("_number", "_size", "_most", "_alone", "_h", "_o", "_r"), ["_number"], [F.col("_o"), F.col("_h")], F.col("_most"))
    earlier = Window.partitionBy("_number").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    needed = ranked.withColumn("_sure", F.coalesce(F.sum(F.col("_alone").cast("int")).over(earlier), F.lit(0))).where("_sure < _size")
    taken: set[str] = set()
    rows: list[tuple] = []
    counts: dict[int, int] = {}
    for r in needed.select("_number", "_size", "_h", "_r", "_rank").orderBy("_number", "_rank").toLocalIterator():
        if counts.get(r["_number"], 0) < r["_size"] and r["_h"] not in taken:
            taken.add(r["_h"])
            counts[r["_number"]] = counts.get(r["_number"], 0) + 1
            rows.append((*r["_r"], counts[r["_number"]]))
    if strict:
        short = [r for r in groups.collect() if counts.get(r["_number"], 0) < r["_size"]]
        if short:
            values, n = tuple(short[0][c] for c in strata), counts.get(short[0]["_number"], 0)
            raise ValueError(f"stratum {values} has {n} rows where {short[0]['_size']} are due")
    return frame.sparkSession.createDataFrame(rows, frame.withColumn("rank", F.lit(1)).schema)


def leaked(fresh: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of fresh, repeated ones too, any of whose columns stands in one of known's, whatever its case and spaces."""
    clean = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    values = known.select(F.explode(F.array(*(clean(F.col(c).cast("string")) for c in columns if c in known.columns))).alias("v")).where("v <> ''").distinct()
    own = [c for c in columns if c in fresh.columns]
    found, hit = fresh, F.lit(False)
    # A blank cell stands for no text: its key is its row's own, so that blanks do not meet in one task.
    blank = F.concat(F.lit("\x00"), F.xxhash64(*fresh.columns).cast("string"))
    for k, c in enumerate(own):  # one join a column, so a row stays one row
        found = found.withColumn(f"_v{k}", F.coalesce(F.nullif(clean(F.col(c).cast("string")), F.lit("")), blank)).join(values.select(F.col("v").alias(f"_v{k}"), F.lit(True).alias(f"_hit{k}")), f"_v{k}", "left")
        hit = hit | F.coalesce(f"_hit{k}", F.lit(False))
    return found.where(hit).select(*fresh.columns)


def consistent(runs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Whether all runs of a case agree in the columns."""
    print_ = F.sha2(F.to_json(F.struct(*columns)), 256)
    return runs.groupBy(key).agg(F.count("*").alias("n_runs"), (F.count_distinct(print_) == 1).alias("consistent"))


def gates(metric_row: DataFrame, **least: float) -> DataFrame:
    """A column for each bound (name__min or name__max) and ``passed``: all of them; a missing figure fails."""
    tests = {}
    for name, bound in least.items():
        column, kind = name.rsplit("__", 1)
        tests[name] = F.coalesce(F.col(column) >= bound if kind == "min" else F.col(column) <= bound, F.lit(False))
    all_of = F.lit(True)
    for t in tests.values():
        all_of = all_of & t
    return metric_row.withColumns(tests | {"passed": all_of})


def overlaid(base: DataFrame, rerun: DataFrame, key: str) -> DataFrame:
    """base with the columns of rerun where a row was run again."""
    again = rerun.select(key, *(F.col(c).alias(f"_{c}") for c in rerun.columns if c != key))
    out = base.join(again, key, "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in out.columns else F.col(c) for c in base.columns))


def table_profile(frame: DataFrame, columns: list[str]) -> DataFrame:
    """total, valid (some cell filled), invalid and duplicate rows by a normalised key of the columns."""
    clean = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s+", " ")))
    keyed = frame.select(F.concat_ws("\x1f", *(clean(c) for c in columns)).alias("key"), (F.concat(*(clean(c) for c in columns)) != "").alias("valid"))
    counted = keyed.groupBy("valid", F.sha2("key", 256).alias("h")).agg(F.count("*").alias("n"))
    n = lambda test, what: F.coalesce(F.sum(F.when(test, what)), F.lit(0))
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), n(F.col("valid"), F.col("n")).alias("valid"), n(~F.col("valid"), F.col("n")).alias("invalid"), n(F.col("valid"), F.col("n") - 1).alias("duplicates")
    )


# What the names of columns tell of a table.
PROFILES = (("matching_type", "hate_speech"), ("어원/원단어", "controversy"), ("root_word", "false_advertising"), ("원단어", "false_advertising"))
CATEGORY_NAMES, ROOT_NAMES = r"(?i)category|분류", r"(?i)root_word|어원/원단어|원단어"
PREVIEW = 50


def csv_rows(rows: DataFrame, headers: list[str]) -> DataFrame:
    """(cells, valid, key, root, category) of rows of cells: valid ones are as wide as the headers and not all blank.

    key and root are normalised, a category is trimmed alone; roots and categories of invalid rows are null,
    as are blank ones, and all of them where no header names such a column.
    """
    place = lambda pattern: next((k for k, h in enumerate(headers) if re.search(pattern, h)), None)
    bare = lambda c: F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")
    cells = rows.select("cells").withColumn("valid", (F.size("cells") == len(headers)) & F.exists("cells", lambda c: bare(F.coalesce(c, F.lit(""))) != ""))
    cell = lambda at: F.lit(None).cast("string") if at is None else F.when(F.col("valid"), F.nullif(bare(F.get("cells", F.lit(at))), F.lit("")))
    filled = F.transform("cells", lambda c: F.coalesce(c, F.lit("")))
    named = cells.withColumns({"key": squeezed_nfkc(F.array_join(filled, "\u241f")), "root": squeezed_nfkc(cell(place(ROOT_NAMES))), "category": cell(place(CATEGORY_NAMES))})
    # Spaces beside a cell's border do not count.
    return named.withColumn("key", F.when(F.col("valid"), F.sha2(F.regexp_replace("key", " ?\u241f ?", "\u241f"), 256)))


def csv_summary(rows: DataFrame, headers: list[str]) -> DataFrame:
    """One row: profile, total, valid, invalid, duplicates, unique_roots, preview of a table of cells under headers."""
    headers = [h.strip() for h in headers]
    joined = "|".join(headers).lower()
    profile = next((name for part, name in PROFILES if part in joined), "generic")
    n = F.count_if("valid")
    one = csv_rows(rows, headers).agg(F.count("*").alias("total"), n.alias("valid"), (F.count("*") - n).alias("invalid"), (n - F.count_distinct("key")).alias("duplicates"), F.count_distinct("root").alias("unique_roots"))
    return one.select(F.lit(profile).alias("profile"), "*", F.least("valid", F.lit(PREVIEW)).alias("preview"))


def csv_categories(rows: DataFrame, headers: list[str]) -> DataFrame:
    """(name, n) of the categories of valid rows; a report orders them by count, then name."""
    return csv_rows(rows, [h.strip() for h in headers]).where("category IS NOT NULL").groupBy(F.col("category").alias("name")).agg(F.count("*").alias("n"))


def facet(frame: DataFrame, column: str) -> DataFrame:
    return frame.groupBy(F.trim(column).alias("name")).agg(F.count("*").alias("n")).where("name <> ''")


# ---- blocks of a release report ----------------------------------------------------------------


def distribution(frame: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """(value, n) of each value of a fixed domain, those that do not occur with 0."""
    one = frame.agg(*(F.count_if(F.col(column) == v).alias(f"n{k}") for k, v in enumerate(values)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(v).alias("value"), F.col(f"n{k}").alias("n")) for k, v in enumerate(values)))).alias("x")).select("x.*")


def recall_by_domain(cases: DataFrame) -> DataFrame:
    """(domain, risky, found, recall) of each fixed domain; no risky case, no recall."""
    risky = F.col("expected") == "risky"
    one = cases.agg(*(c for k, d in enumerate(DOMAINS) for c in (F.count_if(risky & (F.col("domain") == d)).alias(f"n{k}"), F.count_if(risky & (F.col("domain") == d) & (F.col("status") != "no_match")).alias(f"f{k}"))))
    rows = F.array(*(F.struct(F.lit(d).alias("domain"), F.col(f"n{k}").alias("risky"), F.col(f"f{k}").alias("found")) for k, d in enumerate(DOMAINS)))
    return one.select(F.explode(rows).alias("x")).select("x.*").withColumn("recall", rate(F.col("found"), F.col("risky")))


def failing(cases: DataFrame, key: str) -> DataFrame:
    """(verdict, key) of the cases that fail: rows, so that no list of all grows in one cell."""
    return cases.withColumn("verdict", verdict(F.col("expected"), F.col("status"))).where("verdict = 'FAIL'").select("verdict", key)


def failure_type(expected: Column, status: Column, score: Column, low: Column, high: Column) -> Column:
    """Why a case fails, null where it passes: missed, false alarm, called high, or a score out of its range."""
    return (
        F.when((expected == "risky") & (status == "no_match"), "false_negative")
        .when((expected == "safe") & (status != "no_match"), "false_positive")
        .when((expected == "ambiguous") & (status == "high"), "over_confident")
        .when((score < low) | (score > high), "score_mismatch")
    )


def before_after(base: DataFrame, rerun: DataFrame, key: str) -> DataFrame:
    """(key, before, after, changed, improved) of the cases that were run again."""
    rank = lambda v: F.element_at(F.create_map(F.lit("PASS"), F.lit(2), F.lit("REVIEW"), F.lit(1), F.lit("FAIL"), F.lit(0)), v)
    both = base.select(key, F.col("verdict").alias("before")).join(rerun.select(key, F.col("verdict").alias("after")), key)
    return both.withColumns({"changed": F.col("before") != F.col("after"), "improved": rank(F.col("after")) > rank(F.col("before"))})


def false_high_in_context(cases: DataFrame) -> DataFrame:
    """How many safe cases are called high though the annotated or the predicted act is a warning or criticism."""
    acts = ("warning", "criticism")
    test = (F.col("expected") == "safe") & (F.col("status") == "high") & (F.coalesce(F.col("annotated_act").isin(*acts), F.lit(False)) | F.coalesce(F.col("predicted_act").isin(*acts), F.lit(False)))
    return cases.agg(F.count_if(test).alias("n"))


def means(frame: DataFrame, *columns: str) -> DataFrame:
    """The average of each column, rounded to nine places; null for no rows."""
    return frame.agg(*(F.round(F.avg(c), 9).alias(f"mean_{c}") for c in columns))
