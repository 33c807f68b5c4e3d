"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule rejects a text by counts of it. Each rule's cost and rejection rate are estimated on a
sample, over which its whole test is run several times, less an empty job; the rules are then tried in order of rejections per second, and CASE computes nothing for a text that an earlier
rule rejected. The order changes what is computed, never what is kept.

Defined cases: a null text has no words and fails; whole texts are counted, of any length, inside
their row, so no group is gathered; an empty table gives no rows; repeated rows each give a row;
rules of equal worth go by name; columns of the input are carried as they are whatever their
names (a count is never taken from a column that bears its name).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import fresh, table

# Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
GRAM, LEAST_WORDS = 8, 20
SAMPLE_ROWS = 1000
#: A rule is timed over so many runs of the sample.
REPEATS = 4


def _count_of(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, gram: int = GRAM) -> Column:
    """Words inside windows of so many words that occur twice or more.

    Windows are compared by 64-bit hashes. Where no two are alike, which a hash set tells,
    nothing is sorted. Else the windows are sorted by hash, and the starts of those equal
    to a neighbour cover their words.
    """

    def covered(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            same = lambda k, d: F.coalesce(F.get(s, k + d)["h"] == s[k]["h"], F.lit(False))
            starts = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, -1) | same(k, 1)), lambda k: s[k]["i"]))
            return _let(starts, lambda d: F.aggregate(F.transform(d, lambda x, k: F.least(F.lit(gram), F.coalesce(F.get(d, k + 1) - x, F.lit(gram)))), F.lit(0), lambda a, x: a + x))

        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, of_sorted))

    def side_by_side(x: Column, apart: int) -> Column:
        return F.zip_with(F.slice(x, 1, F.size(x) - apart), F.slice(x, apart + 1, F.size(x)), lambda a, b: F.xxhash64(a, b))

    def widened(x: Column, width: int) -> Column:
        if width == gram:
            return covered(x)
        apart = min(width, gram - width)
        return _let(side_by_side(x, apart), lambda y: widened(y, width + apart))

    # A word is hashed once; a window's hash is that of two narrower windows which cover it.
    return F.when(F.size(words) < gram, F.lit(0)).otherwise(_let(F.transform(words, lambda w: F.xxhash64(w)), lambda x: widened(x, 1))).cast("long")


#: A count of a text by name: from the text, or from its words where they are needed.
FEATURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: _count_of(text, r"[^\x20\x09-\x0D]+"),
    "full": lambda text, words: F.coalesce(text.rlike(rf"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){{{LEAST_WORDS}}}"), F.lit(False)),
    "word_chars": lambda text, words: F.coalesce(F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long"),
    "n_symbols": lambda text, words: _count_of(text, f"[{SYMBOLS}]"),
    "n_exclaims": lambda text, words: _count_of(text, "!"),
    "n_lines": lambda text, words: F.coalesce(F.size(_lines(text)), F.lit(0)).cast("long"),
    "n_dup_lines": lambda text, words: F.coalesce(_let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long"),
    "n_repeat_words": lambda text, words: repeated_words(words),
}


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


@dataclass(frozen=True)
class Rule:
    """Rejects where test(counts) holds; needs names the counts."""

    name: str
    needs: tuple[str, ...]
    test: Callable[[dict[str, Column]], Column]


RULES = (
    Rule("few_words", ("full",), lambda c: ~c["full"]),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda c: 100 * c["n_repeat_words"] > 30 * c["n_words"]),
    Rule("symbols", ("n_words", "n_symbols"), lambda c: (c["n_symbols"] > 0) & (10 * c["n_symbols"] > 3 * c["n_words"])),
    Rule("exclaims", ("n_words", "n_exclaims"), lambda c: (c["n_exclaims"] > 0) & (10 * c["n_exclaims"] > 3 * c["n_words"])),
    Rule("dup_lines", ("n_lines", "n_dup_lines"), lambda c: (c["n_dup_lines"] >= 3) & (2 * c["n_dup_lines"] > c["n_lines"])),
    Rule("word_length", ("n_words", "word_chars"), lambda c: (c["word_chars"] > 25 * c["n_words"]) | (2 * c["word_chars"] < 3 * c["n_words"])),
)
BASE_RULES = ("few_words", "repeats")


def _counts(names: tuple[str, ...]) -> dict[str, Column]:
    """The counts by name, each an expression over the text alone, evaluated where it stands."""
    return {n: FEATURES[n](F.col("text"), words_of(F.col("text"))) for n in names}


def _rejects(rule: Rule) -> Column:
    return F.coalesce(rule.test(_counts(rule.needs)), F.lit(True))


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Each rule's seconds for a sampled text and its rejection rate, best rule first.

    The sample (about so many rows) is kept in executors' memory and recomputed if one is lost.
    A rule's job runs its whole test REPEATS times over the sample, once to warm up and once for
    the clock; the time of a job that only repeats the rows is taken off.
    """
    total = docs.count()
    sample = docs.select("text").sample(min(1.0, sample_rows / max(total, 1)), 17).persist()

    def timed(test: Column) -> tuple[float, int]:
        for _ in range(2):  # a plan of its own each time: a second run of one plan would reuse its shuffle
            rows = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
            began = time.perf_counter()
            hits = rows.agg(F.count_if(test & (F.col("again") > 0)).alias("x")).collect()[0]["x"]
        return time.perf_counter() - began, hits // REPEATS

    try:
        n, found = sample.count(), []
        empty = timed(F.length("text") < 0)[0] if n else 0.0
        for rule in rules if n else ():
            seconds, rejected = timed(_rejects(rule))
            found.append({"rule": rule, "seconds": max((seconds - empty) / REPEATS, 1e-7) / n, "rate": rejected / n})
    finally:
        sample.unpersist()
    return sorted(found or [{"rule": r, "seconds": 0.0, "rate": 0.0} for r in rules], key=lambda x: (-x["rate"] / max(x["seconds"], 1e-12), x["rule"].name))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The order that ``estimate`` gives: rank, rule, microseconds a text, rejection rate."""
    rows = [(k, x["rule"].name, x["seconds"] * 1e6, x["rate"]) for k, x in enumerate(estimate(docs, rules), 1)]
    return docs.sparkSession.createDataFrame(rows, "rank int, rule string, microseconds double, rate double")


def verdict(ordered: list[Rule], rejects: Callable[[Rule], Column] = _rejects) -> Column:
    """Whether no rule rejects. CASE stops at the first rule that does."""
    out = None
    for rule in ordered:
        out = F.when(rejects(rule), F.lit(False)) if out is None else out.when(rejects(rule), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects; their own columns alone."""
    (kept,) = fresh(docs, "kept")
    return docs.withColumn(kept, verdict([x["rule"] for x in estimate(docs, rules)])).where(kept).select(*docs.columns)


def judged(docs: DataFrame, ordered: list[Rule]) -> DataFrame:
    """(doc_id, all counts, base_failed, kept) of docs: here every count is asked for, and the
    cascade goes over the counts."""
    words = docs.select("doc_id", "text", words_of(F.col("text")).alias("words"))
    counts = {n: f(F.col("text"), F.col("words")) for n, f in FEATURES.items()} | {"n_words": F.size("words").cast("long"), "full": F.size("words") >= LEAST_WORDS}
    counted = words.select("doc_id", *(c.alias(n) for n, c in counts.items()))
    rejects = lambda rule: F.coalesce(rule.test({n: F.col(n) for n in rule.needs}), F.lit(True))
    failed = F.lit(False)
    for rule in RULES:
        failed = failed | rejects(rule) if rule.name in BASE_RULES else failed
    return counted.withColumns({"base_failed": failed, "kept": verdict(ordered, rejects)})


def op3_quality_cascade(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = judged(docs, [x["rule"] for x in estimate(docs)])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i+7], ' ')) AS n FROM g),
s AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS x FROM h WHERE n > 1),
r AS (SELECT doc_id, sum(x)::BIGINT AS n_repeat_words FROM s GROUP BY doc_id),
c AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         len(l)::BIGINT AS n_lines, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclaims, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 10 * n_exclaims > 3 * n_words OR (n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines)
            OR word_chars > 25 * n_words OR 2 * word_chars < 3 * n_words) AS kept
FROM b
"""
