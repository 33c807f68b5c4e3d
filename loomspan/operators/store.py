"""The rule book as a stored table: scans, lookups, replacement and checked writes; repairs of labels.

Every step is a projection, a join or an aggregate; a book is replaced by a new table, never in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The largest request, rule, analysis request (bytes) and text (characters).
MAX_IMPORT, MAX_RULE, MAX_ANALYSIS, MAX_TEXT = 128 * 1024, 64 * 1024, 16 * 1024, 2000


def newest_first(book: DataFrame, reviewed: bool = False) -> DataFrame:
    """The stored rows by time of change, the last first; reviewed ones alone if asked."""
    rows = book.where("review_status = 'reviewed'") if reviewed else book
    return rows.orderBy(F.desc("updated_at"), "id")


def page(rows: DataFrame, size: int = 20) -> DataFrame:
    """The newest rows: by time of creation, then id, both descending. The limit is the feature."""
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(size)


def by_key(frame: DataFrame, key: str, value: str) -> DataFrame:
    return frame.where(F.col(key) == value).limit(1)


def parsed(stored: DataFrame, schema: str) -> DataFrame:
    """The payloads (JSON) of the stored rows as columns; rows whose payload is no object of the schema go."""
    rows = stored.select(F.from_json("payload", schema).alias("r"), F.json_object_keys("payload").alias("k"))
    return rows.where("k IS NOT NULL AND r.id IS NOT NULL").select("r.*")


def replaced(current: DataFrame, rows: DataFrame, confirmed: bool = False) -> DataFrame:
    """rows in place of the whole book; only if that was confirmed."""
    if not confirmed:
        raise ValueError("replacing a book has to be confirmed")
    return rows.select(current.columns)


def checked_write(frame: DataFrame, path: str, expected: int) -> None:
    """Writes the frame and counts what was written; another count is an error."""
    frame.write.mode("error").parquet(path)
    found = frame.sparkSession.read.parquet(path).count()
    if found != expected:
        raise RuntimeError(f"{found} rows were written where {expected} were due")


def within_limits(payload: Column, text: Column, most_bytes: int = MAX_ANALYSIS, most_chars: int = MAX_TEXT) -> Column:
    """What is too large about a request, or null."""
    return F.when(F.octet_length(payload) > most_bytes, "payload_too_large").when(F.length(F.trim(text)) == 0, "text_empty").when(F.length(text) > most_chars, "text_too_long")


def library(book: DataFrame, status: str | None = None, category: str | None = None, query: str = "", fields: tuple[str, ...] = ("id", "category")) -> DataFrame:
    """Rules by status, category and what their fields together hold, whatever its case."""
    test = F.lit(True)
    if status is not None:
        test = test & (F.col("review_status") == status)
    if category is not None:
        test = test & (F.col("category") == category)
    if query.strip():
        test = test & F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(query.strip().lower()))
    return book.where(test)


def counters(book: DataFrame) -> DataFrame:
    """One row: how many rules are reviewed, drafts, rejected, and reviewed and dominant."""
    of = lambda s: F.count_if(F.col("review_status") == s)
    return book.agg(of("reviewed").alias("reviewed"), of("draft").alias("draft"), of("rejected").alias("rejected"), F.count_if((F.col("review_status") == "reviewed") & F.col("dominant_risk")).alias("dominant"))


def replay_log(cases: DataFrame, order: str = "seq") -> DataFrame:
    """(input_hash, payload) of the valid runs of cases (text, payload, ok, seq), without any text:
    one for each text, of several the last, by hash."""
    valid = cases.where("ok").select(F.sha2("text", 256).alias("input_hash"), "payload", order)
    return valid.groupBy("input_hash").agg(F.max_by("payload", order).alias("payload")).orderBy("input_hash")


def repaired(labels: DataFrame, overrides: DataFrame, key: str = "case_id") -> DataFrame:
    """labels (key, expected, confidence, reason) with the overrides in, and misplaced cells mended.

    A confidence that is none of high, medium, low is the reason in the wrong cell; the class
    then gives the confidence: medium for ambiguous cases, else high.
    """
    over = overrides.select(key, F.col("expected").alias("_expected"), F.col("reason").alias("_reason"))
    rows = labels.join(over, key, "left").withColumn("expected", F.coalesce("_expected", "expected"))
    good = F.coalesce(F.col("confidence").isin("high", "medium", "low"), F.lit(False))
    mended = F.when(F.col("expected") == "ambiguous", "medium").otherwise("high")
    reason = F.coalesce("_reason", F.when(good, F.col("reason")).otherwise(F.coalesce("confidence", "reason")))
    return rows.withColumns({"reason": reason, "confidence": F.when(good, F.col("confidence")).otherwise(mended)}).select(labels.columns)


def related_rules(cases: DataFrame, by_case: DataFrame, by_category: DataFrame, key: str = "case_id") -> DataFrame:
    """cases with rule_ids: those listed for the case, else its category's, else none."""
    own, other = by_case.select(key, F.col("rule_ids").alias("_own")), by_category.select("category", F.col("rule_ids").alias("_other"))
    none = F.array().cast("array<string>")
    return cases.join(own, key, "left").join(other, "category", "left").withColumn("rule_ids", F.coalesce("_own", "_other", none)).drop("_own", "_other").select(*cases.columns, "rule_ids")


def numbered_lines(frame: DataFrame, order: str) -> DataFrame:
    """line_no by order. A book is small: its lines are numbered by one task."""
    return frame.withColumn("line_no", F.row_number().over(Window.orderBy(order)))
