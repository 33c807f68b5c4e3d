"""Readers and writers of rule books, policies, labelled sets and result tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from loomspan import schemas
from loomspan.operators.rules import Policy
from loomspan.operators.rulebook import migrated, rule_errors

BOM = "^﻿"


def read_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Quoted CSV with line breaks in cells, all strings, blank rows dropped; also whole trees."""
    frame = spark.read.csv(path, header=header, multiLine=True, quote='"', escape='"', recursiveFileLookup=True, enforceSchema=False)
    frame = frame.toDF(*(c.lstrip("﻿") for c in frame.columns))
    return frame.where(F.concat_ws("", *frame.columns) != "")


_CSV_PIECES = re.compile(r'""|"|,|\r\n|\r|\n|[^",\r\n]+')


def parse_csv(text: str) -> list[list[str]]:
    """Rows of one small CSV text: a quote toggles wherever it stands, two inside quotes are one; ragged
    rows stay, rows without any character go, and an open quote takes the rest."""
    return _csv_rows(text.lstrip("\ufeff"))


def _csv_rows(text: str) -> list[list[str]]:
    rows, row, cell, inside = [], [], [], False
    for piece in _CSV_PIECES.findall(text):
        if piece == '""':
            cell += ['"'] if inside else []
        elif piece == '"':
            inside = not inside
        elif inside or piece[0] not in ",\r\n":
            cell.append(piece)
        else:
            row.append("".join(cell))
            cell = []
            if piece != ",":
                rows.append(row)
                row = []
    rows.append([*row, "".join(cell)])
    return [r for r in rows if any(r)]


#: Rows are parsed together until their text has so many characters.
_CSV_BLOCK = 1 << 16
#: The states of so many chunks at most are sent to all tasks.
MAX_SENT = 1 << 16
_CSV_PARTS = "file string, block long, line long, part string, cells array<string>, text string"


def _csv_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole rows of each chunk, and what of its text belongs to a row that began before it or goes on behind it.

    Lines (file, block, opened, value) come in their order; opened tells whether the chunk begins inside quotes.
    """
    now, held, first, number, size, inside, head, out = None, [], 0, 0, 0, False, False, []

    def flush(part: str) -> None:
        nonlocal held, size
        text = "\n".join(held)
        if part == "rows":
            out.extend((*now, first + k, part, cells, None) for k, cells in enumerate(_csv_rows(text)))
        else:
            out.append((*now, first, part, None, text))
        held, size = [], 0

    def leave() -> None:
        if now is not None and held:
            flush(("all" if head else "tail") if inside else "rows")

    for frame in frames:
        for file, block, opened, value in zip(frame["file"], frame["block"], frame["opened"], frame["value"], strict=True):
            if (file, block) != now:
                leave()
                now, number, inside, head = (file, block), 0, bool(opened), bool(opened)
            if not held:
                first = number
            held.append(value)
            number, size = number + len(value) + 1, size + len(value)  # no row of a line has a number of a later one
            closed = inside and value.count('"') % 2 == 1 or not inside and value.count('"') % 2 == 0
            was, inside = inside, not closed
            if head and closed:  # the row from before ends here
                flush("head")
                head = False
            elif not head and inside and not was and len(held) > 1:  # whole rows before the one that goes on
                last = held.pop()
                flush("rows")
                held, size, first = [last], len(last), number - len(last) - 1
            elif closed and size > _CSV_BLOCK:
                flush("rows")
        if out:
            yield pd.DataFrame(out, columns=["file", "block", "line", "part", "cells", "text"])
            out = []
    leave()
    if out:
        yield pd.DataFrame(out, columns=["file", "block", "line", "part", "cells", "text"])


def toggling_csv(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, cells) of ``parse_csv``'s rows of large files; ordered by the first three, they are in the files' order.

    A file is read in the chunks that Spark splits it into. Whether a chunk begins inside quotes is
    the parity of all quotes before it: one count for each chunk, summed over the chunks before.
    Rows inside a chunk are parsed where they are read; of a row over chunks only its pieces move. A quote
    that never ends makes one cell of the rest of its file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.octet_length("value").alias("bytes"), "value")
    start = (F.col("block") == 0) & F.col("value").startswith("\ufeff") & (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0)
    lines = lines.withColumn("value", F.when(start, F.regexp_replace("value", f"{BOM}+", "")).otherwise(F.col("value")))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counted = lines.groupBy("file", "block").agg(F.sum(quotes).alias("q"), F.sum(F.col("bytes") + 1).alias("bytes"), F.first("size").alias("size"))
    chunks = counted.select("file", "block", (F.coalesce(F.sum("q").over(before), F.lit(0)) % 2 == 1).alias("opened"))
    # A line feed at the end of a file is in no line; it belongs to a cell that never ends.
    fed = counted.groupBy("file").agg((F.first("size") - F.sum("bytes")).isin(0, 3).alias("fed"))  # a byte order mark is no line's
    if chunks.limit(MAX_SENT + 1).count() <= MAX_SENT:  # lines stay where they were read, in their order
        ready = lines.join(F.broadcast(chunks), ["file", "block"])
    else:
        placed = lines.withColumn("id", F.monotonically_increasing_id()).join(chunks, ["file", "block"])
        ready = placed.repartition("file", "block").sortWithinPartitions("file", "block", "id")
    parts = ready.select("file", "block", "opened", "value").mapInPandas(_csv_parts, _CSV_PARTS)
    whole = parts.where("part = 'rows'").select("file", "block", "line", "cells")
    pieces = parts.where("part <> 'rows'")
    upto = Window.partitionBy("file").orderBy("block", "line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = pieces.withColumn("row", F.sum(F.when(F.col("part") == "tail", 1).otherwise(0)).over(upto)).groupBy("file", "row")
    joined = rows.agg(F.sort_array(F.collect_list(F.struct("block", "line", "text"))).alias("p"), F.bool_or(F.col("part") == "head").alias("closed")).select("file", F.get("p", F.lit(0))["block"].alias("block"), F.get("p", F.lit(0))["line"].alias("line"), F.array_join("p.text", "\n").alias("text"), "closed")
    joined = joined.join(fed, "file").withColumn("text", F.when(~F.col("closed") & F.col("fed"), F.concat("text", F.lit("\n"))).otherwise(F.col("text")))
    parsed = joined.withColumn("cells", F.explode(_rows_of_text("text")))
    return whole.unionByName(parsed.select("file", "block", "line", "cells"))


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def _rows_of_text(texts: pd.Series) -> pd.Series:
    return texts.map(_csv_rows)


def column_like(frame: DataFrame, pattern: str) -> str | None:
    """The first column whose name matches."""
    return next((c for c in frame.columns if re.search(pattern, c, re.I)), None)


def read_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid rules of a JSON-lines file, and issues (line_no, id, errors).

    A line is rejected if it is no JSON object, its version is unknown, a rule of its id came
    before, or the rule breaks a check. Files of one line a rule are numbered by file order.
    """
    lines = spark.read.text(path).where(F.trim(F.regexp_replace("value", BOM, "")) != "")
    lines = lines.select(F.regexp_replace("value", BOM, "").alias("value"), F.monotonically_increasing_id().alias("line_no"))
    parsed = lines.withColumn("r", F.from_json("value", schemas.RULE_INPUT)).select("line_no", (F.trim("value").startswith("{") & F.json_object_keys("value").isNotNull()).alias("is_json"), "r.*")
    both = _with_lines(parsed)
    repeated = F.row_number().over(Window.partitionBy("id").orderBy("line_no")) > 1
    errors = F.when(~F.coalesce("is_json", F.lit(False)), F.array(F.lit("json"))).otherwise(F.array_compact(F.concat(F.array(F.when(~F.col("version_ok"), F.lit("version")), F.when(F.col("_again") & (F.col("id") != ""), F.lit("repeated_id"))), rule_errors())))
    checked = both.withColumn("_again", repeated).withColumn("errors", errors)
    good = checked.where(F.size("errors") == 0).drop("line_no", "is_json", "version_ok", "_again", "errors")
    return good, checked.where(F.size("errors") > 0).select("line_no", "id", "errors")


def _with_lines(parsed: DataFrame) -> DataFrame:
    """The migrated rules with line_no and is_json, carried through the projection in memo: no join."""
    carried = parsed.withColumn("memo", F.to_json(F.struct("memo", "line_no", "is_json")))
    out = migrated(carried).withColumn("_m", F.from_json("memo", "memo string, line_no long, is_json boolean"))
    out = out.withColumns({"line_no": F.col("_m.line_no"), "is_json": F.col("_m.is_json"), "memo": F.coalesce("_m.memo", F.lit(""))})
    return out.drop("_m")


def read_policy(spark: SparkSession, path: str) -> tuple[Policy, list[str]]:
    """The policy of a JSON file and what is wrong with it; any fault gives the default policy."""
    rows = spark.read.schema(schemas.POLICY).json(path, multiLine=True).limit(2).collect()
    base = Policy()
    if len(rows) != 1:
        return base, ["one JSON object is expected"]
    r = rows[0].asDict(recursive=True)
    pick = lambda name, default: default if r[name] is None else r[name]
    grades = tuple((g["grade"], g["min"], g["max"]) for g in r["grade_thresholds"] or ()) or base.grades
    found = Policy(
        pick("no_match_score", base.no_match_score), pick("category_corroboration_per_pattern", base.corroboration_per_pattern), pick("max_category_corroboration", base.max_corroboration),
        pick("secondary_category_weight", base.second_weight), pick("tertiary_category_weight", base.third_weight), pick("max_cross_category_support", base.max_support), grades,
    )
    issues = [n for n, v, top in (("no_match_score", found.no_match_score, 100), ("corroboration", found.corroboration_per_pattern, 100), ("max_corroboration", found.max_corroboration, 100), ("second_weight", found.second_weight, 1), ("third_weight", found.third_weight, 1), ("max_support", found.max_support, 100)) if not 0 <= v <= top]
    issues += [f"grade {g}" for g, a, b in grades if g is None or a is None or b is None or not 0 <= a <= b <= 100]
    return (base, issues) if issues else (found, [])


def write_csv(frame: DataFrame, path: str, quote_all: bool = False) -> None:
    """Cells quoted where needed, with the white space they have; arrays and structs must be joined to strings before."""
    frame.write.mode("error").csv(path, header=True, escape='"', quoteAll=quote_all, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_crlf_csv(frame: DataFrame, path: str) -> None:
    """CSV whose lines end in CR and LF, each file with the header; cells are quoted only for a comma,
    a quote or a line break, and keep their own line breaks. Nulls are empty."""
    quoted = lambda c: F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = lambda cells: F.concat_ws(",", *(quoted(c) for c in cells))
    header = line([F.lit(c) for c in frame.columns])
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # of its file, as a task writes one
    row = line([F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in frame.columns])
    lines = frame.select(F.when(first, F.concat(header, F.lit("\r\n"), row)).otherwise(row).alias("value"))
    if frame.isEmpty():
        lines = frame.sparkSession.range(0, 1, 1, 1).select(header.alias("value"))
    lines.write.mode("error").text(path, lineSep="\r\n")


def write_lines(frame: DataFrame, path: str) -> None:
    """A column ``value`` as one text file: for books and reports, which are small."""
    frame.coalesce(1).write.mode("error").text(path)
