"""Mixing to target weights by iterative proportional fitting, in DataFrame functions only.

Documents fall into cells of (source, language, topic). The cells' token weights are raked:
in turn, each dimension's weights are scaled to its target shares, round after round, and no
cell's weight goes over ``max_boost`` times its own share of the tokens (bounded raking). A
document is then kept with the probability weight / share, over the greatest such ratio: the
expected tokens of the sample have the raked shares, and nothing is repeated.

A target is an exponent e (shares go as the observed share to the power e; 1 keeps them) or
weights by value; values without a weight keep their observed share before all are scaled.

Only the cells are raked: some for each combination of values, whatever the number of
documents. They are counted: up to MAX_ONE_TASK go through the windows of one task without a
shuffle, more are dealt by each dimension's values in turn. They are written every few rounds;
totals are single numbers. Documents are read twice and never shuffled unless the cells outgrow
a broadcast, which Spark checks against its own limit.

Defined cases: a null or missing value of a dimension is the value ``(none)``; a null or empty
text has no tokens, weighs nothing, and is kept as its cell is; rows that share a doc_id share
their fate; texts of any length are read whole; an empty table gives no rows. ``mix`` carries all
columns as they are, whatever their names; in ``calibrated`` a column of the input that bears the
name of an output column gives way to it. A column ``topic`` is a dimension, not a clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import discard, fresh, table, uniform, written, yielding
from loomspan.llm.packing import n_words

NONE = "(none)"
DIMS = ("source", "lang", "topic")
TARGETS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
ROUNDS, WRITE_EVERY, MAX_BOOST = 24, 6, 1.5
MAX_ONE_TASK = 1 << 18
# Topics by the first pattern that a text holds.
TOPICS = (
    ("licence", "(?i:licen[cs]e|copyright)"),
    ("contact", r"@[A-Za-z0-9-]+\.|\+[0-9]"),
    ("figures", "[0-9]"),
    ("exclaiming", "!"),
)
OTHER_TOPIC = "prose"


def topic_of(text: Column, topics: tuple[tuple[str, str], ...] = TOPICS) -> Column:
    """The first topic (name, expression) whose expression the text holds."""
    found = F.when(F.lit(False), F.lit(OTHER_TOPIC))
    for name, pattern in topics:
        found = found.when(text.rlike(pattern), F.lit(name))
    return found.otherwise(F.lit(OTHER_TOPIC))


#: The columns that ``calibrated`` adds.
ADDED = ("_source", "_lang", "_topic", "_tokens", "p", "kept")


def _with_cells(docs: DataFrame, names: list[str], topics: tuple[tuple[str, str], ...]) -> DataFrame:
    """docs with source, lang, topic and tokens under the names; a column ``topic`` counts if there is one."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)) if c in docs.columns else F.lit(NONE)
    topic = value("topic") if "topic" in docs.columns else topic_of(F.coalesce(F.col("text"), F.lit("")), topics)
    return docs.withColumns(dict(zip(names, (value("source"), value("lang"), topic, n_words(F.col("text"))), strict=True)))


def rake(cells: DataFrame, targets: dict[str, float | dict[str, float]], rounds: int = ROUNDS, max_boost: float = MAX_BOOST) -> DataFrame:
    """cells (_source, _lang, _topic, tokens) with their share of all tokens, and the raked weight."""
    whole = cells.where("tokens > 0").agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).collect()[0]
    dealt = (lambda df: df.coalesce(1)) if whole["n"] <= MAX_ONE_TASK else (lambda df: df)
    over = lambda *by: Window.partitionBy(*by)
    rows = dealt(cells.where("tokens > 0")).withColumn("share", F.col("tokens") / F.lit(float(max(whole["tokens"], 1))))
    for dim in DIMS:
        target, seen = targets.get(dim, 1.0), F.sum("share").over(over(f"_{dim}"))
        rows = rows.withColumn(f"t_{dim}", seen)
        if isinstance(target, dict):
            known = F.create_map(*(x for k, v in sorted(target.items()) for x in (F.lit(k), F.lit(float(v)))))
            rows = rows.withColumn(f"t_{dim}", F.coalesce(known[F.col(f"_{dim}")], F.col(f"t_{dim}")))
        else:
            rows = rows.withColumn(f"t_{dim}", F.pow(f"t_{dim}", F.lit(float(target))))
        # Each value's target once: its first cell carries it into the sum.
        first = F.row_number().over(over(f"_{dim}").orderBy(*(f"_{d}" for d in DIMS))) == 1
        rows = rows.withColumn(f"g_{dim}", F.when(first, F.col(f"t_{dim}")).otherwise(0.0))
    now = written(rows, "cells")
    sums = now.agg(*(F.coalesce(F.sum(f"g_{d}"), F.lit(1.0)).alias(d) for d in DIMS)).collect()[0]
    rows = dealt(now).withColumns({f"t_{d}": F.col(f"t_{d}") / F.lit(sums[d]) for d in DIMS}).drop(*(f"g_{d}" for d in DIMS)).withColumn("weight", F.col("share"))
    for k in range(rounds):
        if k and k % WRITE_EVERY == 0:
            before, now = now, written(rows, "cells")
            discard(before)
            rows = dealt(now)
        for dim in DIMS:
            rows = rows.withColumn("weight", F.col("weight") * F.col(f"t_{dim}") / F.sum("weight").over(over(f"_{dim}")))
        rows = rows.withColumn("weight", F.least("weight", F.col("share") * max_boost))
    out = written(rows, "cells")
    discard(now)
    return out


def _judged(docs: DataFrame, names: list[str], targets: dict | None, rounds: int, max_boost: float, topics: tuple[tuple[str, str], ...]) -> DataFrame:
    """docs with source, lang, topic, tokens, probability and verdict under the names."""
    *cell, tokens, p, kept = names
    cut, keys = _with_cells(docs, [*cell, tokens], topics), [f"_{d}" for d in DIMS]
    cells = written(cut.select(*(F.col(c).alias(k) for c, k in zip(cell, keys, strict=True)), F.col(tokens).alias("n")).groupBy(*keys).agg(F.sum("n").alias("tokens")), "cells")
    raked = rake(cells, TARGETS if targets is None else targets, rounds, max_boost)
    ratio = F.col("weight") / F.col("share")
    most = raked.agg(F.coalesce(F.max(ratio), F.lit(1.0)).alias("x")).collect()[0]["x"]
    odds = raked.select(*(F.col(k).alias(c) for k, c in zip(keys, cell, strict=True)), (ratio / F.lit(most)).alias(p))
    found = cut.join(odds, cell, "left").withColumn(p, F.coalesce(F.col(p), F.lit(1.0)))
    return found.withColumn(kept, uniform("doc_id", "mix") < F.col(p))


def calibrated(docs: DataFrame, targets: dict | None = None, rounds: int = ROUNDS, max_boost: float = MAX_BOOST, topics: tuple[tuple[str, str], ...] = TOPICS) -> DataFrame:
    """docs with their cell (_source, _lang, _topic), _tokens, the probability p and kept."""
    return _judged(yielding(docs, *ADDED), list(ADDED), targets, rounds, max_boost, topics)


def mix(docs: DataFrame, targets: dict | None = None, rounds: int = ROUNDS, max_boost: float = MAX_BOOST, topics: tuple[tuple[str, str], ...] = TOPICS) -> DataFrame:
    """The sampled documents; their own columns alone."""
    names = fresh(docs, *ADDED)
    return _judged(docs, names, targets, rounds, max_boost, topics).where(names[-1]).select(*docs.columns)


def op4_raked_mixture(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    return calibrated(docs).select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("p", 6).alias("p"), "kept")


def _sql() -> str:
    topics = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{name}'" for name, p in TOPICS)
    keys = ", ".join(DIMS)
    steps = []
    for k in range(ROUNDS):
        for n, dim in enumerate(DIMS):
            steps.append(f"r{k}_{n} AS (SELECT * REPLACE (weight * t_{dim} / sum(weight) OVER (PARTITION BY {dim}) AS weight) FROM {f'r{k}' if n == 0 else f'r{k}_{n - 1}'})")
        steps.append(f"r{k + 1} AS (SELECT * REPLACE (least(weight, share * {MAX_BOOST}) AS weight) FROM r{k}_{len(DIMS) - 1})")
    goals = ", ".join(f"g_{d} AS (SELECT {d}, pow(sum(share), {TARGETS[d]}) AS g FROM sh GROUP BY {d}), t_{d} AS (SELECT {d}, g / sum(g) OVER () AS t_{d} FROM g_{d})" for d in DIMS)
    joins = " ".join(f"JOIN t_{d} USING ({d})" for d in DIMS)
    return rf"""
WITH d AS (SELECT doc_id, source AS s0, lang AS l0, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, s0, l0, source, lang, CASE {topics} ELSE '{OTHER_TOPIC}' END AS topic, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM d),
ce AS (SELECT {keys}, sum(n_tokens)::DOUBLE AS tokens FROM c GROUP BY {keys} HAVING sum(n_tokens) > 0),
sh AS (SELECT {keys}, tokens / sum(tokens) OVER () AS share FROM ce),
{goals},
r0 AS (SELECT *, share AS weight FROM sh {joins}),
{", ".join(steps)},
o AS (SELECT {keys}, (weight / share) / max(weight / share) OVER () AS p FROM r{ROUNDS}),
j AS (SELECT c.doc_id, s0, l0, c.topic, n_tokens, coalesce(p, 1.0) AS p FROM c LEFT JOIN o USING ({keys}))
SELECT doc_id, s0 AS source, l0 AS lang, topic, n_tokens, round(p, 6) AS p,
       ('0x' || substr(md5(concat_ws(':', 'mix', doc_id)), 1, 8))::BIGINT / 4294967296.0 < p AS kept
FROM j
"""


OP4_SQL = _sql()
