"""Packing by optimal length buckets and token budgets.

Texts are cut into sequences of at most ``max_tokens`` words. One job counts how many
sequences have each length; dynamic programming over that histogram chooses the upper
lengths of the buckets that make the padding least. Inside a bucket, in a random order fixed
by a hash, each run of budget / upper length sequences is a batch.

The place inside a bucket is exact without one task that sees it all: a bucket is cut into
slices of the hash, slices are counted, and a place is what stands before the slice plus the
rank inside it. Only the last batch of a bucket may be short.

Defined cases: a null text, or one without words, is one sequence of length 0; a text of any
length is cut, never shortened, and its pieces joined are the text; repeated rows each give
their sequences; an empty table gives no rows; a null doc_id is a value like others; sequences of
one hash go by doc_id, then piece; a column of the input that bears the name of an output column
(whatever its case) gives way to it, all others are carried as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import fresh, slices, table, uniform, written, yielding

MAX_TOKENS, BUCKETS, BUDGET = 4096, 8, 65_536
#: The columns that packing adds.
ADDED = ("piece", "n_tokens", "bucket", "batch", "slot")
_SPACE, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def optimal_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """The upper lengths of at most so many buckets with the least padding in all.

    best[k][j] is the least padding of the j shortest lengths in k buckets; the last bucket
    reaches from some i to j, and of equal choices the least i counts. There are at most
    max_tokens + 1 lengths, so the time is bounded whatever the corpus.
    """
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    before = np.concatenate(([0], np.cumsum(counts)))
    tokens = np.concatenate(([0], np.cumsum(counts * lengths)))
    n, k_max = len(lengths), min(buckets, len(lengths))
    best = lengths * before[1:] - tokens[1:]
    best = np.concatenate(([0], best))
    chosen = np.zeros((k_max + 1, n + 1), np.int64)
    for k in range(2, k_max + 1):
        now = np.full(n + 1, np.iinfo(np.int64).max)
        for j in range(k, n + 1):
            i = np.arange(k - 1, j)
            cost = best[i] + lengths[j - 1] * (before[j] - before[i]) - (tokens[j] - tokens[i])
            at = int(cost.argmin())
            now[j], chosen[k, j] = cost[at], i[at]
        best = now
    bounds, j = [], n
    for k in range(k_max, 0, -1):
        bounds.append(int(lengths[j - 1]))
        j = int(chosen[k, j])
    return bounds[::-1]


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"{_WORD}+")).cast("long")


def sequences(docs: DataFrame, max_tokens: int = MAX_TOKENS, with_text: bool = True) -> DataFrame:
    """docs with piece (from 0), n_tokens and, with_text, the piece as its text; else without text."""
    docs = yielding(docs, "piece", "n_tokens")
    if with_text:
        # Possessive: a long text needs no stack.
        pieces = F.regexp_extract_all("text", F.lit(f"(?:{_SPACE}*+{_WORD}++){{1,{max_tokens}}}+(?:{_SPACE}++\\z)?+"), F.lit(0))
        pieces = F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.col("text")))
        cut = docs.select(*(c for c in docs.columns if c != "text"), F.posexplode(pieces).alias("piece", "text"))
        return cut.select(*docs.columns, F.col("piece").cast("long").alias("piece"), n_words(F.col("text")).alias("n_tokens"))
    (n,) = fresh(docs, "_n")
    counted = docs.withColumn(n, n_words(F.col("text"))).drop("text")
    last = F.greatest(F.ceil(F.col(n) / max_tokens) - 1, F.lit(0)).cast("long")
    cut = counted.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return cut.withColumn("n_tokens", F.least(F.lit(max_tokens), F.col(n) - F.col("piece") * max_tokens).cast("long")).drop(n)


def pack(docs: DataFrame, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET, with_text: bool = True) -> DataFrame:
    """The sequences of docs (doc_id, text) with bucket (its upper length), batch and slot.

    A batch is one of (bucket, batch); its sequences, padded to the bucket, are within budget
    unless one alone exceeds it.
    """
    docs = yielding(docs, *ADDED)
    spark, cols = docs.sparkSession, docs.columns if with_text else [c for c in docs.columns if c != "text"]
    n_slices, (u, part, place, start) = slices(spark), fresh(docs, "_u", "_slice", "_rank", "_before")

    def placed(found: DataFrame) -> DataFrame:
        order = uniform(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("piece").cast("string")), "pack")
        return found.withColumn(u, order).withColumn(part, F.floor(F.col(u) * n_slices).cast("int"))

    found = placed(sequences(docs, max_tokens, with_text))
    if with_text:  # texts are read again at the end; what is kept meanwhile is narrow
        lengths = written(placed(sequences(docs.select("doc_id", "text"), max_tokens, False)).select("n_tokens", part), "lengths")
    else:
        found = written(found, "sequences")
        lengths = found.select("n_tokens", part)
    histogram = {r["n_tokens"]: r["n"] for r in lengths.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    bounds = optimal_bounds(histogram, buckets)
    upper = F.element_at(F.filter(F.array(*(F.lit(b).cast("long") for b in bounds or [0])), lambda b: b >= F.col("n_tokens")), 1)

    counts = lengths.withColumn("bucket", upper).groupBy("bucket", part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("bucket", part, before.alias(start))
    rank = F.row_number().over(Window.partitionBy("bucket", part).orderBy(u, "doc_id", "piece")) - 1
    ranked = found.withColumn("bucket", upper).withColumn(place, rank).join(offsets, ["bucket", part])
    at, size = F.col(start) + F.col(place), F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket"))))
    return ranked.select(*cols, "piece", "n_tokens", "bucket", F.floor(at / size).cast("long").alias("batch"), (at % size).cast("long").alias("slot"))


def op2_length_buckets(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), with_text=False)


def _sql(buckets: int = BUCKETS, max_tokens: int = MAX_TOKENS, budget: int = BUDGET) -> str:
    """The same dynamic programme, a table for each number of buckets; for as many lengths at least."""
    levels = ["f1 AS (SELECT j, len * c - s AS cost, 0::BIGINT AS i FROM h WHERE j >= 1)"]
    for k in range(2, buckets + 1):
        cost = "p.cost + h.len * (h.c - q.c) - (h.s - q.s)"
        levels.append(f"f{k} AS (SELECT h.j, min({cost}) AS cost, min_by(p.j, ({cost}) * 100000 + p.j) AS i FROM h JOIN f{k - 1} p ON p.j < h.j JOIN h q ON q.j = p.j WHERE h.j >= {k} GROUP BY h.j)")
    backs = [f"b{buckets} AS (SELECT j, i FROM f{buckets} ORDER BY j DESC LIMIT 1)"]
    backs += [f"b{k} AS (SELECT f.j, f.i FROM f{k} f JOIN b{k + 1} b ON f.j = b.i)" for k in range(buckets - 1, 0, -1)]
    every = " UNION ALL ".join(f"SELECT j FROM b{k}" for k in range(1, buckets + 1))
    return rf"""
WITH w AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents),
p AS (SELECT doc_id, n, unnest(range(0, greatest(1, CAST(ceil(n / {max_tokens}.0) AS BIGINT)))) AS piece FROM w),
s AS (SELECT doc_id, piece::BIGINT AS piece, least({max_tokens}, n - piece * {max_tokens})::BIGINT AS n_tokens,
             ('0x' || substr(md5(concat_ws(':', 'pack', concat_ws(':', doc_id, piece))), 1, 8))::BIGINT AS u FROM p),
g AS (SELECT n_tokens AS len, count(*)::BIGINT AS n FROM s GROUP BY n_tokens),
h AS (SELECT row_number() OVER (ORDER BY len) AS j, len, (sum(n) OVER (ORDER BY len))::BIGINT AS c, (sum(n * len) OVER (ORDER BY len))::BIGINT AS s FROM g
      UNION ALL SELECT 0, 0, 0, 0),
{", ".join(levels)},
{", ".join(backs)},
bounds AS (SELECT h.len AS bucket FROM ({every}) x JOIN h ON h.j = x.j),
a AS (SELECT s.doc_id, s.piece, s.n_tokens, s.u, min(b.bucket)::BIGINT AS bucket FROM s JOIN bounds b ON b.bucket >= s.n_tokens GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY u, doc_id, piece) - 1 AS place, greatest(1, {budget} // greatest(1, bucket)) AS size FROM a)
SELECT doc_id, piece, n_tokens, bucket, (place // size)::BIGINT AS batch, (place % size)::BIGINT AS slot FROM r
"""


OP2_SQL = _sql()
