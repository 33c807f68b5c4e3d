"""Connected components by repeated contraction, with every step a join or an aggregate.

In each round every vertex takes the least of itself and its neighbours as representative,
edges are mapped to representatives, and loops and repeats go. The order is by id in the
first round, which ends stars at their least member, and by a fresh hash in the others,
which shortens long chains by a constant factor (Bögeholz, Brand, Todor: In-database
connected component analysis, 2019). Rounds are written to the shared folder. A hub costs
its aggregate one partial row a task, and joins on it can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import discard, written

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (src, dst); component is the least id reached.

    Loops, repeats and nulls among the edges do not matter; without edges there are no rows.
    """
    now = written(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a < b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not now.isEmpty():
        if len(rounds) == MAX_ROUNDS:
            raise RuntimeError("components did not settle")
        rank = (lambda c: F.col(c)) if not rounds else (lambda c, k=len(rounds): F.xxhash64(F.col(c), F.lit(k)))
        both = now.select(F.col("a").alias("id"), F.col("b").alias("other")).unionAll(now.select(F.col("b").alias("id"), F.col("a").alias("other")))
        best = both.groupBy("id").agg(F.min(F.struct(rank("other").alias("h"), F.col("other").alias("v"))).alias("m"))
        chosen = written(best.select("id", F.when(F.col("m.h") < rank("id"), F.col("m.v")).otherwise(F.col("id")).alias("rep")), "reps")
        rounds.append(chosen)
        mapped = now.join(chosen.select(F.col("id").alias("a"), F.col("rep").alias("ra")), "a").join(chosen.select(F.col("id").alias("b"), F.col("rep").alias("rb")), "b")
        before, now = now, written(mapped.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a < b").distinct(), "edges")
        discard(before)
    if not rounds:
        return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = rounds[-1]
    for earlier in rounds[-2::-1]:
        later = roots.select(F.col("id").alias("rep"), F.col("rep").alias("root"))
        roots = earlier.join(later, "rep", "left").select("id", F.coalesce("root", "rep").alias("rep"))
    roots = written(roots, "roots")
    least = roots.groupBy("rep").agg(F.min("id").alias("component"))
    return roots.join(least, "rep").select("id", "component")
