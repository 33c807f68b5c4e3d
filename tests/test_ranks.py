"""Places in an order and bounded samples against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import evaluate, ranks


def test_nearest_rank_is_exact(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ACCURACY", 50)  # a rough sketch: the counts have to do the work
    rng = random.Random(3)
    rows = [("many", float(int(rng.gauss(0, 900)))) for _ in range(6000)] + [("ties", 5.0)] * 700 + [("ties", 4.0)] * 37 + [("one", -1.5), (None, 2.0), (None, 3.0), ("nulls", None), ("many", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(7)
    for share in (0.0, 0.01, 0.5, 0.95, 1.0):
        got = {r["g"]: (r["at_rank"], r["n"]) for r in ranks.nearest_rank(frame, "v", share, "g").collect()}
        for g in {r[0] for r in rows}:
            values = sorted(v for x, v in rows if x == g and v is not None)
            assert got[g] == ((values[max(1, math.ceil(len(values) * share)) - 1] if values else 0.0), len(values)), (g, share)
        values = sorted(v for _, v in rows if v is not None)
        assert ranks.nearest_rank(frame, "v", share).first()["at_rank"] == values[max(1, math.ceil(len(values) * share)) - 1]
    assert ranks.nearest_rank(frame.limit(0), "v", 0.95).collect()[0][:] == (0.0, 0) and ranks.nearest_rank(frame.limit(0), "v", 0.95, "g").count() == 0


def test_numbers_over_all_rows(spark):
    rng = random.Random(4)
    for values, kind in (([rng.randint(0, 10**9) for _ in range(3000)] + [None, None], "long"), ([f"k{rng.randint(0, 10**6)}" for _ in range(900)], "string"), ([7] * 50 + [8], "long"), ([], "long"), ([None], "long")):
        got = ranks.numbered(spark.createDataFrame([(v,) for v in values], f"o {kind}").repartition(5), "o").collect()
        assert sorted(r["number"] for r in got) == list(range(1, len(values) + 1))
        placed = [r["o"] for r in sorted(got, key=lambda r: r["number"])]
        assert placed == sorted(values, key=lambda v: (v is not None, v if v is not None else 0))


def greedy(rows, sizes):
    taken, out = set(), []
    for stratum in sorted({r[1] for r in rows}, key=lambda s: (s is not None, s or "")):
        k = 0
        for i, s, text in sorted((r for r in rows if r[1] == stratum), key=lambda r: r[0]):
            size = sizes if isinstance(sizes, int) else sizes.get(s, 0)
            if (text or "") not in taken and k < size:
                taken.add(text or "")
                k += 1
                out.append((s, k, i))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [3, 40, {"s1": 2, "s2": 5, "s30": 9}])
def test_one_pass_sample_is_the_greedy_choice(spark, sizes):
    rng = random.Random(6)
    rows = [(k, f"s{rng.randint(0, 39)}" if k % 50 else None, rng.choice([f"t{rng.randint(0, 60)}", f"own {k}", None])) for k in range(2500)]
    got = evaluate.stratified(spark.createDataFrame(rows, "id long, stratum string, text string").repartition(6), ["stratum"], "id", sizes).collect()
    assert sorted(((r["stratum"], r["rank"], r["id"]) for r in got), key=str) == greedy(rows, sizes)


def test_hundreds_of_strata(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") % 700).alias("stratum"), F.concat(F.lit("t"), F.col("id") % 900).alias("text"))
    got = evaluate.stratified(rows, ["stratum"], "id", 2).collect()
    assert sorted(((r["stratum"], r["rank"], r["id"]) for r in got), key=str) == sorted(((s, k, i) for s, k, i in greedy([(r["id"], f"{r['stratum']:03}", r["text"]) for r in rows.collect()], 2) for s in [int(s)]), key=str)
