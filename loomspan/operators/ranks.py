"""Places in an order over all rows: numbers, exact percentiles and first rows, without one task that sees all.

Each works in two steps: where in the order a place lies, from counts or sketches that merge; and the
exact answer among the few rows there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A percentile's sketch is off by one in so many ranks at most.
ACCURACY = 10_000
#: Rows that cuts of an order are taken from, and cuts at most.
SAMPLE_ROWS, MAX_CUTS = 20_000, 1024
#: A hot group is looked through in so many slices.
SLICES = 256


def nearest_rank(frame: DataFrame, value: str, share: float, *by: str) -> DataFrame:
    """(by, at_rank, n): the value at place ceil(n * share) of the sorted values, by group; 0 for none. Nulls are no values.

    A sketch gives two values between which the place lies. Then each group's values are counted by
    value between these two, and as one below: what meets in a task is the different values there, about
    one in 2,500 of a group's.
    """
    group = F.struct(*by) if by else F.lit(0)
    rows = frame.where(F.col(value).isNotNull()).select(group.alias("_g"), F.col(value).cast("double").alias("_v"))
    sides = F.array(F.lit(max(0.0, share - 2 / ACCURACY)), F.lit(min(1.0, share + 2 / ACCURACY)))
    sketch = rows.groupBy("_g").agg(F.count("*").alias("_n"), F.percentile_approx("_v", sides, ACCURACY).alias("_s"))
    near = rows.join(sketch.withColumnRenamed("_g", "_h"), F.col("_g").eqNullSafe(F.col("_h"))).where(F.col("_v") <= F.col("_s")[1])
    below = F.when(F.col("_v") >= F.col("_s")[0], F.col("_v"))
    counted = near.groupBy("_g", below.alias("_v")).agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    upwards = Window.partitionBy("_g").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.greatest(F.ceil(F.col("_n") * F.lit(float(share))), F.lit(1))
    placed = counted.withColumn("_to", F.sum("_c").over(upwards)).where((F.col("_to") >= place) & (F.col("_to") - F.col("_c") < place))
    missed = F.raise_error(F.lit("a sketch was further off than it may be")).cast("double")
    found = placed.select(F.col("_g").alias("_h"), F.coalesce("_v", missed).alias("_at"))
    totals = frame.groupBy(*by).agg(F.count(value).alias("n")).withColumn("_g", group)
    out = totals.join(found, F.col("_g").eqNullSafe(F.col("_h")), "left")
    checked = F.when((F.col("n") > 0) & F.col("_at").isNull(), missed).otherwise(F.coalesce("_at", F.lit(0.0)))
    return out.select(*by, checked.alias("at_rank"), "n")


def cuts(frame: DataFrame, order: str, most: int = MAX_CUTS) -> list:
    """Values that cut the order into parts of about one size, from a bounded sample."""
    values = frame.where(F.col(order).isNotNull()).select(order)
    n = values.count()
    if not n:
        return []
    share = min(1.0, SAMPLE_ROWS / n)
    mine = values.where(F.pmod(F.xxhash64(order), F.lit(1 << 30)) <= int(share * (1 << 30)))
    found = sorted(r[0] for r in mine.limit(2 * SAMPLE_ROWS).collect())
    parts = min(most, frame.sparkSession.sparkContext.defaultParallelism * 4, len(found))
    return sorted({found[len(found) * k // parts] for k in range(1, parts)})


def numbered(frame: DataFrame, order: str, name: str = "number") -> DataFrame:
    """frame with the place of each row in the order, from 1, nulls first: each part's rows are numbered from the counts of the parts before it."""
    bounds = cuts(frame, order)
    kind = frame.schema[order].dataType
    ends = F.array(*(F.lit(b) for b in bounds)).cast(f"array<{kind.simpleString()}>")
    part = F.coalesce(F.aggregate(ends, F.lit(0), lambda k, b: k + (F.col(order) >= b).cast("int")), F.lit(0))
    rows = frame.withColumn("_part", part)
    counts = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before = [sum(n for p, n in counts.items() if p < k) for k in range(len(bounds) + 1)]
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(order).asc_nulls_first()))
    return rows.withColumn(name, own + F.array(*(F.lit(b) for b in before)).cast("array<bigint>")[F.col("_part")]).drop("_part")


def first_rows(frame: DataFrame, by: list[str], order: list[Column], most: Column) -> DataFrame:
    """frame with _rank, the rows of each group up to ``most`` (a column that the group's rows agree in).

    Each slice of a group keeps its first rows, and these alone meet.
    """
    sliced = Window.partitionBy(*by, F.pmod(F.xxhash64(*order), F.lit(SLICES))).orderBy(*order)
    some = frame.withColumn("_rank", F.row_number().over(sliced)).where(F.col("_rank") <= most)
    return some.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= most)
