"""Functions in Python work on slices of a batch, so their memory does not grow with it; results stay those of the JVM."""

import pyarrow as pa
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import matching, privacy
from loomspan.operators.rules import DEMO_PACK, DEMO_RULES, usable


def _rows(function, texts, *more):
    out = list(function.func(iter([pa.array(texts)])))
    assert len(out) > 1 and max(map(len, out)) <= T.SLICE
    return [x for part in out for x in part.to_pylist()]


def test_batches_are_taken_in_slices(spark):
    texts = ["a​ Ｂ", None, "und this is free, and this."] * 400
    assert _rows(T.squeezed_nfkc, texts)[:3] == ["a b", None, "und this is free, and this."]
    assert [r and r["plain"] for r in _rows(T.normal_forms, texts)][:3] == ["a b", None, "und this is free, and this."]
    seen = {}
    # What the decorated function is, before it becomes a column.
    arrow_udf, F.arrow_udf = F.arrow_udf, lambda kind: lambda f: seen.setdefault("f", f)
    try:
        matching.combining(usable(DEMO_RULES), DEMO_PACK)
    finally:
        F.arrow_udf = arrow_udf
    found = list(seen["f"](iter([pa.array(texts)])))
    assert len(found) > 1 and max(map(len, found)) <= T.SLICE and sum(map(len, found)) == len(texts)


def test_forms_are_those_of_the_jvm(spark):
    texts = ["", " ", "A  b\t c\n\n d ", " x  y　", "a ​ b⁠", "\x1cA \x1f b\x85 \x0b", "Ünder İx", "ΑΣ ΑΣΑ", "a\x03b", "  lead, trail \x0c", "Пример  ТЕКСТА"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", "t", T.levelled(F.col("t")).alias("l"), T.squeezed(F.col("t")).alias("s"), T.unstable(F.col("t")).isNull().alias("stable")).collect()
    for r in rows:
        levelled, starts, _, plain = T.forms_of(r["t"])
        assert plain == r["s"], r["t"]
        if r["stable"]:
            assert levelled == r["l"] and starts is None, r["t"]
        else:
            assert starts is not None


def test_places_and_bare_amounts_of_changed_texts(spark):
    """Places of a text that NFKC changes are the given text's; a bare amount keeps its rules away from both kinds."""
    rows = [(1, "①x and this."), (2, "and this."), (3, "and this, que 12."), (4, "①x and this, que 12."), (5, "and this, que 12, free.")]
    got = matching.find_matches(spark.createDataFrame(rows, "k int, text string"), DEMO_RULES, DEMO_PACK).select("k", F.explode("matches").alias("m")).where("m.rule_id = 'risk_and_this'").select("k", "m.t_start", "m.t_end", "m.c_start", "m.c_end").collect()
    assert sorted(map(tuple, got)) == [(1, 3, 6, 7, 11), (2, 0, 3, 4, 8), (5, 0, 3, 4, 8)]


def test_quotes_are_resolved_in_slices(spark):
    texts, quotes = pa.array(["ab a", None, "b"] * 300), pa.array([["a", "b"], ["a"], None] * 300)
    out = list(privacy.resolved_quotes.func(iter([(texts, quotes)])))
    assert len(out) > 1 and max(map(len, out)) <= T.SLICE
    assert [x for part in out for x in part.to_pylist()][:3] == [[{"start": 0, "end": 1}, {"start": 1, "end": 2}], None, None]
