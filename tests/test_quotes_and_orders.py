"""Places of quotes against whole products, counters of a run, orders of strings."""

import itertools
import random
import time

from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import interpreter, privacy


def product_of_places(text, quotes):
    places = [[(k, k + len(q)) for k in range(len(text)) if q and text.startswith(q, k)] for q in quotes]
    scored = []
    for choice in itertools.product(*places):
        spans = sorted(choice)
        if all(a[1] <= b[0] for a, b in itertools.pairwise(spans)):
            gaps = sum(max(b[0] - a[1], a[0] - b[1], 0) for a, b in itertools.combinations(choice, 2))
            scored.append(((gaps, spans[-1][1] - spans[0][0]), list(choice)))
    best = min((s for s, _ in scored), default=None)
    found = [c for s, c in scored if s == best]
    return found[0] if len(found) == 1 and len(quotes) <= 5 else None


def test_places_are_the_best_of_the_product():
    rng, some = random.Random(3), 0
    for _ in range(3000):
        text = "".join(rng.choice("abc .") for _ in range(rng.randint(0, 16)))
        quotes = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 5))]
        want = product_of_places(text, quotes)
        assert privacy.resolve_quotes(text, quotes) == want, (text, quotes)
        some += want is not None
    assert some > 100 and privacy.resolve_quotes("a", [""]) is None and privacy.resolve_quotes("abcdef", list("abcdef")) is None


def test_thousands_of_places():
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    text = " ".join(words[::-1] * 2000) + " " + "alpha;beta;gamma;delta;epsilon"
    began = time.perf_counter()
    got = privacy.resolve_quotes(text, words)
    assert time.perf_counter() - began < 20
    # Each round has them as near, so which one is meant is not clear.
    assert got is None
    text = "  ".join(words[::-1] * 2000) + "  " + " ".join(words) + "  " + "  ".join(words * 500)
    at = text.index(" ".join(words))
    assert privacy.resolve_quotes(text, words)[0] == (at, at + 5)


def test_counters_go_along_with_the_write(spark, tmp_path):
    def complete(text):
        if text == "refused":
            raise interpreter.ResourceExhausted()
        return "nonsense"

    texts = spark.createDataFrame([(1, "fine"), (2, "refused"), (3, "other"), (4, None)], "id int, text string")
    rows, seen = interpreter.counted(interpreter.by_provider(complete)(texts))
    rows.write.parquet(str(tmp_path / "runs"))
    assert seen.get == {"runs": 4, "ok": 0, "calls": 4, "refusals": 1, "timeouts": 0}
    rows, seen = interpreter.counted(interpreter.by_provider(complete)(texts.limit(0)))
    rows.write.parquet(str(tmp_path / "none"))
    assert seen.get["calls"] == 0


def test_orders_of_strings(spark):
    names = ["b", "\U0001f600", "\uff01", "\ue000", "a\U0001f600", "a", "é", "e", "E", "z", ""]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r["n"] for r in frame.orderBy(T.utf16_key(F.col("n"))).collect()] == sorted(names, key=lambda n: n.encode("utf-16-be"))
    assert [r["n"] for r in frame.where("n RLIKE '^[a-zE\u00e9]$'").orderBy(T.locale_key(F.col("n"))).collect()] == ["a", "b", "e", "E", "é", "z"]
