"""Fill-in-middle, the prefix trie and the exact search against plain versions of themselves."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import fim, mtree, prefix_trie

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- fill-in-middle ----------------------------------------------------------------------------


def plain_fim(key, text):
    text = text or ""
    units, digest = TOKEN.findall(text), sha(f"42:{'' if key is None else key}")
    n, (h1, h2, h3, h4) = len(units), (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_token_ends_and_ranked_bits():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "bc", " ", "\n", "\t\x0b", "é", "🔥", " ", "\x1c", "<", "S>"]) for _ in range(rng.randint(0, 14)))
        ends = fim.token_ends(text.encode())
        units = [u.encode() for u in TOKEN.findall(text)]
        places = [sum(map(len, units[: k + 1])) - 1 for k in range(len(units))]
        assert ends.bit_count() == len(units) and [fim.ranked_bit(ends, k + 1) for k in range(len(units))] == places, text


def test_fill_in_middle_against_a_list_of_tokens(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["ab", "c", " ", "  ", "\n", "é", "🔥", "<", "S>", "x<S"]) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    texts += [None, "", " \n", "one", "has <M> in it", "<P>", "word " * 300_000, "x" * 500_000, "  \x85"]
    rows = [(k, t, f"own {k}") for k, t in enumerate(texts)] + [(7, "same key", "a"), (7, "same key", "a"), (None, "no key at all", "b")]
    made = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string, key string"))
    assert made.columns == ["doc_id", "text", "key", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(str, ((r["doc_id"], r["key"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got))) == sorted(map(str, ((k, o, *plain_fim(k, t)) for k, t, o in rows)))
    assert all(r["again"] == (r["text"] or "") for r in got)
    assert {"plain", "psm", "spm"} == {r["form"] for r in got}


def test_fill_in_middle_parameters(spark):
    docs = spark.createDataFrame([(k, f"one two {k} three", k) for k in range(300)], "id long, body string, n long")
    marks = fim.Sentinels("[pre]", "[suf]", "[mid]")
    made = fim.fill_in_middle(docs, "body", "id", fim=100, spm=0, seed="other", sentinels=marks)
    got = made.withColumn("again", fim.restored(F.col("output"), F.col("form"), marks)).collect()
    assert made.columns == ["id", "body", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert {r["form"] for r in got} == {"psm"} and all(r["again"] == r["body"] and r["output"].startswith("[pre]") for r in got)
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", ">x", "<M>"), ("a<S>b", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.Sentinels(*bad)
    assert fim.fill_in_middle(docs.limit(0), "body", "id").count() == 0


# ---- prefix trie -------------------------------------------------------------------------------


def plain_trie(convs):
    """Nodes of {conv_id: [(role, text)]} by walking every prefix."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        children = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[:-1] == k for x in below)]
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ended = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(key))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(children), len(leaves), saved, sha(ended)))
    return sorted(out, key=str)


def plain_splice(rows):
    own = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :] for c in own}


TURNS = "conv_id long, turn long, role string, text string"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes_of(df):
    return sorted((tuple(r[c] for c in NODE) for r in df.select(*NODE).collect()), key=str)


def some_turns(seed, n):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None])))
    return [r for r in rows if r[0] not in (5, 11)] + [(77_000_000_000, None, "user", "a"), (77_000_000_000, 0, "user", "é")]


def test_trie_of_given_conversations(spark):
    rows = some_turns(3, 60)
    convs = {}
    for c, _, role, text in rows:
        convs.setdefault(c, []).append((role or "", text or ""))
    turnless = {5: [], 11: []}
    steps = prefix_trie.steps_of(spark.createDataFrame(rows, TURNS).withColumn("node", F.lit("own")))
    assert nodes_of(prefix_trie.prefix_trie(steps)) == plain_trie(convs)
    members = spark.createDataFrame([(5,), (11,), (11,), (None,)], "conv_id long")
    assert nodes_of(prefix_trie.prefix_trie(steps, members)) == plain_trie(convs | turnless)


def test_spliced_conversations(spark):
    rows = some_turns(4, 80)
    steps = prefix_trie.steps_of(spark.createDataFrame([*rows, (None, 0, "user", "no id")], TURNS))
    got = prefix_trie.prefix_trie(prefix_trie.spliced(steps), steps.select("conv_id"))
    assert nodes_of(got) == plain_trie(plain_splice(rows))


def test_trie_hot_nodes_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN_BITS", 2)
    convs = {c: [("user", "same")] * (1 + c % 3) + ([("user", str(c))] if c % 7 == 0 else []) for c in range(200)}
    rows = [(c, 0, *t) for c, turns in convs.items() for t in turns[:-1]] + [(c, 1, *turns[-1]) for c, turns in convs.items()]
    df = spark.createDataFrame(rows, TURNS)
    assert nodes_of(prefix_trie.prefix_trie(prefix_trie.steps_of(df))) == plain_trie(convs)
    # Rows of one number go by content: in whichever order they come, the trie is the same.
    tied = [(c, 0, "user", x) for c in (1, 2) for x in ("a", "b", "b")]
    trie = lambda rs: nodes_of(prefix_trie.prefix_trie(prefix_trie.steps_of(spark.createDataFrame(rs, TURNS))))
    assert trie(tied) == trie(tied[::-1]) and len(trie(tied)) == 4
    assert trie([]) == []
    long = [(1, t, "user", "x" * 100_000 if t == 900 else str(t)) for t in range(1000)]
    assert [n[:2] for n in sorted(trie(long), key=lambda n: n[1])] == [(1, d) for d in range(1001)]


def test_trie_weights(spark):
    df = spark.createDataFrame([(1, 0, "user", "a b c"), (2, 0, "user", "a b c")], TURNS)
    words = F.size(F.split("text", " "))
    assert max(r["saved_tokens"] for r in prefix_trie.prefix_trie(prefix_trie.steps_of(df, words)).collect()) == 3


def test_trie_reads_texts_once_and_never_deals_them(spark, monkeypatch):
    """side by side, scans of the texts held several row groups of them in an executor."""
    plans, key, write = [], "spark.sql.parquet.columnarReaderBatchSize", prefix_trie.written

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString(), int(spark.conf.get(key))))
        return write(df, name)

    monkeypatch.setattr(prefix_trie, "written", seen)
    before = spark.conf.get(key)
    out = prefix_trie.op12_prefix_trie(spark, "/root/testdata/sf0.001")
    plans.append(("out", out._jdf.queryExecution().executedPlan().toString(), 0))
    reads = [(name, rows) for name, plan, rows in plans for schema in re.findall(r"ReadSchema: struct<.*", plan) if "text:" in schema]
    assert reads == [("placed", prefix_trie.READ_ROWS)] and spark.conf.get(key) == before
    assert not any("RoundRobinPartitioning" in plan for _, plan, _ in plans)


# ---- exact search ------------------------------------------------------------------------------


def plain_search(rows, k):
    """rows: (vec_id, list or None)."""
    units = []
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            units.append((i, [int(np.floor(256 * np.float64(x))) for x in v]))
    out = []
    for a, (i, q) in enumerate(units):
        if i is not None and i % 50 == 0:
            scored = [(-sum(x * y for x, y in zip(q, v, strict=True)), mtree.NO_ID if j is None else j) for b, (j, v) in enumerate(units) if a != b and len(v) == len(q)]
            out += [(i, r + 1, None if j == mtree.NO_ID else j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def search(spark, rows, k=5, kind="float"):
    units = mtree.quantised(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, score string"))
    return sorted((tuple(r) for r in mtree.top_k(units, F.col("id") % 50 == 0, k).select("query_id", "rank", "vec_id", "score").collect()), key=str)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_a_tree_is_exact_and_its_bounds_hold(spread):
    rng = np.random.default_rng(7)
    x = np.floor(256 * (rng.normal(size=(40, 16)).repeat(50, 0) + spread * rng.normal(size=(2000, 16)))).astype(np.int64)
    pages = mtree.grown(x, [[i] for i in range(len(x))], np.zeros(16), page_rows=32, fanout=8)
    for p in pages:
        if p.child is not None:
            for route, radius, most, child in zip(p.floats, p.radius, p.square, p.child, strict=True):
                below, todo = [], [child]
                while todo:
                    page = pages[todo.pop()]
                    below += [page.floats] if page.child is None else []
                    todo += [] if page.child is None else list(page.child)
                below = np.concatenate(below)
                assert (np.linalg.norm(below - route, axis=1) <= radius + 1e-6).all() and (below**2).sum(1).max() == most
                assert np.allclose(pages[child].to_parent, np.linalg.norm(pages[child].floats - route, axis=1))
    computed = 0
    for i in range(0, 2000, 50):
        got, n = mtree.best_first(pages, x[i], i, 5, np.zeros(16))
        want = sorted((-int(s), j) for j, s in enumerate(x @ x[i]) if j != i)[:5]
        assert got == [(-s, j) for s, j in want]
        assert mtree.best_first(pages, x[i], i, 5, np.zeros(16), bound=got[-1][0])[0] == got
        computed += n
    assert computed / 40 < (500 if spread < 1 else 2100)


def test_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE_ROWS", 64)
    monkeypatch.setattr(mtree, "QUERY_ROWS", 2)
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=8) / 3 if i % 3 else np.ones(8) * (i % 5)).tolist(), "x") for i in range(600)]
    rows += [(50, rows[50][1], "again"), (50, [0.5] * 8, "other vector"), (700, [0.25, 0.5], "short"), (701, [0.1, 0.2], "short"), (702, [0.1, 0.2], "short")]
    rows += [(None, [3.0] * 8, "no id"), (750, None, ""), (800, [1.0, None] * 4, ""), (850, [float("nan")] * 8, ""), (900, [float("inf")] * 8, ""), (950, [], ""), (951, [], ""), (1000, [0.0] * 8, "zero"), (1050, [0.001] * 9, "alone")]
    assert search(spark, rows, kind="double") == plain_search([r[:2] for r in rows], 5)


def test_search_small_hot_and_large(spark):
    few = [(0, [1.0, 2.0], ""), (1, [1.0, 2.0], ""), (2, [-1.0, 0.5], "")]
    assert search(spark, few) == plain_search([r[:2] for r in few], 5)
    assert search(spark, []) == [] == search(spark, [(0, [1.0], "")])
    hot = [(i, [0.3, 0.4], "") for i in range(400)] + [(i, [0.3, 0.1 * (i % 9)], "") for i in range(400, 500)]
    assert search(spark, hot, 3) == plain_search([r[:2] for r in hot], 3)
    wide = [(i, [float(1 << 21) * s, 77777.125 + i], "") for i, s in ((0, 1), (1, -1), (2, 1), (50, 0.5))] + [(3, [1e300, 0.0], "")]
    assert search(spark, wide, kind="double") == plain_search([r[:2] for r in wide[:4]], 5)
