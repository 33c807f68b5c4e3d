"""Nulls, ties, repeats, long texts, empty tables and clashing names; brute force where SQL has no form."""

import base64
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import chat, embed_dedup, html_text, langid, materialise, mixing, ngram_join, packing, pii, quality
from loomspan.llm.common import discard, written

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("piece", "bucket", "p", "kept", "_tokens", "_words", "n_words", "words", "score", "spans", "n_shingles", "component_id", "rep", "grp", "name", "_row", "_u", "_n", "lang_pred")


def some(spark, n=40, seed=5):
    rng = random.Random(seed)
    words = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(k))
    rows = [(k, words(rng.randint(1, 60)), "aa", f"s{k % 3}", 1) for k in range(n)] + [(900, None, None, None, None), (901, "", None, "s1", 0), (902, " \t", "aa", None, 2), (None, "no id at all", "aa", "s0", 1)]
    return spark.createDataFrame(rows, DOCS)


def clashing(docs):
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


# ---- columns of the input may bear any name ----------------------------------------------------


def test_own_columns_are_carried(spark):
    docs = some(spark)
    wide = clashing(docs)
    for keep in (quality.keep_good, mixing.mix, ngram_join.drop_near_copies, pii.mask_pii):
        plain, got = keep(docs).collect(), keep(wide).collect()
        assert sorted(map(str, ([r[c] for c in docs.columns] for r in got))) == sorted(map(str, (list(r) for r in plain))), keep
        assert all(r[c] == f"own {c}" for r in got for c in CLASHES), keep
    for add in (packing.pack, mixing.calibrated):
        plain, got = add(docs), add(wide)
        assert len(set(got.columns)) == len(got.columns) and sorted(map(str, got.select(plain.columns).collect())) == sorted(map(str, plain.collect())), add
        assert {"_row", "spans"} <= set(got.columns)
    for take in (pii.find_pii, ngram_join.near_groups, langid.identify):
        assert sorted(map(str, take(docs).collect())) == sorted(map(str, take(wide).collect())), take
    assert langid.identify(wide, keep=tuple(wide.columns)).columns[-2:] == ["lang_pred", "score"]


def test_tables_are_discarded(spark):
    import os

    one = written(spark.range(3).toDF("x"), "gone")
    path = one.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    discard(one)
    assert not os.path.exists(path)


# ---- op1 ---------------------------------------------------------------------------------------

LITERAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_base_spans_are_the_literal_patterns():
    rng, pieces = random.Random(11), ["1", "22", ".", "@", "-", " ", "+", "(", ")", "a", "b.c", "4111 1111 1111 1111", "4111111111111112", "10.0.0.1", "300.", "x@y.z", "é", "\n", "+1 555", "007"]
    for _ in range(4000):
        text, want = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))), []
        for kind, rx in LITERAL.items():
            for m in re.finditer(rx, text):
                digits = re.sub("[^0-9]", "", m[0])
                fits = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
                want += [(kind, m.start(), m.end())] * fits
        assert pii.base_spans(text) == want, text


def test_decoding_is_the_best_of_all_segmentations():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 7)
        spans = sorted((i, j, rng.randrange(5), rng.uniform(0.1, 3)) for i in range(n) for j in range(i + 1, n + 1) if rng.random() < 0.4)

        def best(at):
            return max([0.0] + [best(at + 1)] + [s + best(j) for i, j, _, s in spans if i == at]) if at < n else 0.0

        got = list(pii._decoded(iter(spans)))
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))
        assert abs(sum(max(s for i, j, k, s in spans if (i, j, k) == x) for x in got) - best(0)) < 1e-9


def test_held_out_precision_and_recall():
    weights, hits = pii.fit(), {k: [0, 0, 0] for k in pii.KINDS}
    for text, spans in pii.examples(1500, seed=99):
        got, gold = set(pii.find_spans(text, weights)[1]), set(spans)
        for kind, at, _ in got | gold:
            hits[kind][0 if (x := next(s for s in got | gold if s[0] == kind and s[1] == at)) in got & gold else 1 if x in got else 2] += 1
    for kind, (right, extra, missed) in hits.items():
        assert right >= 0.95 * (right + extra) and right >= 0.97 * (right + missed), (kind, right, extra, missed)
    assert pii.find_spans("my card 4111111111111112", weights)[1] == [] != pii.find_spans("my card 4111111111111111", weights)[1]


def test_long_texts_and_repeats_of_personal_data(spark):
    weights, word = pii.fit(), "10 " * 20000
    text = word + "mail ann@example.org " + "words here " * 20000 + "password=Ab3kd9fz " + "\n" * 5 + word
    got = [text[a:b] for _, a, b in pii.find_spans(text, weights)[1]]
    assert got == ["ann@example.org", "Ab3kd9fz"]
    rows = pii.find_pii(spark.createDataFrame([(1, text, 9), (1, text, 9), (None, "x@y.zz", 9), (2, None, 9)], "doc_id long, text string, n_email int")).collect()
    assert sorted((r["doc_id"] or 0, r["n_email"]) for r in rows) == [(0, 1), (1, 1), (1, 1), (2, 0)]
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- op2, op4 ----------------------------------------------------------------------------------


def test_packing_ties_and_repeats(spark):
    docs = spark.createDataFrame([(7, "a b c")] * 5 + [(None, "d e")] * 3, "doc_id long, text string")
    rows = packing.pack(docs, max_tokens=2, buckets=2, budget=4).collect()
    assert sorted(r["text"].strip() for r in rows) == sorted(["a b", "c"] * 5 + ["d e"] * 3)
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in rows}) == len(rows)


def test_many_cells_go_the_other_way(spark, monkeypatch):
    docs = some(spark)
    one = sorted(map(str, mixing.calibrated(docs).select("doc_id", F.round("p", 9), "kept").collect()))
    monkeypatch.setattr(mixing, "MAX_ONE_TASK", 1)
    assert sorted(map(str, mixing.calibrated(docs).select("doc_id", F.round("p", 9), "kept").collect())) == one


# ---- op3 ---------------------------------------------------------------------------------------


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    repeated = len({i + d for i, w in enumerate(windows) if seen[w] > 1 for d in range(8)})
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeated


def test_counts_and_order(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["aa", "b", "c#", "d!", "é", "🔥x", "aa aa", "\n", "\n \n", "x y z w v u t s"])
    texts = [None, "", " \n\t", "a " * 3000, *(" ".join(word() for _ in range(rng.randint(1, 90))) for _ in range(120))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {}
    for order in (list(quality.RULES), list(quality.RULES)[::-1], [quality.RULES[k] for k in (3, 1, 5, 0, 4, 2)]):
        rows = {r["doc_id"]: r.asDict() for r in quality.judged(docs, order).collect()}
        assert not got or rows == got
        got = rows
        kept = {r["doc_id"] for r in docs.where(quality.verdict(order)).collect()}
        assert kept == {d for d, r in rows.items() if r["kept"]}
    for doc, text in enumerate(texts):
        r, want = got[doc], brute_quality(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, (doc, text)
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (not r["base_failed"] or not r["kept"])
    order = quality.report(docs).collect()
    assert sorted(r["rule"] for r in order) == sorted(r.name for r in quality.RULES) and all(r["microseconds"] > 0 for r in order)
    assert quality.keep_good(docs.unionAll(docs)).count() == 2 * sum(r["kept"] for r in got.values())


# ---- op5 ---------------------------------------------------------------------------------------


def components(n, links):
    up = list(range(n))
    for a, b in links:
        x, y = sorted((up[a], up[b]))
        up = [x if u == y else u for u in up]
    return up


def test_grid_of_many_cells(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CELL_ROWS", 8)  # some hundred cells for a few thousand vectors
    rng = np.random.default_rng(7)
    base = rng.normal(size=(1500, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.normal(size=base.shape)
    aside -= (aside * base).sum(1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cos = rng.uniform(0.951, 0.97, (1500, 1))
    x = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * aside, base[:40]])
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(6)
    reps = written(frame.select(F.col("vec_id").alias("id"), "embedding").mapInArrow(embed_dedup._stored, "id long, raw binary, len int"), "t")
    one, two, _ = embed_dedup._fit(reps, 0.95, 0.99)[24]
    assert len(one) * len(two) > 300
    got = {r["vec_id"]: r for r in embed_dedup.link_vectors(frame).collect()}
    hits = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    found = np.array([got[k]["n_links"] for k in range(len(x))])
    assert (found <= hits.sum(1)).all() and found.sum() >= 0.97 * hits.sum() and found.sum() % 2 == 0
    up = components(len(x), np.argwhere(np.triu(hits)).tolist())
    assert np.mean([got[k]["component_id"] == up[k] for k in range(len(x))]) >= 0.97
    assert all(got[k]["kept"] == (got[k]["component_id"] == k) for k in got)


def test_vectors_of_many_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(1)
    rows = []
    for length in range(1, 25):
        v = rng.normal(size=length)
        rows += [(100 * length, v.tolist()), (100 * length + 1, (2 * v).tolist()), (100 * length + 2, (-v).tolist())]
    rows += [(7, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [0.0, 1.0]), (9, [1.0, 0.0]), (None, [1.0, 0.0])]
    got = {}
    for r in embed_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["vec_id"], []).append(r)
    for length in range(1, 25):
        assert all(got[100 * length + d][0]["component_id"] == 100 * length for d in (0, 1)) and got[100 * length + 2][0]["component_id"] == 100 * length + 2
    assert {r["component_id"] for k in (7, 8, 9) for r in got[k]} == {7} and got[None][0]["n_links"] == 0 and len(got[7]) == 2
    assert embed_dedup.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---- op6, op7 ----------------------------------------------------------------------------------


def test_only_the_most_frequent_languages_are_learned(spark):
    rows = [(k, "abc abd abe " * 5 if k % 3 else "xyz xyw xyv " * 5, "aa" if k % 3 else "xx", "s", 1) for k in range(90)] + [(99, "xyz " * 90000, None, "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    assert langid.learn(docs, max_langs=1)[0] == ["aa"] and langid.learn(docs)[0] == ["aa", "xx"]
    assert {r["lang_pred"] for r in langid.identify(docs).where("doc_id = 99").collect()} == {"xx"}


def test_pages_through_spark(spark):
    deep = "<body>" + "<div>t</q>" * 20000 + "</div>" * 50
    raw = "<body>" + "İ" * 300 + "<script>var x = 1;</SCRIPT><p>What stands behind the script is read whole.</p></body>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", deep, "x"), (4, "u", raw, "x"), (4, "u", raw, "x"), (None, "u", "<p>One &amp; two</p>", "x"), (5, "u", "<p>" + "long text. " * 90000 + "</p>", "x")]
    out = html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in out.collect()), key=lambda r: r[0])
    assert [g[0] for g in got] == [0, 1, 2, 3, 4, 4, 5] and got[0][1] == "One & two" and got[1][1] == got[2][1] == "" and got[4] == got[5]
    assert got[4][1].endswith("What stands behind the script is read whole.") and got[3][2] > 20000 and got[6][2] == 90000 * 11 - 1
    assert html_text.extract_main_text(out.select("page_id", "url", F.col("text").alias("html")).limit(0)).count() == 0


# ---- op8 ---------------------------------------------------------------------------------------


def test_ranks_go_with_the_tasks(spark, tmp_path):
    ranks = [bytes([b]) for b in range(256)] + [b"th", b"the", b" t", b" the"]
    (tmp_path / "r.tiktoken").write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % k for k, t in enumerate(ranks)))
    enc = materialise.rank_encoder(str(tmp_path / "r.tiktoken"))
    assert (enc.end, enc.pad, enc.dtype) == (260, 261, "uint16")
    rows = [(1, "the the then é🔥", 5), (2, None, 5), (1, "the the then é🔥", 5), (None, "x" * 500, 5)]
    spark.createDataFrame(rows, "doc_id long, text string, slot int").coalesce(2).write.parquet(str(tmp_path / "docs"))
    (tmp_path / "r.tiktoken").unlink()  # what runs on executors needs no file
    out = materialise.materialise(spark.read.parquet(str(tmp_path / "docs")), str(tmp_path / "out"), enc, stride=16)
    n = out.count()
    every = materialise.read_slots(str(tmp_path / "out"), 0, n)[materialise.permuted(np.arange(n), n)].reshape(-1)
    every = every[every != enc.pad]
    texts = [enc.text(x[:-1]) for x in np.split(every, np.flatnonzero(every == enc.end) + 1)[:-1]]
    assert sorted(texts) == sorted(r[1] or "" for r in rows)


# ---- op9 ---------------------------------------------------------------------------------------


def shingles(text, n=4):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)] if w else [])


def near_rows():
    rng, rows = random.Random(6), []
    word = lambda: rng.choice("a b c d e f g h i j k l m n o p".split()) + rng.choice("xyz")
    for family in range(6):
        base = [word() for _ in range(60)]
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(60)] = word()
            rows.append((len(rows) + 10 * family, " ".join(copy)))
    return rows + [(3, rows[20][1]), (3, "quite another text of few words"), (500, "Quite Another text of few words"), (501, None), (502, "one"), (503, "ONE"), (None, rows[0][1])]


@pytest.mark.parametrize("block", [4096, 3])
def test_pairs_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    rows = near_rows()
    docs = spark.createDataFrame([(a, b, "own") for a, b in rows], "doc_id long, text string, name string").repartition(5)
    known = [(d, shingles(t)) for d, t in rows if d is not None]
    linked = [(a, b) for (a, s), (b, t) in itertools.combinations(known, 2) if s and t and 100 * len(s & t) >= 85 * len(s | t)]
    ids = sorted({d for d, _ in known})
    up = dict(zip(ids, components(len(ids), [(ids.index(a), ids.index(b)) for a, b in linked]), strict=True))
    got = ngram_join.near_groups(docs, 4, "0.85").collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == sorted((d, ids[up[d]]) for d, _ in known)
    assert len(got) == len(rows)
    pairs, member = ngram_join.near_pairs(docs, 4, "0.85")
    least = {}
    for d, s in known:
        least[s] = min(d, least.get(s, d))
    want = {tuple(sorted((least[s], least[t]))) for s, t in itertools.combinations(least, 2) if s and t and 100 * len(s & t) >= 85 * len(s | t)}
    assert {(r["src"], r["dst"]) for r in pairs.collect()} == {p for p in want if p[0] != p[1]}
    assert {(r["doc_id"], r["rep"]) for r in member.collect() if r["doc_id"] is not None} == {(d, least[s] if s else d) for d, s in known}


def test_no_text_is_lost_to_a_namesake(spark):
    rows = near_rows()
    kept = ngram_join.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 4, "0.85").collect()
    texts = [shingles(r["text"]) for r in kept if r["doc_id"] is not None and r["text"]]
    assert all(100 * len(a & b) < 85 * len(a | b) for a, b in itertools.combinations(texts, 2) if a and b)
    for _, text in rows:
        s = shingles(text)
        assert not s or any(100 * len(s & t) >= 60 * len(s | t) for t in texts), text
    assert sum(r["doc_id"] is None for r in kept) == 1 and sum(r["text"] is None for r in kept) == 1


# ---- op10, pipeline ----------------------------------------------------------------------------


def test_conversations(spark):
    rng, rows = random.Random(9), []
    piece = ["</s>", "[INST]", "\\", "|", "[/INST]", "ok", " ", "<s>", "[ROLE]", "é🔥", "[REPLY]"]
    for conv in range(40):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn // 2, rng.choice(["user", "assistant", "system", "tool", None]), "".join(rng.choice(piece) for _ in range(rng.randint(0, 8))) or None))
    rows += rows[:5]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, segment int").repartition(3)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(frame)).collect()}
    for conv in range(40):
        # Nulls go first in Spark's order.
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, (r[3] or "").encode()))
        learned = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine).encode()).hexdigest()
        assert (got[conv]["n_turns"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(mine), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


def test_pipeline_of_an_empty_table_and_of_repeats(spark, tmp_path):
    import corpus_pipeline

    docs = some(spark)
    docs.limit(0).coalesce(1).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    docs.unionAll(docs).coalesce(1).write.parquet(str(tmp_path / "twice" / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "twice")).where("doc_id IS NOT NULL")
    assert out.groupBy("doc_id", "piece").count().where("count > 1").isEmpty() and out.select("doc_id").distinct().count() > 10
