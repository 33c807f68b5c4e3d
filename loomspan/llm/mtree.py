"""Exact top-k by inner product: best-first search in M-trees.

Vectors are points of Euclidean space; with ``|q - x|² = |q|² + |x|² - 2 q·x`` a lower bound on a
distance and the greatest length below a node bound the inner products below it from above.

* The root is shared: routing vectors fitted on a bounded sample, with covering radius and
  greatest length over all vectors that are nearest to each. A routing vector's vectors are cut into
  slices of about TREE_ROWS, and each slice is loaded into a tree of pages by one task.
* A page holds entries of one node. An inner entry has a routing vector (a stored one), its distance
  to the parent's routing vector, a covering radius, the greatest length below and a child page; a
  leaf entry has a vector, its distance to the parent's, and the ids of the rows that bear it.
* A query visits pages by falling bound. Before an entry's distance is computed, the stored distance
  to the parent is tried: ``| d(q, parent) - d(entry, parent) | - radius`` is a lower bound already.
  The search of a tree ends when no page can hold the k-th score or a tie with it.
* First each query searches one slice near to it. Its k-th score there is the bound with
  which the root sends it to the other slices.

Scores are inner products of integers, exact; only bounds are rounded, and they are loosened by
more than that. Equal vectors are one entry with their k + 1 smallest ids: no other of their rows
can be among the k best. Queries of a slice are dealt in blocks, so that no task has all queries.
In data without structure (64 independent directions) bounds avoid little, and the search is a
scan of all slices by all queries in blocks.

Defined cases: a vector that is null or holds a null or a component that is not finite takes no
part, nor does one whose integers are longer than 2**31, as a score would be no long; vectors of
different lengths do not meet; an empty vector meets empty ones, with score 0; rows of one vec_id
are rows of their own, each a query and each a candidate to the others; a null vec_id is a
candidate, last among ties, and no query; a table of fewer rows gives all of them; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import table, written

#: The root's routing vectors are fitted on so many vectors of each length at most, and are so many at most.
SAMPLE_ROWS = 20_000
MAX_ROUTES = 256
#: So many of the most frequent lengths have a root of their own; vectors of another are slices of one route.
MAX_LENGTHS = 16
TREE_ROWS = 8192
PAGE_ROWS = 512
FANOUT = 16
QUERY_ROWS = 256
#: So many counts of slices are sent to all tasks at most; more are joined in a shuffle.
MAX_SENT = 1 << 17
#: Squared length of the longest vector whose scores are longs.
MAX_SQUARE = float(1 << 62)
NO_ID = (1 << 63) - 1
_SLACK = 1e-9


def _stored(scale: float):
    """Rows (id, len, raw): the floors of the scaled components as bytes, in 16 bits where they fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            valid = pc.is_valid(column).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))  # a null is no number
            ends, out = np.cumsum(lengths), ([], [], [])
            for i, there, end, n in zip(batch.column("id").to_pylist(), valid, ends, lengths, strict=True):
                x = flat[end - n : end]
                with np.errstate(over="ignore", invalid="ignore"):
                    if there and float(x @ x) <= MAX_SQUARE:
                        small = np.abs(x).max(initial=0) < 1 << 15
                        for c, value in zip(out, (NO_ID if i is None else i, n, x.astype(np.int16 if small else np.int64).tobytes()), strict=True):
                            c.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["id", "len", "raw"])

    return run


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(id, len, raw) of the vectors (vec_id, embedding) that take part."""
    return vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>")).mapInArrow(_stored(scale), "id long, len int, raw binary")


def _matrix(raw: list[bytes], length: int) -> np.ndarray:
    """Integers of vectors as stored."""
    kinds = [np.int16 if len(r) == 2 * length else np.int64 for r in raw]
    if len(set(kinds)) <= 1:
        return np.frombuffer(b"".join(raw), kinds[0] if kinds else np.int16).reshape(len(raw), length).astype(np.int64)
    return np.array([np.frombuffer(r, k) for r, k in zip(raw, kinds, strict=True)], np.int64)


def _centres(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 4) -> np.ndarray:
    """k-means of a few steps; at most k different rows."""
    words = np.unique(x[rng.choice(len(x), min(k, len(x)), replace=False)], axis=0)
    for _ in range(steps):
        near = _squared(x, words).argmin(1)
        n = np.bincount(near, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words


def _squared(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (words**2).sum(1)[None] - 2 * x @ words.T, 0)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(-1))


# ---- pages -------------------------------------------------------------------------------


@dataclass
class Page:
    """Entries of a node. ``child`` and ``radius`` are an inner page's, ``ids`` a leaf's."""

    vectors: np.ndarray
    to_parent: np.ndarray
    square: np.ndarray
    radius: np.ndarray | None = None
    child: np.ndarray | None = None
    ids: list[list[int]] | None = None

    def __post_init__(self):
        self.floats = self.vectors.astype(np.float64)
        self.loose = self.square * (1 + 2 * _SLACK)
        self.exact = float(self.square.max(initial=0)) * 2.0**-104  # times a query's: below 1, sums of products are exact in doubles


def grown(x: np.ndarray, ids: list[list[int]], parent: np.ndarray, page_rows: int = PAGE_ROWS, fanout: int = FANOUT) -> list[Page]:
    """Pages of a tree over the rows of x, loaded from the top; the first is the root, whose parent is given."""
    floats, square, pages, rng = x.astype(np.float64), (x.astype(np.float64) ** 2).sum(1), [], np.random.default_rng(13)

    def load(at: np.ndarray, above: np.ndarray) -> int:
        number = len(pages)
        pages.append(None)
        if len(at) <= page_rows:
            pages[number] = Page(x[at], _distance(floats[at], above), square[at], ids=[ids[i] for i in at])
            return number
        near = _squared(floats[at], _centres(floats[at], min(fanout, -(-len(at) // page_rows) + 1), rng)).argmin(1)
        if near.min() == near.max():  # nothing to tell them apart by
            near = np.arange(len(at)) % 2
        routes, radii, longest, children = [], [], [], []
        for c in np.unique(near):
            mine = at[near == c]
            route = mine[_distance(floats[mine], floats[mine].mean(0)).argmin()]
            routes.append(route)
            radii.append(_distance(floats[mine], floats[route]).max())
            longest.append(square[mine].max())
            children.append(load(mine, floats[route]))
        pages[number] = Page(x[routes], _distance(floats[routes], above), np.array(longest), np.array(radii), np.array(children))
        return number

    load(np.arange(len(x)), parent)
    return pages


_PAGES = "len int, route int, slice int, page int, vectors binary, to_parent binary, square binary, radius binary, child binary, ids array<array<bigint>>"


def _packed(pages: list[Page], key: tuple[int, int, int]) -> pa.Table:
    raw = lambda a: None if a is None else a.tobytes()
    rows = [(*key, k, raw(p.vectors.astype(np.int64)), raw(p.to_parent), raw(p.square), raw(p.radius), raw(None if p.child is None else p.child.astype(np.int64)), p.ids) for k, p in enumerate(pages)]
    kinds = [pa.int32()] * 4 + [pa.binary()] * 5 + [pa.list_(pa.list_(pa.int64()))]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in _PAGES.split(", ")])


def _unpacked(found: pa.Table) -> list[Page]:
    pages: dict[int, Page] = {}
    read = lambda b, kind=np.float64: None if b is None else np.frombuffer(b, kind)
    for r in found.to_pylist():
        to_parent = read(r["to_parent"])
        pages[r["page"]] = Page(read(r["vectors"], np.int64).reshape(len(to_parent), r["len"]), to_parent, read(r["square"]), read(r["radius"]), read(r["child"], np.int64), r["ids"])
    return [pages[k] for k in range(len(pages))]


# ---- search in a tree --------------------------------------------------------------------


def best_first(pages: list[Page], q: np.ndarray, own: int | None, k: int, parent: np.ndarray, bound: float = -np.inf) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, id) of a tree for one query, ties to smaller ids, and how many distances were computed.

    bound: a score that k rows elsewhere reach. One row with the query's vector and id ``own`` is left out.
    """
    floats = q.astype(np.float64)
    square = float(floats @ floats)
    best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst first
    computed, order = 1, [(-np.inf, 0, float(_distance(floats, parent)))]

    def reach() -> float:
        """What ``loose`` less the square of a lower bound on the distance must reach, for a score of the bound: 2 q·x = |q|² + |x|² - |q - x|²."""
        return 2 * bound - square * (1 + 2 * _SLACK) - 2e-3

    while order:
        top, number, to_route = heapq.heappop(order)
        if -top < reach():
            break
        page = pages[number]
        least = np.abs(page.to_parent - to_route)
        if page.child is not None:
            near = np.flatnonzero(page.loose - np.maximum(least - page.radius, 0) ** 2 >= reach())
            away = _distance(page.floats[near], floats)
            computed += len(near)
            most = page.loose[near] - np.maximum(away - page.radius[near], 0) ** 2
            for e, d, m in zip(near, away, most, strict=True):
                if m >= reach():
                    heapq.heappush(order, (-float(m), int(page.child[e]), float(d)))
            continue
        hopeful = page.loose - least * least >= reach()
        n = int(np.count_nonzero(hopeful))
        if not n:
            continue
        rows, mine = (page.floats, floats) if page.exact * square < 1 else (page.vectors, q)
        # Where most entries stand, leaving the others out costs more than their products.
        near = np.flatnonzero(hopeful) if 2 * n < len(hopeful) else None
        scores = (rows if near is None else rows[near]) @ mine
        computed += len(scores)
        passed = np.flatnonzero(scores >= bound)
        if near is None:
            near = np.arange(len(scores)) if len(passed) else passed
        for e, score in sorted(((int(near[i]), int(scores[i])) for i in passed), key=lambda x: -x[1]):
            if score < bound:
                break
            ids = page.ids[e]
            if own is not None and own in ids and np.array_equal(page.vectors[e], q):
                ids = list(ids)
                ids.remove(own)
            for i in ids:
                if len(best) < k:
                    heapq.heappush(best, (score, -i))
                elif (score, -i) > best[0]:
                    heapq.heapreplace(best, (score, -i))
            if len(best) == k:
                bound = max(bound, best[0][0])
    return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1])), computed


# ---- the forest --------------------------------------------------------------------------


@dataclass
class Forest:
    """Trees over all vectors. ``routes``: by length, the root's vectors, covering radii and greatest squared lengths."""

    pages: DataFrame
    slices: DataFrame
    routes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _near_route(books: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, raws = np.array(batch.column("len").to_pylist(), np.int64), batch.column("raw").to_pylist()
            route, away, square = np.zeros(len(raws), np.int64), np.zeros(len(raws)), np.zeros(len(raws))
            for length in set(lengths.tolist()):
                at = np.flatnonzero(lengths == length)
                x = _matrix([raws[i] for i in at], length).astype(np.float64)
                square[at] = (x**2).sum(1)
                if length in books:
                    route[at] = _squared(x, books[length]).argmin(1)
                    away[at] = _distance(x, books[length][route[at]])
            more = [pa.array(route, pa.int32()), pa.array(away), pa.array(square)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "route", "away", "square"])

    return run


def _books(entries: DataFrame) -> dict[int, np.ndarray]:
    counts = entries.groupBy("len").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "len").limit(MAX_LENGTHS).collect()
    books = {}
    for length, n in ((r["len"], r["n"]) for r in counts if r["len"]):
        share = min(1.0, SAMPLE_ROWS / n)
        mine = entries.where(F.col("len") == length).where(F.pmod(F.xxhash64("raw", F.lit("sample")), F.lit(1 << 30)) <= int(share * (1 << 30)))
        x = _matrix(mine.select("raw").limit(2 * SAMPLE_ROWS).toArrow().column(0).to_pylist(), length).astype(np.float64)
        k = min(MAX_ROUTES, -(-n // TREE_ROWS))
        books[length] = _centres(x, k, np.random.default_rng(13)) if len(x) else np.zeros((1, length))
    return books


def _grower(books: dict[int, np.ndarray]):
    def run(found: pa.Table) -> pa.Table:
        key = tuple(found.column(c)[0].as_py() for c in ("len", "route", "slice"))
        x = _matrix(found.column("raw").to_pylist(), key[0])
        parent = books[key[0]][key[1]] if key[0] in books else np.zeros(key[0])
        return _packed(grown(x, found.column("ids").to_pylist(), parent), key)

    return run


def plant(units: DataFrame, k: int) -> Forest:
    """The trees of ``quantised`` rows, for searches of k rows at most."""
    ranked = Window.partitionBy("len", "raw").orderBy("id")
    few = units.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k + 1)  # limited before the shuffle too
    entries = written(few.groupBy("len", "raw").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    books = _books(entries)
    routed = written(entries.mapInArrow(_near_route(books), "len int, raw binary, ids array<long>, route int, away double, square double"), "routed")
    by_route = routed.groupBy("len", "route").agg(F.ceil(F.count("*") / TREE_ROWS).cast("int").alias("n"), F.max("away").alias("radius"), F.max("square").alias("longest"))
    slices = written(by_route, "slices")
    known = slices.where(F.col("len").isin(list(books))).collect()  # MAX_LENGTHS * MAX_ROUTES rows at most
    routes = {}
    for length, book in books.items():
        radius, longest = np.full(len(book), -np.inf), np.zeros(len(book))
        for r in known:
            if r["len"] == length:
                radius[r["route"]], longest[r["route"]] = r["radius"], r["longest"]
        routes[length] = (book, radius, longest)
    sent = F.broadcast(slices) if slices.count() <= MAX_SENT else slices
    cut = routed.join(sent.select("len", "route", "n"), ["len", "route"]).select("len", "route", F.pmod(F.xxhash64("raw"), F.col("n")).cast("int").alias("slice"), "raw", "ids")
    pages = cut.groupBy("len", "route", "slice").applyInArrow(_grower(books), _PAGES)
    return Forest(written(pages, "pages"), slices, routes)


_QUERY = "id long, tag binary, raw binary, bound double"


def _sender(routes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], home: bool):
    """Rows (len, route, id, tag, raw, bound): a query with its nearest route (home), or each that may hold a score of its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for length, *query in zip(*(batch.column(c).to_pylist() for c in ("len", "id", "tag", "raw", "bound")), strict=True):
                chosen = [0]
                if length in routes:
                    q, (book, radius, longest) = _matrix([query[2]], length)[0].astype(np.float64), routes[length]
                    away, square = _distance(book, q), float((q**2).sum())
                    there = radius >= 0  # others bear no vector
                    if home:
                        chosen = [int(np.where(there, away, np.inf).argmin())]
                    else:
                        bound = -np.inf if query[3] is None else query[3]
                        upper = (square + longest - np.maximum(away - radius, 0) ** 2) / 2 + _SLACK * (square + longest) + 1e-3
                        chosen = np.flatnonzero(there & (upper >= bound)).tolist()
                for route in chosen:
                    for column, value in zip(out, (length, route, *query), strict=True):
                        column.append(value)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["len", "route", "id", "tag", "raw", "bound"])

    return run


def _searcher(books: dict[int, np.ndarray], k: int):
    def run(queries: pa.Table, pages: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(queries) and len(pages):
            length, route = pages.column("len")[0].as_py(), pages.column("route")[0].as_py()
            tree, parent = _unpacked(pages), books[length][route] if length in books else np.zeros(length)
            for i, tag, raw, bound in zip(*(queries.column(c).to_pylist() for c in ("id", "tag", "raw", "bound")), strict=True):
                found, _ = best_first(tree, _matrix([raw], length)[0], i, k, parent, -np.inf if bound is None else bound)
                rows += [(i, tag, other, score) for score, other in found]
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "tag", "vec_id", "score"])

    return run


def _searched(forest: Forest, sent: DataFrame, k: int) -> DataFrame:
    """(id, tag, vec_id, score) of queries (len, route, slice, id, tag, raw, bound): a tree's pages with its queries, in blocks."""
    books, tree = {length: book for length, (book, _, _) in forest.routes.items()}, ["len", "route", "slice"]
    sent = written(sent, "sent")
    blocks = written(sent.groupBy(*tree).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks")), "blocks")
    small = F.broadcast(blocks) if blocks.count() <= MAX_SENT else blocks
    queries = sent.join(small, tree).withColumn("block", F.pmod(F.xxhash64("tag", "id"), F.col("blocks")).cast("int")).drop("blocks")
    pages = forest.pages.join(small, tree).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    key = [*tree, "block"]
    return queries.groupBy(*key).cogroup(pages.groupBy(*key)).applyInArrow(_searcher(books, k), "id long, tag binary, vec_id long, score long")


def top_k(units: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of ``quantised`` that are queries, against all other rows."""
    units = written(units, "units")
    forest = plant(units, k)
    # Rows of one id and vector are one search, whose result each of them gets.
    asked = units.where(is_query & (F.col("id") != NO_ID)).groupBy("id", "len", "raw").agg(F.count("*").alias("times"))
    asked = written(asked.withColumn("tag", F.unhex(F.md5(F.concat(F.col("len").cast("string").cast("binary"), F.col("raw"))))), "asked")
    schema = f"len int, route int, {_QUERY}"
    n_of = forest.slices.select("len", "route", "n")
    n_of = F.broadcast(n_of) if n_of.count() <= MAX_SENT else n_of
    own = F.pmod(F.xxhash64("tag", "id"), F.col("n")).cast("int")
    at_home = asked.select("len", "id", "tag", "raw", F.lit(None).cast("double").alias("bound")).mapInArrow(_sender(forest.routes, True), schema).join(n_of, ["len", "route"])
    at_home = written(at_home.select("len", "route", own.alias("slice"), "id", "tag", "raw", "bound"), "home")
    first = written(_searched(forest, at_home, k), "first")
    bounds = first.groupBy("id", "tag").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("bound"))
    bounded = asked.join(bounds, ["id", "tag"], "left").select("len", "id", "tag", "raw", "bound").mapInArrow(_sender(forest.routes, False), schema)
    sent = bounded.join(n_of, ["len", "route"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    elsewhere = sent.select("len", "route", "slice", "id", "tag", "raw", "bound").join(at_home.select("len", "route", "slice", "id", "tag"), ["len", "route", "slice", "id", "tag"], "left_anti")
    found = first.unionByName(_searched(forest, elsewhere, k))
    order = Window.partitionBy("id", "tag").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = best.join(asked.select("id", "tag", "times"), ["id", "tag"]).withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select(F.col("id").alias("query_id"), "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def op13_mtree_search(spark, sf_dir: str) -> DataFrame:
    units = quantised(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return top_k(units, F.col("id") % 50 == 0, 5)


OP13_SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.row <> c.row AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5"""
