"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut in halves, each half has its own codebook (k-means on a bounded
sample), and the product of the codebooks is the grid of cells. Each vector lives in the cell
of its nearest codewords. As a query it visits cells in order of a lower bound on the distance
that a vector of the cell can have, summed over the halves (multi-sequence order), and stops at
a limit. The limit is calibrated on the sample: neighbours at exactly the threshold, in random
directions, and the sample's own linked pairs lie within it at the target recall; nearer pairs
are found more surely. Candidates are verified by the cosine in double precision.

Both of a pair visit. A pair that only one of them finds counts for both: the verifier tells
from the cell of the finder whether the other one visits it too.

Equal vectors are compared once and counted by their number. Cells and their visitors are
cut into blocks of bounded size, so a hot cell is dealt over many tasks; a block gives back
counts and a spanning forest, never its pairs.

Codebooks grow with the root of the number of vectors, from two words on, up to MAX_WORDS. The most frequent
MAX_LENGTHS lengths have codebooks; vectors of any other length are compared with all of that
length, in blocks, which is exact.

Defined cases: a vector that is null, empty, all zero, or holds a null or a component that
is not finite links with nothing; vectors of different lengths never link; rows that share a
vec_id each give a row, and stand for one vertex; a null vec_id gives a row that links with
nothing; vectors of any length are taken whole; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import join_copies, table, written
from loomspan.llm.components import connected_components

#: The codebooks are fitted on so many vectors at most, of each length.
SAMPLE_ROWS = 20_000
MAX_WORDS = 1024
MAX_LENGTHS = 16
#: A cell's bound is taken from the planes to so many of the nearest codewords.
PLANES = 8
#: So many counts of cells are sent to all tasks at most; more are joined in a shuffle.
MAX_SENT = 1 << 18
#: The grid has four times as many cells as it takes for cells of so many vectors: most are empty, as halves go together.
CELL_ROWS = 512
#: Share of neighbours at the very threshold that the visited cells hold.
TARGET_RECALL = 0.99
CALIBRATE_ROWS = 2000
BLOCK_ROWS = 1024


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    points = np.unique(points, axis=0)
    if len(points) <= k:
        return points
    words = points[rng.choice(len(points), k, replace=False)]
    for _ in range(steps):
        near = ((words**2).sum(1)[None] - 2 * points @ words.T).argmin(1)
        for c in range(k):
            mine = points[near == c]
            words[c] = mine.mean(0) if len(mine) else points[rng.integers(len(points))]
    return np.unique(words, axis=0)


def _squared(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (words**2).sum(1)[None] - 2 * x @ words.T, 0)


def _least(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row, and a lower bound on the squared distance to what may live at each.

    What lives at c is nearer to c than to any b: it is beyond the plane between them. The
    planes to the PLANES nearest codewords are tried.
    """
    d = _squared(x, words)
    low = np.zeros_like(d)
    apart = np.sqrt(_squared(words, words))
    n = min(PLANES, len(words))
    near = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(words) else np.tile(np.arange(n), (len(x), 1))
    rows = np.arange(len(x))
    for k in range(n):
        b = near[:, k]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d - d[rows, b][:, None]) / (2 * apart[b])
        plane[rows, b] = 0
        np.maximum(low, plane, out=low)
    return d.argmin(1), low**2


def _visits(low1: np.ndarray, low2: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Multi-sequence traversal: cells by growing sum of the halves' bounds, up to the limit.

    Each half is a sequence in growing order. A cell enters the heap when the one before it in a
    sequence has been visited, so only the border of what was visited is held, and the traversal
    ends at the first cell beyond the limit, whatever the size of the grid.
    """
    first, second = low1.argsort(kind="stable"), low2.argsort(kind="stable")
    s1, s2 = low1[first].tolist(), low2[second].tolist()
    heap, found = [(s1[0] + s2[0], 0, 0)], []
    while heap and heap[0][0] <= limit:
        _, i, j = heapq.heappop(heap)
        found.append((int(first[i]), int(second[j])))
        if j + 1 < len(s2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return found


def _unit(raw: list[bytes], length: int) -> np.ndarray:
    """Unit vectors in double precision of vectors as stored, single or double."""
    kind = np.float32 if raw and len(raw[0]) == 4 * length else np.float64
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), length).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _calibrated(x: np.ndarray, one: np.ndarray, two: np.ndarray, threshold: float, recall: float, rng: np.random.Generator) -> float:
    """The limit on the least squared distance within which so many neighbours' cells lie."""
    q, half = x[:CALIBRATE_ROWS], x.shape[1] // 2
    aside = rng.normal(size=q.shape)
    aside -= (aside * q).sum(1, keepdims=True) * q
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-300)
    pairs = [(q, threshold * q + np.sqrt(1 - threshold**2) * aside)]
    a, b = np.nonzero(np.triu(q @ q.T >= threshold, 1))
    if len(a):
        pairs.append((q[a], q[b]))
    limit = 0.0
    for left, right in pairs:
        at, key = np.arange(len(left)), 0.0
        for words, part in ((one, slice(0, half)), (two, slice(half, None))):
            key = key + _least(left[:, part], words)[1][at, _squared(right[:, part], words).argmin(1)]
        limit = max(limit, float(np.quantile(key, recall)))
    return limit * (1 + 1e-9) + 1e-12  # a sampled pair at the limit itself is inside, whatever the rounding


def _fit(reps: DataFrame, threshold: float, recall: float) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Codebooks of the halves and the visiting limit, by the vectors' length, for the most frequent lengths."""
    counts = reps.groupBy("len").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "len").limit(MAX_LENGTHS).collect()
    books = {}
    for length, n in ((r["len"], r["n"]) for r in counts if r["len"] > 1):
        share = min(1.0, SAMPLE_ROWS / n)
        mine = reps.where(F.col("len") == length).where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) <= int(share * (1 << 30)))
        x = _unit(mine.select("raw").limit(2 * SAMPLE_ROWS).toArrow().column(0).to_pylist(), length)
        k = int(np.clip(np.ceil(2 * np.sqrt(n / CELL_ROWS)), 1, MAX_WORDS))
        rng, half = np.random.default_rng(5), length // 2
        if not len(x):
            x = np.eye(1, length)
        one, two = _kmeans(x[:, :half], k, rng), _kmeans(x[:, half:], k, rng)
        books[length] = (one, two, _calibrated(x, one, two, threshold, recall, rng))
    return books


def _stored(batches):
    """Vectors as bytes, single precision where the column is; equal ones have equal bytes, invalid ones none."""
    for batch in batches:
        column = batch.column("embedding")
        kind = np.float32 if pa.types.is_float32(column.type.value_type) else np.float64
        ids, raws, lengths = [], [], []
        for i, v in zip(batch.column("id").to_pylist(), column.to_pylist(), strict=True):
            x = np.array(v if v and None not in v else [], kind)
            valid = bool(np.isfinite(x).all() and x.any())
            ids.append(i)
            raws.append((x + kind(0)).tobytes() if valid else None)
            lengths.append(len(x))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raws, pa.binary()), pa.array(lengths, pa.int32())], names=["id", "raw", "len"])


def _assigner(books: dict, visiting: bool):
    """Rows (cell, home, id, raw, copies): the cell that a vector lives in (home), or each that it visits."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            lengths = np.array(batch.column("len").to_pylist())
            ids, raws, copies = (batch.column(c).to_pylist() for c in ("id", "raw", "copies"))
            for length in set(lengths.tolist()):
                at = np.flatnonzero(lengths == length)
                if length in books:
                    x, (one, two, limit) = _unit([raws[i] for i in at], length), books[length]
                    near1, low1 = _least(x[:, : length // 2], one)
                    near2, low2 = _least(x[:, length // 2 :], two)
                    visits = (_visits(a, b, limit) for a, b in zip(low1, low2, strict=True)) if visiting else ([p] for p in zip(near1, near2, strict=True))
                    home = near1 * MAX_WORDS + near2
                else:  # one cell for all of the length
                    visits, home = ([(0, 0)] for _ in at), np.zeros(len(at), np.int64)
                for i, own, cells in zip(at, home, visits, strict=True):
                    for a, b in cells:
                        for column, value in zip(out, ((length << 32) + int(a) * MAX_WORDS + int(b), int(own), ids[i], raws[i], copies[i]), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["cell", "home", "id", "raw", "copies"])

    return run


def _forest(hits: np.ndarray, queries: np.ndarray, members: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the hits (queries by members) connect: each id with its least."""
    mine, other = queries.copy(), members.copy()
    big = np.iinfo(np.int64).max
    while True:
        seen = np.where(hits, mine[:, None], big).min(0, initial=big)
        new_other = np.minimum(other, seen)
        new_mine = np.minimum(mine, np.where(hits, new_other[None], big).min(1, initial=big))
        if (new_mine == mine).all() and (new_other == other).all():
            break
        mine, other = new_mine, new_other
    ids, least = np.concatenate((queries, members)), np.concatenate((mine, other))
    return sorted({(int(a), int(b)) for a, b in zip(ids[ids != least], least[ids != least], strict=True)})


def _visited(x: np.ndarray, homes: np.ndarray, book: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    """Whether each vector (row), as a query, visits each of the cells: as ``_visits`` decides it."""
    one, two, limit = book
    half = x.shape[1] // 2
    low1, low2 = _least(x[:, :half], one)[1], _least(x[:, half:], two)[1]
    return low1[:, homes // MAX_WORDS] + low2[:, homes % MAX_WORDS] <= limit


def _verifier(threshold: float, books: dict):
    def run(table: pa.Table) -> pa.Table:
        role = np.array(table.column("query").to_pylist(), bool)
        ids, copies, homes = (np.array(table.column(c).to_pylist(), np.int64) for c in ("id", "copies", "home"))
        length = table.column("cell")[0].as_py() >> 32
        x = _unit(table.column("raw").to_pylist(), length)
        q, m = np.flatnonzero(role), np.flatnonzero(~role)
        rows: list[tuple] = []
        if len(q) and len(m):
            hits = (x[q] @ x[m].T >= threshold) & (ids[q][:, None] != ids[m][None])
            links = hits @ copies[m]
            rows = [(int(i), None, int(n)) for i, n in zip(ids[q], links, strict=True) if n]
            if length in books and hits.any():  # what a member does not find by itself counts for it here
                a, b = np.flatnonzero(hits.any(1)), np.flatnonzero(hits.any(0))
                one_sided = hits[np.ix_(a, b)] & ~_visited(x[m[b]], homes[q[a]], books[length]).T
                rows += [(int(i), None, int(n)) for i, n in zip(ids[m[b]], copies[q[a]] @ one_sided, strict=True) if n]
            rows += [(a, b, None) for a, b in _forest(hits, ids[q], ids[m])]
        return pa.table({"src": pa.array([r[0] for r in rows], pa.int64()), "dst": pa.array([r[1] for r in rows], pa.int64()), "links": pa.array([r[2] for r in rows], pa.int64())})

    return run


def link_vectors(vectors: DataFrame, threshold: float = 0.95, recall: float = TARGET_RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), "embedding")
    units = written(rows.mapInArrow(_stored, "id long, raw binary, len int"), "vectors")
    known = units.where("raw IS NOT NULL AND id IS NOT NULL")
    reps = written(known.groupBy("raw").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("len").alias("len")), "reps")
    books = _fit(reps, threshold, recall)
    cells = "cell long, home long, id long, raw binary, copies long"
    members = reps.mapInArrow(_assigner(books, False), cells)
    queries = reps.mapInArrow(_assigner(books, True), cells)
    blocks = lambda df: df.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("n"))
    sizes = written(blocks(members).withColumnRenamed("n", "n_members").join(blocks(queries).withColumnRenamed("n", "n_queries"), "cell"), "cells")
    sizes = F.broadcast(sizes) if sizes.count() <= MAX_SENT else sizes

    def dealt(df: DataFrame, own: str, others: str, query: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        return df.join(sizes, "cell").select("cell", F.lit(query).alias("query"), "home", "id", "raw", "copies", mine.alias("own"), F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias("other"))

    carried = ("query", "home", "id", "raw", "copies")
    both = dealt(members, "n_members", "n_queries", False).select("cell", F.col("own").alias("m"), F.col("other").alias("q"), *carried).unionByName(
        dealt(queries, "n_queries", "n_members", True).select("cell", F.col("other").alias("m"), F.col("own").alias("q"), *carried)
    )
    found = written(both.groupBy("cell", "m", "q").applyInArrow(_verifier(threshold, books), "src long, dst long, links long"), "links")
    links = found.where("links IS NOT NULL").groupBy("src").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("dst IS NOT NULL").select("src", "dst"))
    by_rep = reps.join(links.withColumnRenamed("src", "id"), "id", "left").join(groups, "id", "left").select("raw", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = join_copies(known, written(by_rep, "found"), "raw").select("id", "n_links", "component_id")
    alone = units.where("raw IS NULL OR id IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op5_multi_index(spark, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
