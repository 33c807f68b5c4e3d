"""Near-duplicate documents by the Jaccard similarity of their word n-grams.

1. Every text becomes the set of its distinct n-grams, hashed to 64 bits. Equal sets are one
   class from here on.
2. Sets are put in one global order: n-grams that some task saw often go last, all others by
   hash. If two sets are similar enough, so few n-grams differ that the first stretch of both
   orders holds two neighbours in common: of the first 2(1-t)n + 2 n-grams of a set, each
   missing one spoils two neighbourhoods and each foreign one a single. Pairs of neighbours are
   the keys; each task sends the least document of each key, so a hot key is one row a task.
3. Documents that share keys, directly or through others, form a candidate class. Classes are
   found by contraction (``components``); links never leave one.
4. Each class, or pair of blocks of a large one, is joined by a prefix tree. Sets, most common
   n-gram first, share paths and so share partial overlaps; a subtree is left where the overlap
   so far and the n-grams remaining on both sides cannot reach the needed overlap, or where all
   of it is already linked with the probe. What comes out is a spanning forest of true links.

Which n-grams go last changes the work alone, not the links: any order finds all of them.

Defined cases: a null or empty text, or one of white space, has no n-grams and links with
nothing; a text of fewer words is one n-gram; a null doc_id gives a row that links with
nothing; rows that share a doc_id each give a row, and all their texts are one vertex; equal and
repeated texts are one class; an empty table gives no rows; whole texts of any length are read;
other columns are ignored by ``near_groups`` and ``near_pairs``, and carried as they are, whatever
their names, by ``drop_near_copies``, where rows that share a doc_id are documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import discard, fresh, join_copies, slices, table, written
from loomspan.llm.components import connected_components

_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Tokens counted at once in a task; n-grams seen so often in one count are candidates for "common".
_CHUNK, _OFTEN = 1 << 22, 3
#: At most so many common n-grams, of so many documents at least, are sent to all tasks (1 MB).
MAX_COMMON, MIN_COMMON = 1 << 17, 16
#: A block of a class has about so many documents and n-grams at most.
BLOCK_DOCS, BLOCK_GRAMS = 4096, 1 << 22
#: Keys are dealt in so many ranges at least. An edge is found once in each range where two documents
#: share keys: with many ranges at every size that number follows the keys, and so the input.
RANGES = 1024


def gram_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of the lower-cased (A-Z) words."""
    words = text.lower().split() if text else ()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    s = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        s = s * _MIX + h[k : len(h) - n + 1 + k]
    s ^= s >> np.uint64(31)
    return np.unique(s * _MIX2)


def _name(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


_SETS = "doc_id long, n long, name binary, gram long, times long"


def _survey(n: int):
    """A row for each document (doc_id, n, name), and rows (gram, times) of what a task saw often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held, size = [], 0

        def often():
            grams, times = np.unique(np.concatenate(held), return_counts=True)
            keep = times >= _OFTEN
            nulls = lambda t: pa.nulls(int(keep.sum()), t)
            return pa.RecordBatch.from_arrays([nulls(pa.int64()), nulls(pa.int64()), nulls(pa.binary()), pa.array(grams[keep].view(np.int64)), pa.array(times[keep].astype(np.int64))], names=["doc_id", "n", "name", "gram", "times"])

        for batch in batches:
            sizes, names = [], []
            for text in batch.column("text").to_pylist():
                grams = gram_set(text, n)
                sizes.append(len(grams))
                names.append(_name(grams) if len(grams) else None)
                if len(grams) and names[-1] not in seen:
                    seen.add(names[-1])
                    held.append(grams)
                    size += len(grams)
            rows = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())], names=["doc_id", "n", "name", "gram", "times"])
            if size >= _CHUNK:
                yield often()
                held, size = [], 0
        if held:
            yield often()

    return run


def _keys(n: int, threshold: Fraction, common, ranges: int):
    """Packed rows: (range, keys, documents) of the neighbour keys, least document first; and edges
    (src, dst) of documents that share a key inside the task."""
    names, types = ["part", "packed", "src", "dst"], [pa.int32(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = common.value, set()
        keys, docs, size = [], [], 0

        def packed():
            key, doc = np.concatenate(keys), np.concatenate(docs)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            least = np.repeat(doc[first], np.diff(np.append(first, len(key))))
            edges = np.unique(np.stack((doc, least), 1)[doc != least], axis=0) if len(key) else np.empty((0, 2), np.int64)
            key, doc = key[first], doc[first]
            part = (key >> np.uint64(40)) % np.uint64(ranges)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(ranges + 1, dtype=np.uint64))
            rows = [(p, key[o].tobytes() + doc[o].tobytes()) for p in range(ranges) if len(o := order[cut[p] : cut[p + 1]])]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows] + [None] * len(edges), types[0]), pa.array([r[1] for r in rows] + [None] * len(edges), types[1]), pa.array([None] * len(rows) + edges[:, 0].tolist(), types[2]), pa.array([None] * len(rows) + edges[:, 1].tolist(), types[3])], names=names)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                grams = gram_set(text, n)
                if len(grams) < 2 or (name := _name(grams)) in seen:
                    continue
                seen.add(name)
                if len(last):
                    at = np.minimum(np.searchsorted(last, grams), len(last) - 1)
                    late = last[at] == grams
                    grams = np.concatenate((grams[~late], grams[late]))
                head = grams[: int(2 * (1 - threshold) * len(grams)) + 2]
                key = head[:-1] * _MIX + head[1:]
                keys.append(key ^ (key >> np.uint64(29)))
                docs.append(np.full(len(key), doc, np.int64))
                size += len(key)
            if size >= _CHUNK:
                yield packed()
                keys, docs, size = [], [], 0
        if keys:
            yield packed()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between the tasks' least documents of each key; the rows of a range come together."""
    held, now = [], None

    def edges():
        key = np.concatenate([np.frombuffer(b, np.uint64, len(b) // 16) for b in held])
        doc = np.concatenate([np.frombuffer(b, np.int64, len(b) // 16, len(b) // 2) for b in held])
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        least = np.repeat(doc[first], np.diff(np.append(first, len(key))))
        pairs = np.unique(np.stack((doc, least), 1)[doc != least], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["src", "dst"])

    for batch in batches:
        for part, packed in zip(batch.column("part").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            if part != now and held:
                yield edges()
                held = []
            now = part
            held.append(packed)
    if held:
        yield edges()


class _Tree:
    """A node: the ranks on its edge, its children by first rank, the sets that end here."""

    __slots__ = ("ranks", "children", "ends", "small", "large", "deep", "one")

    def __init__(self, ranks: np.ndarray, small: int, large: int, deep: int, one: int | None):
        self.ranks, self.children, self.ends = ranks, {}, []
        self.small, self.large, self.deep, self.one = small, large, deep, one


def link_sets(ids: list[int], sets: list[np.ndarray], threshold: Fraction, every_link: bool = False) -> list[tuple[int, int]]:
    """A spanning forest (id, id) of the links among the sets, by the prefix-tree join; or every link."""
    num, den = threshold.numerator, threshold.denominator
    every, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(every), np.int64)
    rank[np.lexsort((every, -times))] = np.arange(len(every))
    shared = int((times > 1).sum())  # what occurs once cannot match: it counts in sizes alone
    ends = np.cumsum([len(s) for s in sets])
    up = list(range(len(sets)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    root, edges, mask = _Tree(np.empty(0, np.int64), 0, 0, 0, None), [], np.zeros(shared, bool)
    for x in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        own, size = np.sort(rank[where[ends[x] - len(sets[x]) : ends[x]]]), len(sets[x])
        own = own[: np.searchsorted(own, shared)]
        mask[own] = True
        stack = [(c, 0) for c in root.children.values()] + ([(root, 0)] if root.ends else [])
        while stack:
            node, overlap = stack.pop()
            if node is not root and (den * node.large < num * size or not every_link and node.one is not None and find(node.one) == find(x)):
                continue
            overlap += int(np.count_nonzero(mask[node.ranks]))
            for y in node.ends:
                if (every_link or find(y) != find(x)) and den * overlap >= num * (size + len(sets[y]) - overlap):
                    edges.append((ids[x], ids[y]))
                    up[find(x)] = find(y)
            if node is root or not node.children:
                continue
            left = min(node.deep, len(own) - int(np.searchsorted(own, node.ranks[-1], side="right")))
            if (num + den) * (overlap + left) >= num * (size + node.small):
                stack += [(c, overlap) for c in node.children.values()]
        mask[own] = False
        node, at = root, 0
        while True:
            if node is not root:
                node.small, node.large, node.deep = min(node.small, size), max(node.large, size), max(node.deep, len(own) - at)
                if node.one is not None and find(node.one) != find(x):
                    node.one = None
            if at == len(own):
                node.ends.append(x)
                break
            child = node.children.get(int(own[at]))
            if child is None:
                leaf = _Tree(own[at:], size, size, 0, x)
                leaf.ends.append(x)
                node.children[int(own[at])] = leaf
                break
            rest = own[at : at + len(child.ranks)]
            differ = np.flatnonzero(child.ranks[: len(rest)] != rest)
            same = int(differ[0]) if len(differ) else len(rest)
            if same < len(child.ranks):  # cut the edge in two
                upper = _Tree(child.ranks[:same], child.small, child.large, child.deep + len(child.ranks) - same, child.one)
                child.ranks = child.ranks[same:]
                upper.children[int(child.ranks[0])] = child
                node.children[int(upper.ranks[0])] = upper
                child = upper
            node, at = child, at + same
    return edges


def _joiner(n: int, threshold: Fraction, every_link: bool):
    """Links of each (group, i, j); its rows come together, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []

        def links():
            found = link_sets(ids, sets, threshold, every_link) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["src", "dst"])

        for batch in batches:
            for *key, doc, text in zip(*(batch.column(c).to_pylist() for c in ("grp", "i", "j", "doc_id", "text")), strict=True):
                if key != now:
                    if len(ids) > 1:
                        yield links()
                    now, ids, sets = key, [], []
                grams = gram_set(text, n)
                # A doc_id may stand for several texts; each is joined, a repeated one once.
                if len(grams) and not (ids and ids[-1] == doc and np.array_equal(sets[-1], grams)):
                    ids.append(doc)
                    sets.append(grams)
        if len(ids) > 1:
            yield links()

    return run


def _linked(docs: DataFrame, words: int, threshold: str, every_link: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, rep) of every row of docs (doc_id, text), rep being the least document with an
    equal set; and links (src, dst) of representatives: a spanning forest, or every one."""
    spark, limit = docs.sparkSession, Fraction(threshold)
    if not Fraction(2, 3) < limit <= 1:
        raise ValueError("the threshold must be over 2/3: below it, small sets can link without a common key")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    survey = written(texts.mapInArrow(_survey(words), _SETS), "survey")
    sets = survey.where("n IS NOT NULL").select("doc_id", "n", "name")
    often = survey.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("times").alias("times")).where(F.col("times") >= MIN_COMMON).orderBy(F.desc("times"), "gram").limit(MAX_COMMON)
    common = spark.sparkContext.broadcast(np.sort(np.array(often.select("gram").toArrow().column(0).to_numpy(), np.int64).view(np.uint64)))

    ranges = max(RANGES, slices(spark))
    known = texts.where("doc_id IS NOT NULL AND text IS NOT NULL")
    packed = written(known.mapInArrow(_keys(words, limit, common, ranges), "part int, packed binary, src long, dst long"), "keys")
    inside = packed.where("src IS NOT NULL").select("src", "dst")
    across = packed.where("part IS NOT NULL").select("part", "packed").repartition("part").sortWithinPartitions("part").mapInArrow(_meet, "src long, dst long")

    # Copies with equal sets: the least document of each set stands for it. A hot set stays where its rows are.
    named = sets.where("name IS NOT NULL AND doc_id IS NOT NULL")
    by_set = written(named.groupBy("name").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "sets")
    shared = join_copies(named, by_set, "name").select("doc_id", "n", "rep")
    alone = sets.where("name IS NULL OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("rep"))
    reps = written(shared.unionByName(alone), "reps")
    discard(survey, by_set)
    moved = reps.where("rep <> doc_id").select("doc_id", "rep").distinct()
    edges = inside.unionByName(across).distinct()
    for end in ("src", "dst"):
        edges = edges.join(moved.select(F.col("doc_id").alias(end), "rep"), end, "left").withColumn(end, F.coalesce("rep", end)).drop("rep")
    classes = connected_components(edges)
    discard(packed)

    # One block for a class of usual size; a larger one is cut, and each pair of blocks joined.
    lengths = reps.where("rep = doc_id").select("doc_id", "n").groupBy("doc_id").agg(F.max("n").alias("n"))
    members = written(classes.select(F.col("id").alias("doc_id"), F.col("component").alias("grp")).join(lengths, "doc_id"), "members")
    sizes = members.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    one = members.join(sizes.where("blocks > 1"), "grp", "left_anti").select("doc_id", "grp", F.lit(0).alias("i"), F.lit(0).alias("j"))
    many = members.join(sizes.where("blocks > 1"), "grp").withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    many = many.select("doc_id", "grp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("doc_id", "grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    # A merge join at every size: the ids in classes grow with the corpus and are never broadcast.
    placed = one.unionByName(many).join(known.hint("merge"), "doc_id")
    links = placed.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "doc_id").mapInArrow(_joiner(words, limit, every_link), "src long, dst long")
    return reps, links


def near_groups(docs: DataFrame, words: int = 5, threshold: str = "0.8") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    reps, links = _linked(docs, words, threshold, False)
    # A doc_id with texts of several sets ties their classes together.
    tied = reps.groupBy("doc_id").agg(F.min("rep").alias("dst"), F.max("rep").alias("top")).where("dst < top")
    tied = reps.join(tied, "doc_id").select(F.col("rep").alias("src"), "dst")
    groups = connected_components(links.unionByName(tied))
    out = reps.join(groups.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def near_pairs(docs: DataFrame, words: int = 5, threshold: str = "0.8") -> tuple[DataFrame, DataFrame]:
    """Every link (src < dst) between documents that stand for their sets, and (doc_id, rep) of
    every row: copies need not be expanded into pairs. As many rows as there are links."""
    reps, links = _linked(docs, words, threshold, True)
    pairs = links.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src < dst").distinct()
    return pairs, reps.select("doc_id", "rep")


def drop_near_copies(docs: DataFrame, words: int = 5, threshold: str = "0.8") -> DataFrame:
    """One document of each near-duplicate group: that of the least doc_id. Rows without a doc_id stay.

    Where rows share a doc_id, each row is numbered for itself, so none is lost to a namesake.
    """
    known = docs.where("doc_id IS NOT NULL")
    if known.select("doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        keep = near_groups(docs, words, threshold).where("doc_id = component_id").select("doc_id")
        named = known.join(keep, "doc_id", "left_semi").select(*docs.columns)
    else:
        (row,) = fresh(docs, "_row")
        rows = written(known.withColumn(row, F.monotonically_increasing_id()), "rows")
        groups = near_groups(rows.select(F.col(row).alias("doc_id"), "text"), words, threshold).select(F.col("doc_id").alias(row), "component_id")
        first = rows.select(row, "doc_id").join(groups, row).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id"), F.col(row))).alias("least"))
        named = rows.join(first.select(F.col("least")[row].alias(row)), row, "left_semi").select(*docs.columns)
    return named.unionByName(docs.where("doc_id IS NULL"))


def op9_prefix_tree_join(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents", "doc_id", "text"), 4, "0.85")
