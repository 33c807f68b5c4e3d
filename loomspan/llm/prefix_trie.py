"""The trie of conversations by their common first turns, as one table of nodes.

A node of depth d is a distinct sequence of d turns (role and text); its members are the
conversations that begin with it. No tree is walked and no level is a job of its own:

* A node is known by a chained SHA-256 of its turns, so a conversation is a path of keys.
* A node belongs to its smallest member. That one is the smallest of every deeper node on its own
  path too, so each conversation owns a suffix of its path, and each node is owned once.
* Within a conversation, sums from the end give at each depth the tokens at and below it: of all
  its nodes, and of those that it owns; and whether its path ends in a leaf that it owns.
* One group-by of the keys adds these up. A node's subtree is met once for each member that
  passes, and once by owners, so occurrences minus owned is the tokens saved below; owned leaves
  count the leaves, and owned next nodes the children.

Windows mark the owned nodes in two steps, so that a node which all conversations share meets in
no task: the least member of each salted slice first, then the least of these. Members that end at
a node are joined to text in runs of conv_id, and the runs streamed in order through the digest.

A conversation is one task's, streamed; its turns are hashed before they are moved, so no text
is shuffled. ``spliced`` reads the texts once, few rows at a time, and writes what it numbers.

Defined cases: a null role or text is empty; rows of a null conv_id take no part; turns go by
their number, null first, and rows of one number by a digest of role and text, repeats included;
conversations of no turn are members of the root; no conversation, no node; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.common import join_copies, slices, written

#: Ids of members that end at a node are joined in runs of 2**RUN_BITS numbers.
RUN_BITS = 12
#: So many rows at most are in a batch of Spark's Parquet reader where texts are read: 4096 long ones are GB.
READ_ROWS = 256
_PATHS = "conv_id long, depth long, node binary, tokens long, ends boolean"
_EMIT = 8192


def steps_of(turns: DataFrame, tokens: Column | None = None) -> DataFrame:
    """(conv_id, turn, step, tokens) of turns (conv_id, turn, role, text): a digest in place of each text.

    tokens weighs a turn; without it, the text's UTF-8 bytes do.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    step = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    weight = F.octet_length(text) if tokens is None else tokens
    return turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), step.alias("step"), weight.cast("long").alias("tokens"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, each one's root first: a node for each, and whether it is the last."""
    now, key, depth, out = None, b"", 0, []

    def emit(rows: list[list]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", "depth", "node", "tokens", "ends"])

    for batch in batches:
        for conv, step, tokens in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "step", "tokens")), strict=True):
            if step is None:  # the root, once for each conversation
                now, key, depth = conv, hashlib.sha256().digest(), 0
            else:
                out[-1][-1] = False
                key, depth = hashlib.sha256(key + step).digest(), depth + 1
            out.append([now, depth, key, tokens, True])
            if len(out) > _EMIT:
                yield emit(out[:-1])
                out = out[-1:]
    if out:
        yield emit(out)


def paths(steps: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, depth, node, tokens, ends): the nodes on the path of each member, the root included."""
    none = F.lit(None)
    roots = members.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long")).distinct()
    roots = roots.select("conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("binary").alias("step"), F.lit(0).cast("long").alias("tokens"))
    rows = steps.select("conv_id", F.lit(1).alias("kind"), "turn", "step", "tokens").unionByName(roots)
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "step")
    return ordered.mapInArrow(_chained, _PATHS)


def owned_nodes(path: DataFrame) -> DataFrame:
    """path with owned (its conversation is the node's smallest member) and leaf (owned, and no member goes on).

    The least of a slice's members is marked first; these few alone meet in the node's own window.
    """
    n = slices(path.sparkSession)
    sliced = Window.partitionBy("node", F.pmod(F.xxhash64("conv_id"), F.lit(n)))
    first = path.withColumns({"least": F.min("conv_id").over(sliced) == F.col("conv_id"), "inner": F.max(~F.col("ends")).over(sliced)})
    whole = Window.partitionBy("node", F.when(~F.col("least"), F.col("conv_id")))
    marked = first.withColumns({"owned": F.col("least") & (F.min("conv_id").over(whole) == F.col("conv_id")), "inner": F.max("inner").over(whole)})
    return marked.withColumn("leaf", F.col("owned") & ~F.col("inner")).drop("least", "inner")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, ids) in order: the SHA-256 of each node's ids, comma-joined."""
    now, state, out = None, None, []

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["node", "ends_sha256"])

    for batch in batches:
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if node != now:
                if now is not None:
                    out.append((now, state.hexdigest()))
                now, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(out) > _EMIT:
            yield emit(out)
            out = []
    if now is not None:
        yield emit([*out, (now, state.hexdigest())])


def ends_digest(path: DataFrame) -> DataFrame:
    """(node, ends_sha256): a digest of the members of exactly a node's depth, ascending, for nodes that have some."""
    runs = path.where("ends").groupBy("node", F.shiftright("conv_id", RUN_BITS).alias("run"))
    ids = runs.agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return ids.repartition("node").sortWithinPartitions("node", "run").select("node", "ids").mapInArrow(_digested, "node binary, ends_sha256 string")


def prefix_trie(steps: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    steps are those of ``steps_of``; members (conv_id) adds conversations without a turn.
    """
    every = steps.select("conv_id") if members is None else steps.select("conv_id").unionByName(members.select(F.col("conv_id").cast("long")))
    marked = owned_nodes(written(paths(steps, every), "paths"))
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    below = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    unowned = F.when(~F.col("owned"), F.col("tokens")).otherwise(0)
    summed = written(
        marked.select(
            "conv_id", "depth", "node", "owned", "ends", F.sum(unowned).over(below).alias("saved"), F.sum(F.col("leaf").cast("int")).over(below).alias("leaves"),
            F.coalesce(F.lag("owned").over(up), F.lit(False)).alias("next_owned"), F.lead("owned").over(up).alias("above_owned"), F.lead("node").over(up).alias("above"),
        ),
        "summed",
    )
    total = lambda c: F.sum(F.col(c).cast("long"))
    nodes = written(
        summed.groupBy("node").agg(
            F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), total("next_owned").alias("n_children"), total("leaves").alias("n_leaves"), total("saved").alias("saved_tokens"),
        ),
        "nodes",
    )
    # Only the topmost node that a conversation owns has another one's node above it.
    topmost = summed.where("owned AND NOT above_owned").select("node", "above")
    owners = nodes.where("n_children > 0").select(F.col("node").alias("above"), F.col("conv_id").alias("owner"), F.col("n_children").alias("copies"))
    above = join_copies(topmost, owners, "above").select("node", "owner")
    out = nodes.join(above, "node", "left").join(ends_digest(summed), "node", "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("owner", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


@contextmanager
def small_batches(spark: SparkSession, rows: int = READ_ROWS) -> Iterator[None]:
    """Within it, Spark's Parquet reader takes at most so many rows at once."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spliced(steps: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """steps of conversations that begin alike: c takes the first h turns of c - c % group in place of its own, h being crc32(c) % most.

    The numbered steps are written, as they are used several times: each scan of a table's texts
    would hold a row group of them in memory, and several ran in an executor at once.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    numbered = steps.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "step")).cast("long").alias("turn"), "step", "tokens")
    with small_batches(steps.sparkSession):
        placed = written(numbered, "placed")
    convs = placed.where("turn = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("head"), h.alias("h"))
    heads = placed.where((F.col("turn") < most) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "head")
    shared = convs.join(heads, "head").where(F.col("turn") <= F.col("h"))
    return shared.select("conv_id", "turn", "step", "tokens").unionByName(placed.where(F.col("turn") > h))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    # Read as it lies: dealing a table of few splits over the cores would shuffle its texts.
    steps = steps_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie(spliced(steps), steps.select("conv_id"))


OP12_SQL = """
WITH given AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS step, turn FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv_id, text, step, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, step) AS k FROM given),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS head,
                 xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT), lambda acc, b: list_reduce(range(8)::UBIGINT[], lambda x, i: xor(x >> 1, (x & 1::UBIGINT) * 3988292384::UBIGINT), xor(acc, b)), 4294967295::UBIGINT), 4294967295::UBIGINT) % 9 AS h
          FROM (SELECT DISTINCT conv_id FROM given)),
steps AS (SELECT c.conv_id, p.k, p.step, p.text FROM convs c JOIN placed p ON p.conv_id = c.head AND p.k <= c.h UNION ALL SELECT c.conv_id, p.k, p.step, p.text FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.k > c.h),
path AS (SELECT conv_id, row_number() OVER o AS depth, string_agg(step, '') OVER o AS node, strlen(text) AS tokens FROM steps WINDOW o AS (PARTITION BY conv_id ORDER BY k)
         UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
node AS (SELECT node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(tokens) AS tokens FROM path GROUP BY node),
lineage AS (SELECT n.node, n.depth, n.n_convs, n.tokens, p.node AS top, p.depth AS above FROM node n JOIN path p ON p.conv_id = n.conv_id AND p.depth <= n.depth),
childless AS (SELECT node FROM node EXCEPT SELECT top FROM lineage WHERE depth = above + 1),
sums AS (SELECT top, sum((n_convs - 1) * tokens)::BIGINT AS saved_tokens, count(*) FILTER (depth = above + 1) AS n_children, count(*) FILTER (node IN (SELECT node FROM childless)) AS n_leaves FROM lineage GROUP BY top),
parent AS (SELECT l.node, n.conv_id AS parent_conv_id FROM lineage l JOIN node n ON n.node = l.top WHERE l.depth = l.above + 1),
ended AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM path p WHERE depth = (SELECT max(depth) FROM path q WHERE q.conv_id = p.conv_id) GROUP BY node)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.parent_conv_id, n.n_convs::BIGINT AS n_convs, s.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM node n JOIN sums s ON s.top = n.node LEFT JOIN parent p ON p.node = n.node LEFT JOIN ended e ON e.node = n.node"""
