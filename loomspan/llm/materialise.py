"""Token ids in training order: fixed-stride binary shards, ordered by a keyed permutation.

1. Each task encodes its documents in order, an end mark after each, and cuts the stream into
   sequences of ``stride`` ids; the last one of a task is padded. A first job only counts them.
2. Sequences are numbered 0 to N - 1: those of earlier tasks come first.
3. A Feistel network over the least domain of an even number of bits that holds N, keyed,
   walks from each number until it is below N again: a bijection, so every sequence has a slot
   of its own and no slot is empty.
4. Each range of slots is one task's: it sorts them and writes a shard, record after record of
   the same size. A shard appears under its name when it is complete, and a task that runs
   again writes the same bytes.

``read_slots`` reads any run of slots by seeking, so training resumes at any step.

Encoders: ``ByteEncoder`` (ids are UTF-8 bytes; 0xFE ends a document, 0xFF pads; neither occurs
in UTF-8) and ``RankEncoder`` (a byte-level BPE; ``rank_encoder`` reads its file on the driver and
the ranks go with the tasks, so executors need no file of their own).

Defined cases: a null or empty text is its end mark alone; texts of any length go on over
sequences; repeated rows are each written, in their order; a null doc_id is carried; an empty table
makes no shard and no rows; other columns are ignored. Texts are encoded twice rather than stored in between, so docs must give
the same rows in the same partitions each time, as a table that is read does; the writers
check that every slot is there once.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from loomspan.llm.common import new_path, written

STRIDE, SHARD_BYTES, KEY, ROUNDS = 2048, 256 << 20, 0x5EED, 6


@dataclass(frozen=True)
class ByteEncoder:
    dtype: str = "uint8"
    end: int = 0xFE
    pad: int = 0xFF

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-8", "replace"), np.uint8)

    def text(self, ids: np.ndarray) -> str:
        return ids.tobytes().decode()


# Fixed value: how the public byte-level vocabularies cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class RankEncoder:
    """ids are ranks of a byte-level BPE: a line (base64 of the token, rank) for each; end and pad
    are free ids beyond them."""

    ranks: bytes
    end: int
    pad: int
    pattern: str = PATTERN
    dtype: str = "uint16"

    def ids(self, text: str) -> np.ndarray:
        return np.array(_encoding(self.ranks, self.pattern).encode_ordinary(text), self.dtype)

    def text(self, ids: np.ndarray) -> str:
        return _encoding(self.ranks, self.pattern).decode(ids.tolist())


def rank_encoder(path: str, pattern: str = PATTERN) -> RankEncoder:
    """The encoder of a rank file by path or URI; the two ids behind its last rank end and pad."""
    fs, root = filesystem(path)
    with fs.open_input_file(root) as f:
        ranks = f.read()
    free = 1 + max(int(line.split()[1]) for line in ranks.splitlines() if line.strip())
    return RankEncoder(ranks, free, free + 1, pattern, "uint16" if free + 1 < 1 << 16 else "uint32")


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=found, special_tokens={})


# ---- the permutation -------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The slot of each index: a keyed bijection of 0 .. n - 1."""
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _mixed(np.uint64(key) + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):  # the walk ends: a bijection comes back to where it began
        left, right = x[todo] >> half, x[todo] & mask
        for k in keys:
            left, right = right, left ^ (_mixed(right ^ k) & mask)
        x[todo] = (left << half) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


# ---- sequences and shards ----------------------------------------------------------------

SEQUENCES = "part int, k long, n_tokens long, n_docs long, first_doc long, ids binary"
PLACES = "slot long, shard long, offset long, n_tokens long, n_docs long, first_doc long, crc long"


def _counter(encoder, stride: int):
    """(part, n): how many sequences a task's documents make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(len(encoder.ids(text or "")) + 1 for batch in batches for text in batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([-(-total // stride)], pa.int64())], names=["part", "n"])

    return run


def _cutter(encoder, stride: int):
    """Sequences of a task's documents, compressed. n_docs: documents that begin in it; first_doc: the one it begins with or inside."""
    names, types = [x.split()[0] for x in SEQUENCES.split(", ")], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1).compress
        held = np.full(stride, encoder.pad, encoder.dtype)
        used, begun, first, rows, end = 0, 0, None, [], np.array([encoder.end], encoder.dtype)

        def emit():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            rows.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids, at = np.concatenate((encoder.ids(text or ""), end)), 0
                begun += 1
                while at < len(ids):
                    if used == 0:
                        first = doc
                    take = min(stride - used, len(ids) - at)
                    held[used : used + take] = ids[at : at + take]
                    used, at = used + take, at + take
                    if used == stride:
                        rows.append((part, k, stride, begun, first, pack(held.tobytes())))
                        k, used, begun = k + 1, 0, 0
                        if len(rows) == 1024:
                            yield emit()
        if used:
            held[used:] = encoder.pad
            rows.append((part, k, used, begun, first, pack(held.tobytes())))
        if rows:
            yield emit()

    return run


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def _name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _writer(folder: str, shard_rows: int, record: int):
    names = [x.split()[0] for x in PLACES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        now, out, temporary, unpack = None, None, "", zstandard.ZstdDecompressor().decompress

        def close():
            out.close()
            fs.move(temporary, f"{root}/{_name(now)}")

        for batch in batches:
            slots = batch.column("slot").to_numpy()
            shards, crcs = slots // shard_rows, []
            for slot, shard, ids in zip(slots.tolist(), shards.tolist(), batch.column("ids").to_pylist(), strict=True):
                if shard != now:
                    if out is not None:
                        close()
                    now, temporary = shard, f"{root}/.{_name(shard)}.{uuid.uuid4().hex}"
                    out, expected = fs.open_output_stream(temporary), shard * shard_rows
                ids = unpack(ids)
                if slot != expected or len(ids) != record:
                    raise ValueError(f"slot {slot} where {expected} was due")
                out.write(ids)
                expected += 1
                crcs.append(zlib.crc32(ids))
            yield pa.RecordBatch.from_arrays([batch.column("slot"), pa.array(shards, pa.int64()), pa.array((slots % shard_rows) * record, pa.int64()), batch.column("n_tokens"), batch.column("n_docs"), batch.column("first_doc"), pa.array(crcs, pa.int64())], names=names)
        if out is not None:
            close()

    return run


def materialise(docs: DataFrame, folder: str, encoder=ByteEncoder(), stride: int = STRIDE, key: int = KEY, shard_bytes: int = SHARD_BYTES) -> DataFrame:  # noqa: B008
    """Writes the shards of docs (doc_id, text) and meta.json into folder.

    Returns a row for each sequence: slot, shard, offset (bytes), n_tokens (without padding),
    n_docs, first_doc and the record's CRC-32. There is a shard for each shuffle partition at
    least, and more where they would be over shard_bytes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = rows.mapInArrow(_cutter(encoder, stride), SEQUENCES)
    parts = written(rows.mapInArrow(_counter(encoder, stride), "part int, n long"), "parts")  # a row for each task
    n = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0]["n"]
    record = stride * np.dtype(encoder.dtype).itemsize
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    shard_rows = max(1, -(-n // max(at_least, -(-n * record // shard_bytes))))
    n_shards = -(-n // shard_rows)

    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/meta.json") as out:
        out.write(json.dumps({"sequences": n, "stride": stride, "dtype": encoder.dtype, "end": encoder.end, "pad": encoder.pad, "key": key, "shard_rows": shard_rows, "shards": n_shards}).encode())
    if not n:
        return spark.createDataFrame([], PLACES)

    @pandas_udf("long")
    def slot_of(index):
        return type(index)(permuted(index.to_numpy(np.int64), n, key))

    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.coalesce(1).select("part", F.coalesce(before, F.lit(0)).alias("start"))
    placed = cut.join(starts, "part").withColumn("slot", slot_of(F.col("start") + F.col("k"))).drop("start", "part", "k")
    dealt = placed.repartitionById(n_shards, F.floor(F.col("slot") / shard_rows).cast("int")).sortWithinPartitions("slot")
    return written(dealt.mapInArrow(_writer(folder, shard_rows, record), PLACES), "places")


def read_slots(folder: str, start: int, count: int) -> np.ndarray:
    """Records start .. start + count - 1 as rows of ids; fewer at the end."""
    fs, root = filesystem(folder)
    with fs.open_input_file(f"{root}/meta.json") as f:
        meta = json.loads(f.read())
    record, out = meta["stride"] * np.dtype(meta["dtype"]).itemsize, []
    end = min(start + count, meta["sequences"])
    while start < end:
        shard, at = divmod(start, meta["shard_rows"])
        take = min(end - start, meta["shard_rows"] - at)
        with fs.open_input_file(f"{root}/{_name(shard)}") as f:
            f.seek(at * record)
            out.append(np.frombuffer(f.read(take * record), meta["dtype"]))
        start += take
    return np.concatenate(out).reshape(-1, meta["stride"]) if out else np.empty((0, meta["stride"]), meta["dtype"])


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Read as it lies: a task that runs again must see its rows in the same order.
    return materialise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), new_path(spark, "shards"))
