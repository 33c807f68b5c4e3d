"""Language identification by hyperdimensional profiles.

Each letter has a random vector of plus and minus ones; an n-gram is the product of its
letters' vectors, permuted by their place; a text is the sum of its n-grams; a language is
the sum of its learning texts at unit length. A text gets the language of greatest cosine.

Defined cases: a null text, or one without letters, is ``und`` with score 0, as is every
text where nothing could be learned; null languages are not learned from, nor are languages beyond
the MAX_LANGS most frequent; of equal cosines the first language by name counts; whole texts of any
length are read, in blocks of documents that bound the memory; repeated rows each give a row; an
empty table gives no rows; columns named in ``keep`` are carried as they are, others ignored, and one
that bears the name of an output column gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import fresh, table

UNKNOWN = "und"
DIMS = 1024
GRAM = 3
#: So many languages at most are learned, the most frequent ones, as their profiles are sent to every task.
MAX_LANGS = 1000
#: A text of this cosine is never unlike its language, whatever its length.
MOST_BOUND = 0.2
#: A class of lengths is judged by so many held-out labelled documents of a language at least.
LEAST_SEEN = 50
_SEED = 20240611
_BLOCK_DOCS, _BLOCK_GRAMS = 128, 1 << 21
#: So many rows of a batch have their vectors in memory at a time.
_SLICE = 1024
_SCALE = 1 << 24


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=8192)
def _letter_vector(code: int, dims: int) -> np.ndarray:
    return np.random.default_rng([_SEED, code]).integers(0, 2, dims, dtype=np.int8) * 2 - 1


def _grams(text: str) -> np.ndarray:
    """Packed n-grams of lower-cased words; white space, digits and signs are one gap."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[codes]
    if not is_letter.any():
        return np.empty(0, np.uint64)
    before = np.concatenate(([False], is_letter[:-1]))
    codes = np.where(is_letter, codes, 32)[is_letter | before]
    codes = np.concatenate(([32], codes, [32])).astype(np.uint64)
    return codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]


def _gram_vectors(grams: np.ndarray, dims: int) -> np.ndarray:
    mask, out = np.uint64((1 << 21) - 1), None
    for place in range(GRAM):
        codes, at = np.unique((grams >> np.uint64(21 * (GRAM - 1 - place))) & mask, return_inverse=True)
        vectors = np.stack([np.roll(_letter_vector(int(c), dims), GRAM - 1 - place) for c in codes])[at]
        out = vectors if out is None else out * vectors
    return out.astype(np.float32)


def _unit_vectors(texts: list[str | None], dims: int, sizes: np.ndarray | None = None) -> np.ndarray:
    """A unit vector for each text; zeros for a text without letters. sizes gets the counts of unlike n-grams."""
    out = np.zeros((len(texts), dims), np.float32)
    at, size, rows = [], 0, []

    def block():
        if not rows:
            return
        grams, where = np.unique(np.concatenate([g for g, _ in rows]), return_inverse=True)
        counts = np.zeros((len(rows), len(grams)), np.float32)
        ends = np.cumsum([len(g) for g, _ in rows])
        for k, (g, n) in enumerate(rows):
            counts[k, where[ends[k] - len(g) : ends[k]]] = n
        bundle = counts @ _gram_vectors(grams, dims)
        norm = np.linalg.norm(bundle, axis=1, keepdims=True)
        out[at] = bundle / np.where(norm > 0, norm, 1)
        rows.clear()
        at.clear()

    for i, text in enumerate(texts):
        found = _grams(text) if text else ()
        if len(found):
            rows.append(np.unique(found, return_counts=True))
            if sizes is not None:
                sizes[i] = len(rows[-1][0])
            at.append(i)
            size += len(rows[-1][0])
            if len(rows) == _BLOCK_DOCS or size > _BLOCK_GRAMS:
                block()
                size = 0
    block()
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            yield batch.slice(at, _SLICE)


def learn(docs: DataFrame, dims: int = DIMS, max_langs: int = MAX_LANGS) -> tuple[list[str], np.ndarray]:
    """Languages and their profiles, from all labelled documents that are not held out.

    The partial sums are whole numbers, so their order does not matter.
    """
    labelled = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    counts = [r["lang"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()]
    if not counts:
        return [], np.zeros((0, dims), np.float32)
    langs = sorted(counts)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in _sliced(batches):
            vectors = _unit_vectors(batch.column("text").to_pylist(), dims)
            names = np.array(batch.column("lang").to_pylist(), dtype=object)
            for name in set(names):
                sums[name] = sums.get(name, 0) + np.rint(vectors[names == name].astype(np.float64) * _SCALE).astype(np.int64).sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "part"])

    parts = labelled.where(F.col("lang").isin(*langs)).select("lang", "text").mapInArrow(partial, "lang string, part array<long>")
    sums = parts.select("lang", F.posexplode("part").alias("dim", "x")).groupBy("lang", "dim").agg(F.sum("x").alias("x"))
    profiles = np.zeros((len(langs), dims))
    for r in sums.collect():  # languages times dims, whatever the size of the corpus
        profiles[langs.index(r["lang"]), r["dim"]] = r["x"]
    norm = np.linalg.norm(profiles, axis=1, keepdims=True)
    return langs, (profiles / np.where(norm > 0, norm, 1)).astype(np.float32)


def least_scores(docs: DataFrame, langs: list[str], profiles: np.ndarray) -> dict[str, dict[int, float]]:
    """By language and class of lengths, the score below which a text is like no learned language.

    A class is a power of two of unlike n-grams. Its bound is half of what 99 in 100 held-out
    labelled documents of that language and class reach, so script and length set it, and
    MOST_BOUND at most; a class where unrelated texts reach that too (three deviations of the
    cosine of random vectors), or with few such documents, has none. All of these documents are
    scored; their scores are counted in steps of 0.00001, so a class has a bounded number of rows.
    """
    known = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").where(F.col("lang").isin(*langs) & F.col("text").isNotNull() & held_out(F.col("doc_id"))) if langs else docs.limit(0)
    scored = predict(known, langs, profiles, ("lang",), sized=True).where("lang = lang_pred")
    steps = scored.groupBy("lang", F.floor(F.log2("n_grams")).cast("int").alias("class"), F.round("score", 5).alias("score")).agg(F.count("*").alias("n"))
    classes = steps.groupBy("lang", "class").agg(F.sum("n").alias("n"), F.expr("percentile(score, 0.01, n)").alias("low"))
    least: dict[str, dict[int, float]] = {}
    for r in classes.collect():  # languages times at most 40 classes
        if r["n"] >= LEAST_SEEN and r["low"] / 2 >= 3 / profiles.shape[1] ** 0.5:
            least.setdefault(r["lang"], {})[r["class"]] = min(MOST_BOUND, r["low"] / 2)
    return least


def fits(lang: str, score: float, n_grams: int, least: dict[str, dict[int, float]]) -> bool:
    """Whether a text is like its language as far as its length tells; a longer class without a
    bound takes that of the next shorter one, and a text shorter than any is kept."""
    bounds = least.get(lang, {})
    at = max((c for c in bounds if 1 << c <= n_grams), default=None)
    return at is None or score >= bounds[at]


def predict(docs: DataFrame, langs: list[str], profiles: np.ndarray, keep: tuple[str, ...] = ("doc_id",), sized: bool = False, least: dict | None = None) -> DataFrame:
    """The columns of keep, lang_pred and score (the cosine, 0 at least) for every document; with
    sized also n_grams, with least (of ``least_scores``) also whether the text fits."""
    keep = tuple(c for c in keep if c.lower() not in ("lang_pred", "score", "n_grams", "fits"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    names, texts = np.array([*langs, UNKNOWN], dtype=object), "text" in keep
    more = [("n_grams", "long")] * sized + [("fits", "boolean")] * (least is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            sizes = np.zeros(batch.num_rows, np.int64)
            vectors = _unit_vectors(batch.column(batch.num_columns - 1).to_pylist(), profiles.shape[1], sizes)
            best, score = np.full(len(vectors), len(langs)), np.zeros(len(vectors))
            if len(langs) and len(vectors):
                cos = vectors @ profiles.T
                known = np.abs(vectors).sum(axis=1) > 0
                best[known] = cos.argmax(axis=1)[known]
                score[known] = np.clip(cos.max(axis=1)[known], 0, 1)
            extra = [pa.array(sizes)] * sized
            if least is not None:
                extra.append(pa.array([fits(x, y, n, least) for x, y, n in zip(names[best], score, sizes, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: batch.num_columns - 1], pa.array(names[best], pa.string()), pa.array(score.astype(np.float64)), *extra], names=[*keep, "lang_pred", "score", *(c for c, _ in more)])

    return docs.select(*keep, F.col("text").cast("string").alias("text" if not texts else fresh(docs, "text")[0])).mapInArrow(run, ", ".join([schema, "lang_pred string, score double", *(f"{c} {t}" for c, t in more)]))


def identify(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), **limits) -> DataFrame:
    """Learns from docs and predicts the language of each of them."""
    return predict(docs, *learn(docs, **limits), keep=keep)


def identify_fitting(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``identify`` with the column fits."""
    langs, profiles = learn(docs)
    return predict(docs, langs, profiles, keep, least=least_scores(docs, langs, profiles))


def op6_hd_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return identify(docs).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
