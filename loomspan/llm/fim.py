r"""Fill-in-middle: texts cut at two token ends and put together anew around sentinels.

A token is ``[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+``: white space stands before its
word, and alone at the end of a text. Both classes are told by single bytes of UTF-8, so a text
is one big integer with a bit for each byte: ``bytes.translate`` builds the mask of the white
space, a shift and two Boolean operations leave a bit at each token's last byte, ``bit_count``
gives the number of tokens, and halving the integer finds the bit of a given rank. Each step
takes time and memory that grow with the text's length, and no list of tokens is made.

The cuts and the form come from a hash of the key alone: the same in every run, however the
rows are dealt, and a lost task gives the same rows again. No row meets another: the plan has no
shuffle.

Defined cases: a null text is empty; an empty text, and one that holds a sentinel, stay as they
are (form ``plain``, no cuts); a null key is hashed as an empty one; repeated rows give equal
rows; a text of white space alone is one token; an empty table gives no rows; bytes that are no
UTF-8 are carried on. Columns of the input with the names of the operator's own (n, form,
prefix_chars, middle_chars, output) give way; all others are carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from loomspan.llm.common import fresh, table, yielding

SPACES = b"\t\n\x0b\x0c\r "
_SPACE_DIGITS = bytes(b"01"[b in SPACES] for b in range(256))
_INNER = bytes(range(0x80, 0xC0))  # bytes within a code point
#: Rows are handed back when their outputs have so many bytes.
EMIT_BYTES = 1 << 22


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = astuple(self)
        meet = any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b))))
        if meet or len(set(marks)) < 3 or any(a in b for a in marks for b in marks if a != b) or not all(marks):
            raise ValueError("an empty sentinel, one inside another, or one that ends as one begins: parts could not be told apart")


def token_ends(data: bytes) -> int:
    """A bit for each token, at the place of its last byte."""
    if not data:
        return 0
    space = int(data.translate(_SPACE_DIGITS)[::-1], 2)  # bit k: byte k is white space
    last = 1 << len(data) - 1
    word = (last << 1) - 1 ^ space
    return word & space >> 1 | last


def ranked_bit(mask: int, rank: int) -> int:
    """The place of the set bit with this rank, from 1 at the lowest: the half that holds it, again and again."""
    at, width = 0, mask.bit_length()
    while width > 1:
        half = width >> 1
        low = mask & (1 << half) - 1
        below = low.bit_count()
        if rank <= below:
            mask, width = low, half
        else:
            mask, rank, at, width = mask >> half, rank - below, at + half, width - half
    return at


def draws(key: int | str | None, seed: str) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 of a key, from the SHA-256 of seed, colon and key."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def code_points(data: bytes) -> int:
    return len(data.translate(None, _INNER))


def transformed(data: bytes, key, fim: int, spm: int, seed: str, marks: tuple[bytes, bytes, bytes]) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    ends, (h1, h2, h3, h4) = token_ends(data), draws(key, seed)
    n = ends.bit_count()
    if not data or h3 % 100 >= fim or any(m in data for m in marks):
        return n, "plain", None, None, data
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    begin, end = (ranked_bit(ends, k) + 1 if k else 0 for k in (low, high))
    prefix, middle, suffix = data[:begin], data[begin:end], data[end:]
    p, s, m = marks
    form, parts = ("spm", (s, suffix, p, prefix, m, middle)) if h4 % 100 < spm else ("psm", (p, prefix, s, suffix, m, middle))
    return n, form, code_points(prefix), code_points(middle), b"".join(parts)


OWN = (("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary()))


def _cutter(key: str, text: str, fim: int, spm: int, seed: str, marks: tuple[bytes, bytes, bytes]):
    def block(rows: pa.RecordBatch, made: list[tuple]) -> pa.RecordBatch:
        new = [pa.array(values, kind) for values, (_, kind) in zip(zip(*made, strict=True), OWN, strict=True)]
        new[-1] = new[-1].view(pa.string())
        kept = [c for c in rows.schema.names if c not in (key, text)]
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *new], names=[*kept, *(c for c, _ in OWN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(key), batch.column(text)
            begin, size, made = 0, 0, []
            for k in range(batch.num_rows):  # one text at a time is turned into bytes of Python's
                raw = texts[k].as_buffer() if texts[k].is_valid else None
                made.append(transformed(raw.to_pybytes() if raw is not None else b"", keys[k].as_py(), fim, spm, seed, marks))
                size += len(made[-1][-1])
                if size >= EMIT_BYTES:
                    yield block(batch.slice(begin, k + 1 - begin), made)
                    begin, size, made = k + 1, 0, []
            if made:
                yield block(batch.slice(begin), made)

    return run


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", fim: int = 50, spm: int = 80, seed: str = "42", sentinels: Sentinels | None = None) -> DataFrame:
    """docs with n (tokens), form, prefix_chars, middle_chars and output.

    Of 100 texts about fim are cut, and of 100 of these about spm have the suffix first.
    """
    marks = tuple(s.encode() for s in astuple(sentinels or Sentinels()))
    rows = yielding(docs, *(c for c, _ in OWN))
    own_key, own_text = fresh(rows, "key", "whole")
    given = rows.select("*", docs[key].cast("string").alias(own_key), docs[text].cast("string").alias(own_text))
    schema = StructType(list(rows.schema.fields))
    for name, kind in OWN:
        schema = schema.add(name, LongType() if kind == pa.int64() else StringType())
    return given.mapInArrow(_cutter(own_key, own_text, fim, spm, seed, marks), schema)


def restored(output: Column, form: Column, sentinels: Sentinels | None = None) -> Column:
    """The text that an output of this form was made from."""
    parts = F.split(output, "|".join(re.escape(m) for m in astuple(sentinels or Sentinels())), -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents", "doc_id", "text"))
    again = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
cut AS (SELECT doc_id, x, regexp_extract_all(x, '[\x09-\x0D\x20]*[^\x09-\x0D\x20]+|[\x09-\x0D\x20]+') AS u,
               ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM texts),
placed AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1))::BIGINT AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1))::BIGINT AS b,
                  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM placed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256
FROM parts"""
