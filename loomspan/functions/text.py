"""Text functions: normalising, segmenting, pattern hits, clauses. Columns in, columns out.

Offsets count code points from 0, end exclusive. Everything but the NFKC forms stays in the
JVM. A null text gives null, or an empty array. Places are sums of the lengths before them, which
``running`` takes in n log n steps, so the work on a text grows with its length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, reduce
from operator import or_

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

# White space as Unicode has it, characters without width, sentence ends.
SPACE = r"[\x09-\x0D\x20\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
NO_WIDTH = r"[\u200B-\u200D\u2060\uFEFF]"
END = "[.!?\u3002\uFF01\uFF1F]"
WORD = r"[\p{L}\p{N}_]"
_MAPPED = StructType().add("text", StringType()).add("starts", ArrayType(IntegerType())).add("ends", ArrayType(IntegerType()))
_FORMS = StructType().add("text", StringType()).add("starts", ArrayType(IntegerType())).add("ends", ArrayType(IntegerType())).add("plain", StringType())
_CUT = "\x03"
_INK = f"[^{SPACE[1:-1]}{NO_WIDTH[1:-1]}]"
# Behind a sentence end, but for a dot between two word characters; and blank lines.
_ENDS = f"[!?\u3002\uFF01\uFF1F]|\\.(?:(?<!{WORD}\\.)|(?!{WORD}))"
_GAP = "\n *\n[\n ]*"
_ODD_SPACE = r"[\x03\x09\x0B-\x0D\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: Texts of these characters alone are their own NFKC form, but for case and white space.
_STABLE = r"^[\x00-\x0C\x0E-\x7F\xA1-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0391-\u03CE\u0400-\u0481\u048A-\u052F\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF\uAC00-\uD7A3]*$"


#: Functions in Python take so many rows at a time, so their memory does not grow with a batch.
SLICE = 256


def sliced(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The batches of a column in slices of at most SLICE rows."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.slice(at, SLICE)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def holds_any(text: Column, words: Sequence[str]) -> Column:
    """Whether the text holds one of the words: found in its bytes, far cheaper than by an expression."""
    return reduce(or_, (F.contains(text, F.lit(w)) for w in words))


def squeezed(text: Column) -> Column:
    """Lower case, characters without width dropped, white space runs as one space, trimmed."""
    plain = F.regexp_replace(F.lower(text), NO_WIDTH, "")
    # A space that stands alone is left as it is: most do.
    return F.trim(F.regexp_replace(plain, f"{SPACE}(?:(?<! )|{SPACE}){SPACE}*", " "))


_SPACES, _NO_WIDTH, _OTHER_SPLITS = re.compile(f"{SPACE}+"), re.compile(NO_WIDTH), re.compile("[\x1c-\x1f\x85]")


def _squeezed(lower: str) -> str:
    plain = lower if lower.isascii() else _NO_WIDTH.sub("", lower)
    # Apart from these few controls Python splits at the same white space.
    return _SPACES.sub(" ", plain).strip(" ") if _OTHER_SPLITS.search(plain) else " ".join(plain.split())


@F.arrow_udf(StringType())
def squeezed_nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``squeezed`` after NFKC; for texts with compatibility forms (ASCII texts need none)."""
    for texts in sliced(batches):
        yield pa.array([None if t is None else _squeezed(unicodedata.normalize("NFKC", t).lower()) for t in texts.to_pylist()], pa.string())


def levelled(text: Column) -> Column:
    """Lower case with every white-space character but the line feed as a space; as long as the text.

    The few characters whose lower case is longer stay as they are; so does no control character
    that the cutting of texts uses.
    """
    return F.regexp_replace(F.lower(F.replace(text, F.lit("\u0130"), F.lit("I"))), _ODD_SPACE, " ")


def running(xs: Column, step: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """The sums (or another step's results) of an array up to each place: passes of doubling reach."""

    def further(done: Column, k: Column) -> Column:
        reach = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(done, lambda x, i: F.when(i >= reach, step(F.get(done, i - reach), x)).otherwise(x))

    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.size(xs))).cast("int") - 1)
    return F.when(F.size(xs) <= 1, xs).otherwise(F.aggregate(passes, xs, further))


@lru_cache(maxsize=65536)
def _piece(c: str) -> str:
    if c.isspace() or c == _CUT:
        return " "
    return "".join(x for x in unicodedata.normalize("NFKC", c).lower() if x not in "\u200b\u200c\u200d\u2060\ufeff")


def _mapped(t: str) -> tuple[str, list[int], list[int]]:
    out, starts, ends, i = [], [], [], 0
    while i < len(t):
        c, at = t[i], i
        i += 1
        if c == "\r":
            i += t[i : i + 1] == "\n"
            piece = "\n"
        elif c == "\n":
            piece = "\n"
        else:
            piece = _piece(c)
        out.append(piece)
        starts += [at] * len(piece)
        ends += [i] * len(piece)
    return "".join(out), starts, ends


@pandas_udf(_MAPPED)
def levelled_with_map(texts: pd.Series) -> pd.DataFrame:
    """Each character's NFKC in lower case, line ends as line feeds, other spaces as spaces, and
    no characters without width; starts and ends give each new character's place in the text."""
    return pd.DataFrame([_mapped(t or "") for t in texts], columns=["text", "starts", "ends"])


_STABLE_TEXT, _ODD = re.compile(_STABLE), re.compile(_ODD_SPACE)
_ODD_ASCII = {ord(c): " " for c in "\x03\t\x0b\x0c\r"}


def forms_of(t: str) -> tuple[str, list[int] | None, list[int] | None, str]:
    """(levelled, starts, ends, squeezed), as ``levelled`` and ``squeezed`` give them, or after NFKC
    where it may change the text; starts and ends are None where the levelled text's places are the text's."""
    if not (t.isascii() and "\r" not in t or _STABLE_TEXT.match(t)):
        return *_mapped(t), _squeezed(unicodedata.normalize("NFKC", t).lower())
    low = t.lower()
    if low.isascii() and t.isascii():
        return low.translate(_ODD_ASCII), None, None, _squeezed(low)
    return _ODD.sub(" ", t.replace("\u0130", "I").lower()), None, None, _squeezed(low)


@F.arrow_udf(_FORMS)
def normal_forms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``levelled_with_map`` and, as plain, ``squeezed_nfkc``; null for a null."""
    kind = pa.struct([("text", pa.string()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("plain", pa.string())])
    for texts in sliced(batches):
        rows = [None if t is None else (*_mapped(t), _squeezed(unicodedata.normalize("NFKC", t).lower())) for t in texts.to_pylist()]
        yield pa.array([r and dict(zip(("text", "starts", "ends", "plain"), r, strict=True)) for r in rows], kind)


def unstable(text: Column) -> Column:
    """The text where NFKC may change it or its line ends, else null: the others need no Python."""
    return F.when(~text.rlike(_STABLE), text)


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


# ---- segments ----------------------------------------------------------------------------


def sentences(text: Column) -> Column:
    """array<struct<text, start, end, par>>: cut behind sentence ends, a dot between two word
    characters excepted, and at blank lines, which par counts; blank pieces are no sentences."""
    marked = F.regexp_replace(F.regexp_replace(text, _ENDS, f"$0{_CUT}"), _GAP, f"{_CUT}$0{_CUT}")
    gap = 1 << 40  # a place and the count of blank lines before it, in one number

    def rows(raw: Column) -> Column:
        sizes = F.transform(raw, lambda p: F.length(p) + F.when(p.rlike("^\n *\n"), F.lit(gap)).otherwise(F.lit(0).cast("long")))

        def placed(ends: Column) -> Column:
            at = lambda e: e.bitwiseAND(F.lit(gap - 1)).cast("int")
            every = F.transform(raw, lambda p, i: let(F.get(ends, i), lambda e: F.struct(p.alias("text"), (at(e) - F.length(p)).alias("start"), at(e).alias("end"), F.shiftright(e, 40).cast("int").alias("par"))))
            return F.filter(every, lambda s: s["text"].rlike(_INK))

        return let(running(sizes), placed)

    return F.coalesce(let(F.split(marked, _CUT), rows), F.array().cast("array<struct<text:string,start:int,end:int,par:int>>"))


_WINDOW = ("pair", "text", "start", "end", "cut", "prev", "next")


def windows(found: Column) -> Column:
    """Each sentence, and each two neighbours of one paragraph, in order.

    idx counts windows; cut is the first sentence's end inside the window (pairs only); prev and
    next are the sentences of the paragraph beside a single one, for the guard's wider scopes.
    """

    def around(xs: Column, s: Column, i: Column) -> Column:
        other = lambda d: F.when(F.get(xs, i + d)["par"] == s["par"], F.get(xs, i + d))
        size, none = (s["end"] - s["start"]).alias("cut"), F.lit(None).cast("string")
        single = F.struct(F.lit(False).alias("pair"), s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"), size, other(-1)["text"].alias("prev"), other(1)["text"].alias("next"))
        # Nothing stands between two sentences of one paragraph.
        both = F.struct(F.lit(True).alias("pair"), F.concat(s["text"], other(1)["text"]).alias("text"), s["start"].alias("start"), other(1)["end"].alias("end"), size, none.alias("prev"), none.alias("next"))
        return F.filter(F.array(single, both), lambda w: w["end"].isNotNull())

    def every(xs: Column) -> Column:
        flat = F.flatten(F.transform(xs, lambda s, i: around(xs, s, i)))
        return F.transform(flat, lambda w, i: F.struct(i.alias("idx"), *(w[c].alias(c) for c in _WINDOW)))

    # Bound once: a filter that is pushed below may otherwise evaluate it for each sentence.
    return let(found, every)


# ---- patterns ----------------------------------------------------------------------------


def literal_regex(pattern: str, suffixes: tuple[str, ...] = ()) -> str | None:
    """A literal with loose white space between its words, where words begin and end; None
    if it has less than two characters. One of the suffixes may follow."""
    plain = re.sub(f"{SPACE}+", " ", unicodedata.normalize("NFKC", pattern).lower()).strip()
    if len(plain) < 2:
        return None
    first, *more = (re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", w) for w in plain.split(" "))
    tail = "(?:" + "|".join(sorted(suffixes, key=len, reverse=True)) + ")?" if suffixes else ""
    # The first word stands first and looks back over itself: a search for it is the fastest.
    return f"{first}(?<!{WORD}{first})" + "".join(f"{SPACE}*{w}" for w in more) + f"(?={tail}(?!{WORD}))"


#: Classes that Java reads as ASCII alone, outside and inside of brackets.
_ASCII = {"w": ("[a-zA-Z0-9_]", "a-zA-Z0-9_"), "d": ("[0-9]", "0-9"), "s": (r"[ \t\n\x0B\f\r]", r" \t\n\x0B\f\r"), "W": ("[^a-zA-Z0-9_]", None), "D": ("[^0-9]", None), "S": (r"[^ \t\n\x0B\f\r]", None)}


@lru_cache(maxsize=65536)
def compiled(expression: str) -> regex.Pattern:
    """A Java expression for tasks: classes that Java takes as ASCII are spelled out."""
    out, k, inside = [], 0, False
    while k < len(expression):
        c = expression[k]
        if c == "\\" and k + 1 < len(expression):
            new = _ASCII.get(expression[k + 1], (None, None))[inside]
            if inside and new is None and expression[k + 1] in "WDS":
                raise ValueError(f"a negated class in brackets: {expression}")
            out.append(new or expression[k : k + 2])
            k += 2
            continue
        inside = (inside or c == "[") and not (inside and c == "]")
        out.append(c)
        k += 1
    try:
        return regex.compile("".join(out))
    except regex.error as bad:
        raise ValueError(f"an expression that only one of the two engines takes: {expression}") from bad


def _runs(expression: str) -> bool:
    """Whether the tasks' engine takes the expression, and it does not match the empty text."""
    try:
        return compiled(expression).search("") is None
    except ValueError:
        return False


def pattern_regex(pattern: str, suffixes: tuple[str, ...] = ()) -> str | None:
    """The Java expression of a rule's pattern: a literal, or an expression behind ``re:``; None for
    one that is dead: too short, of bad syntax, or matching the empty text."""
    if not pattern.startswith("re:"):
        return literal_regex(pattern, suffixes)
    found = "(?iu)" + pattern[3:]
    return found if _runs(found) else None


def hit_spans(text: Column, regex: str | Column) -> Column:
    """array<struct<start, end>> of all matches that are not empty.

    Matches are marked and the text is cut at the marks: every second piece is a match, and it
    begins where the lengths before it end.
    """

    def spans(parts: Column) -> Column:
        def placed(ends: Column) -> Column:
            every = F.transform(ends, lambda e, i: F.struct(F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("start"), e.alias("end"), (i % 2 == 1).alias("hit")))
            return F.transform(F.filter(every, lambda h: h["hit"] & (h["end"] > h["start"])), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end")))

        none = F.array().cast("array<struct<start:int,end:int>>")
        return F.when(F.size(parts) > 1, let(running(F.transform(parts, lambda p: F.length(p))), placed)).when(parts.isNotNull(), none)

    marked = F.regexp_replace(F.replace(text, F.lit(_CUT), F.lit(" ")), regex, F.lit(f"{_CUT}$0{_CUT}") if isinstance(regex, Column) else f"{_CUT}$0{_CUT}")
    return let(F.split(marked, _CUT), spans)


def clause(text: Column, start: Column, end: Column, markers: str) -> Column:
    """(start, end) of the clause around a stretch: between the nearest markers on both sides."""

    def cut(found: Column) -> Column:
        before = F.array_max(F.transform(F.filter(found, lambda m: m["end"] <= start), lambda m: m["end"]))
        after = F.array_min(F.transform(F.filter(found, lambda m: m["start"] >= end), lambda m: m["start"]))
        return F.struct(F.coalesce(before, F.lit(0)).alias("start"), F.coalesce(after, F.length(text)).alias("end"))

    return let(hit_spans(text, markers), cut)


# ---- small scalars -----------------------------------------------------------------------


def draft_tokens(text: Column) -> Column:
    """Words of two characters and more for a draft rule."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}%·.]+"), lambda w: F.length(w) >= 2)


def score_range(text: Column) -> Column:
    """(low, high) of ``A-B``; nulls where it is none."""
    part = lambda k: F.try_to_number(F.nullif(F.regexp_extract(text, r"^\s*([0-9]+)\s*-\s*([0-9]+)\s*$", k), F.lit("")), F.lit("999999999")).cast("int")
    return F.struct(part(1).alias("low"), part(2).alias("high"))


def utf16_key(text: Column) -> Column:
    """A key whose order is that of UTF-16 code units: characters beyond the BMP come before U+E000."""
    return F.encode(text, "UTF-16BE")


def locale_key(text: Column) -> Column:
    """A key whose order is the root collation's: letters by alphabet, then accents, then case."""
    return F.collate(text, "UNICODE")


def compact_time(at: Column) -> Column:
    return F.date_format(at, "yyyyMMddHHmmss")


def is_web_url(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False))


def contains_any(query: str, *fields: Column) -> Column:
    """Whether the fields together hold the query, whatever its case."""
    return F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(query.strip().lower()))
