"""Personal data: exact patterns, and a semi-Markov conditional random field beside them.

The field scores whole candidate spans by features of the span, its edges and the words
before it, and the kinds of spans that follow each other closely; dynamic programming over
(end, kind) picks boundaries and kinds at once. It adds what the patterns leave out (secrets,
numbers without a plus sign, spelled-out addresses); a pattern's span always stays, and no
added span overlaps one.

The weights are fitted here, by likelihood, on generated examples (``examples``): a few
hundred lines of PII and of look-alikes, from a fixed seed. What a kind's form excludes is no
candidate for it: a card number must pass Luhn, digits and separators alone have 7 to 20 digits in 7
groups at most. Texts are decoded as they are read: what is held is the ends of the last few tokens
and the spans chosen so far, so the memory does not grow with the candidates of a digit-dense text.

Defined cases: a null or empty text has no spans; whole texts are read, of any length; spans count
code points, end exclusive; of equal segmentations the one whose last span ends earlier, then starts earlier, counts;
repeated rows each give a row; an empty table gives no rows; a null doc_id is a value like others;
other columns are ignored by ``find_pii`` and carried as they are, whatever their names, by ``mask_pii``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice, takewhile
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import table

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
# A run of digits is tried from its start alone: from inside it the rest would fail alike.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four patterns, leftmost and without overlap within a kind, in order."""
    found: list[tuple[str, int, int]] = []
    end = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            end = m.end()
            found.append(("email", start, end))
    for m in _IP.finditer(text):
        parts = [g.lstrip("0") for g in m.groups()]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


# ---- the field -----------------------------------------------------------------------

#: A span has at most so many tokens and characters, but for announced values and issued keys, which have any number.
MAX_TOKENS, MAX_CHARS = 16, 96
_TOKEN = re.compile(r"[A-Za-z0-9]+|\s|[^\sA-Za-z0-9]")
_ANCHOR = re.compile(r"[0-9]{2}|@|(?i:\bdot\b)")
_LONG = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{12,}")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|-)*")
_MARGIN = MAX_CHARS
# Words before a span, by what they announce.
_CUES = {
    "phone": frozenset("tel telephone phone call fax mobile cell ring tél téléphone telefon teléfono".split()),
    "email": frozenset("mail email e-mail contact write reach".split()),
    "ip": frozenset("ip host server address addr".split()),
    "card": frozenset("card visa mastercard amex credit iban".split()),
    "secret": frozenset("password passwd pwd token secret key apikey api-key passphrase".split()),
}
# What announces a secret's value, with the sign between; the value starts where the match ends.
_OPENER = re.compile(
    r"(?:(?<![A-Za-z])(?i:password|passwd|passphrase|pwd|token|secret|key|(?:api|access|secret|private|auth)[_-]?(?:key|token))|(?<=[a-z])(?:Password|Passphrase|Pwd|Token|Secret|Key))"
    r"(?:[_-][A-Za-z]+){0,2}[\"']?[ \t]{0,3}(?:=>|:=|={1,2}|:|(?<=[ \t])is(?=[ \t]))[ \t]{0,3}(?P<quote>[\"'`]?)(?=[^\s\"'`])"
)
_OPENER_PARTS = ("pass", "pwd", "token", "secret", "key")
_PASS = re.compile(r"(?i)pass|pwd")
_VALUE = re.compile(r"\S+")
# What issued keys begin with.
_ISSUED = re.compile(r"(?:AKIA|ASIA|AIza|gh[opsu]_|glpat-|sk[-_]|xox[abp]-|eyJ)[A-Za-z0-9]")
_ISSUED_KEY = re.compile(rf"(?<![A-Za-z0-9]){_ISSUED.pattern}[A-Za-z0-9_.+/=-]{{14,}}(?<![.+/=-])")
#: A span's kind depends on that of the span before it if so many tokens at most lie between.
GAP = 3
#: What a value that was announced and found to be a secret scores more than its parts: it is masked as one.
_AS_ONE = 1000.0
_SHAPES = (
    "bias", "digits0", "digits1_6", "digits7_9", "digits10_12", "digits13_15", "digits16_19", "digits20", "at_sign", "at_word", "dot_words", "dotted4", "dotted4_ok", "luhn",
    "plus", "paren", "separators_only", "plain_digits", "letters", "one_token", "long_token", "mixed_token", "hex_token", "upper_token", "bad_edge", "glued_left", "glued_right",
    "newline", "spaces", "group334", "group444", "tld", "iso_date", "short", "opened", "opened_whole", "opened_pass", "opened_word", "opened_long", "marked", "issued", "caps_word", "in_run", *(f"cue_{k}" for k in _CUES),
)
_DATE, _HEX, _DIGITS = re.compile(r"[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}"), re.compile(r"[0-9a-f]+"), re.compile(r"[0-9]+")
_AT_WORD, _DOT_WORDS = re.compile(r"\w[ \[({]+at[ \])}]+\w", re.I), re.compile(r"\w[ \[({]+dot[ \])}]+\w", re.I)
_DOTTED, _SEPARATED = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)"), re.compile(r"[+(]?[0-9][0-9 ().-]*")
_TLD = re.compile(r"(?:\.|dot[ \])}]+)[A-Za-z]{2,6}\Z")
#: Digits and separators alone are a candidate with so many digits and groups of digits.
LEAST_DIGITS, MOST_DIGITS, MOST_GROUPS = 7, 20, 7
_AT = {name: k for k, name in enumerate(_SHAPES)}


def _is_mixed(token: str) -> bool:
    """A long token that is no word: letters with digits, capitals alone, or capitals inside."""
    if token.isdigit() or not token.isalpha():
        return True
    return len(token) >= 16 and (token.isupper() or len(token) >= 20 and not (token[1:].islower()))


def _openers(text: str, at: int = 0, end: int | None = None) -> dict[int, tuple[int, bool]]:
    """Where announced values and issued keys start: their end, and whether a password was announced.

    A value goes to its closing quote, or else to white space without the signs that end a clause;
    an issued key announces itself, and goes as far as its signs do.
    """
    end = len(text) if end is None else end
    lower = text[at:end].lower()
    found = {}
    for m in _OPENER.finditer(text, at, end) if any(x in lower for x in _OPENER_PARTS) else ():
        start, quote = m.end(), m["quote"]
        line = text.find("\n", start) if quote else -1
        stop = text.find(quote, start, len(text) if line < 0 else line) if quote else -1
        if stop < 0:
            stop = _VALUE.match(text, start).end()
            while stop > start + 1 and text[stop - 1] in "\"'`,.;:)]}":
                stop -= 1
        found[start] = (stop, bool(_PASS.search(m[0])))
    for m in _ISSUED_KEY.finditer(text, at, end):
        if any(c.isdigit() for c in m[0]):
            found.setdefault(m.start(), (m.end(), False))
    return found


def _features(text: str, start: int, end: int, cues: list[str], opener: tuple[int, bool] | None = None) -> np.ndarray:
    """The features of text[start:end] with what stands beside it."""
    s = text[start:end]
    left = start > 0 and (text[start - 1].isalnum() or text[start - 1] in "@_") and s[0].isalnum()
    right = end < len(text) and (text[end].isalnum() or text[end] == "@" or text[end] in ".-" and end + 1 < len(text) and text[end + 1].isalnum())
    told = opener is not None
    run = start > 1 and text[start - 1] == " " and text[start - 2].isdigit() or end + 1 < len(text) and text[end] == " " and text[end + 1].isdigit()
    return _row(s, left, right, run, tuple(cues), told, told and opener[0] == end, told and opener[1])


@lru_cache(maxsize=1 << 14)
def _row(s: str, left: bool, right: bool, run: bool, cues: tuple[str, ...], opened: bool, whole: bool, is_pass: bool) -> np.ndarray:
    n_digits = sum("0" <= c <= "9" for c in s)
    letters = any(c.isalpha() for c in s)
    one = s.isalnum()
    on = {
        "bias": True,
        "digits0": n_digits == 0,
        "digits1_6": 1 <= n_digits <= 6,
        "digits7_9": 7 <= n_digits <= 9,
        "digits10_12": 10 <= n_digits <= 12,
        "digits13_15": 13 <= n_digits <= 15,
        "digits16_19": 16 <= n_digits <= 19,
        "digits20": n_digits >= 20,
        "plus": s[0] == "+",
        "paren": s[0] == "(" and ")" in s,
        "one_token": one,
        "long_token": one and len(s) >= 16,
        "bad_edge": not (s[0].isalnum() or s[0] in "+(") or not s[-1].isalnum(),
        "glued_left": left,
        "glued_right": right,
        "in_run": run,
        "newline": "\n" in s,
        "spaces": s.count(" ") > 4,
        "iso_date": _DATE.match(s) is not None,
        "short": len(s) < 7,
        "opened": opened,
        "opened_whole": whole,
        "opened_pass": is_pass,
        "opened_long": whole and len(s) >= 20 and n_digits > 0 and letters and not any(c.isspace() for c in s),
        "opened_word": opened and all(c.isalpha() or c in " '-" for c in s),
    }
    if letters:
        on |= {
            "letters": True,
            "at_sign": s.count("@") == 1 and 0 < s.index("@") < len(s) - 1,
            "at_word": _AT_WORD.search(s) is not None,
            "dot_words": _DOT_WORDS.search(s) is not None,
            "mixed_token": one and n_digits >= 3 and len(s) >= 12,
            "hex_token": one and n_digits >= 3 and len(s) >= 16 and _HEX.fullmatch(s) is not None,
            "upper_token": one and len(s) >= 16 and s == s.upper(),
            "tld": _TLD.search(s) is not None,
            "marked": not one and any(not c.isalnum() and not c.isspace() for c in s),
            "issued": len(s) >= 16 and _ISSUED.match(s) is not None,
            "caps_word": one and n_digits == 0 and s.isupper(),
        }
    else:
        groups = [len(g) for g in _DIGITS.findall(s)]
        dotted = _DOTTED.fullmatch(s) if s.count(".") == 3 else None
        on |= {
            "dotted4": dotted is not None,
            "dotted4_ok": dotted is not None and all(len(p) <= 3 and int(p) <= 255 for p in dotted.groups()),
            "luhn": 13 <= n_digits <= 19 and luhn("".join(c for c in s if "0" <= c <= "9")),
            "separators_only": len(groups) > 1 and _SEPARATED.fullmatch(s) is not None,
            "plain_digits": len(groups) == 1 and s.isdigit(),
            "group334": groups[-3:] == [3, 3, 4],
            "group444": len(groups) > 1 and all(g == 4 for g in groups),
        }
    row = np.zeros(len(_SHAPES))
    row[[_AT[name] for name, value in on.items() if value]] = 1
    for kind, words in _CUES.items():
        if not words.isdisjoint(cues) or kind == "secret" and opened:
            row[_AT[f"cue_{kind}"]] = 1
    return row


#: So many candidates are scored at once.
_BLOCK = 512
#: A region is cut at the first line feed behind so many characters.
_PIECE = 1 << 16


def _candidates(text: str, at: int, end: int, taken: list[tuple[int, int]], tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, last + 1, features) of the candidate spans of the tokens of text[at:end], by first token."""
    opened = _openers(text, max(0, at - MAX_CHARS), end)
    # Every anchor lies in one token; after[i] is the first token from i on that holds one.
    after = [len(tokens)] * (len(tokens) + 1)
    for i in range(len(tokens) - 1, -1, -1):
        a, b = tokens[i]
        after[i] = i if _ANCHOR.search(text, a, b) or b - a >= 12 and _is_mixed(text[a:b]) else after[i + 1]
    ends = [stop for _, stop in tokens]
    low = 0  # taken spans before it end before every later start
    for i, (start, _) in enumerate(tokens):
        opener = opened.get(start)
        if opener is None and (after[i] >= i + MAX_TOKENS or not (text[start].isalnum() or text[start] in "+(")):
            continue
        while low < len(taken) and taken[low][1] <= start:
            low += 1
        cues, n_digits, n_groups, plain = None, 0, 0, True
        # An announced value may have more tokens: any string of signs does.
        for j in range(i, len(tokens) if opener else min(i + MAX_TOKENS, len(tokens))):
            first, stop = tokens[j]
            if stop - start > MAX_CHARS or text[first] == "\n":
                break
            token = text[first:stop]
            if token.isdigit():
                n_digits, n_groups = n_digits + len(token), n_groups + 1
            elif plain and any(c.isalpha() for c in token):
                plain = False
            whole = opener is not None and stop == opener[0]
            if opener is not None and j >= i + MAX_TOKENS and not whole:
                continue
            if plain and opener is None and not (LEAST_DIGITS <= n_digits <= MOST_DIGITS and n_groups <= MOST_GROUPS):
                continue
            if not (text[stop - 1].isalnum() or whole) or low < len(taken) and taken[low][0] < stop:
                continue
            if after[i] > j and opener is None:
                continue
            if cues is None:
                cues = [w.lower() for w in _WORD.findall(text[max(0, start - 24) : start])[-2:]]
            yield i, j + 1, _features(text, start, stop, cues, opener)
        if opener is not None and opener[0] - start > MAX_CHARS and not (low < len(taken) and taken[low][0] < opener[0]):
            j = bisect_left(ends, opener[0])
            if j < len(ends) and ends[j] == opener[0]:
                yield i, j + 1, _features(text, start, opener[0], [w.lower() for w in _WORD.findall(text[max(0, start - 24) : start])[-2:]], opener)


class Field(NamedTuple):
    """Weights by (feature, kind), and by (kind of the span before, kind)."""

    weights: np.ndarray
    moves: np.ndarray


def _scored(text: str, at: int, end: int, taken: list[tuple[int, int]], tokens: list[tuple[int, int]], field: Field) -> Iterator[tuple[int, int, int, float]]:
    """(first, last + 1, kind, score) of the candidates, by first token, without those that no segmentation gains from."""
    held: list[tuple[int, int, np.ndarray]] = []
    # A span left out costs its score and the moves to and from it, and gives its neighbours the least move at worst.
    most = np.maximum(field.moves.max(0), 0) + np.maximum(field.moves.max(1), 0) - min(0.0, float(field.moves.min()))

    def block():
        scores = np.array([r for _, _, r in held]) @ field.weights
        scores[:, KINDS.index("card")] = np.where([r[_AT["luhn"]] == 1 for _, _, r in held], scores[:, KINDS.index("card")], -np.inf)
        secret = KINDS.index("secret")
        scores[:, secret] += np.where([r[_AT["opened_whole"]] == 1 for _, _, r in held] & (scores[:, secret] > 0), _AS_ONE, 0.0)
        found = [(*held[c][:2], int(k), float(scores[c, k])) for c, k in np.argwhere(scores + most > 0)]
        held.clear()
        return found

    for span in _candidates(text, at, end, taken, tokens):
        held.append(span)
        if len(held) == _BLOCK:
            yield from block()
    if held:
        yield from block()


def _decoded(spans: Iterator[tuple[int, int, int, float]], moves: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """The best segmentation, (first, last + 1, kind) each; a token outside scores 0.

    Spans come by first token. For each end and kind the best way there is kept with its score; a
    way that ended more than GAP tokens ago gives its successor no move. Ways share their beginnings.
    """
    step = None if moves is None else moves.tolist()
    far: tuple[float, tuple | None] = (0.0, None)  # the best way whose last span lies further back
    near: list[tuple[int, dict[int, tuple[float, tuple]]]] = []
    ahead: list[int] = []
    ends: dict[int, dict[int, tuple[float, tuple]]] = {}
    at, best = -1, {}

    def better(one, other):
        return other if other[0] > one[0] else one

    for i, j, k, score in spans:
        if i != at:
            at, best = i, {}
            while ahead and ahead[0] <= i:
                near.append((ahead[0], ends.pop(heappop(ahead))))
            while near and near[0][0] < i - GAP:
                for way in near.pop(0)[1].values():
                    far = better(far, way)
        if k not in best:
            best[k] = far
            for _, ways in near:
                for before, (value, way) in ways.items():
                    best[k] = better(best[k], (value + (step[before][k] if step else 0.0), way))
        value, way = best[k]
        if j not in ends:
            ends[j] = {}
            heappush(ahead, j)
        if k not in ends[j] or ends[j][k][0] < value + score:
            ends[j][k] = (value + score, ((i, j, k), way))
    near += [(j, ends[j]) for j in sorted(ends)]
    for _, ways in near:
        for way in ways.values():
            far = better(far, way)
    out, way = [], far[1]
    while way is not None:
        out.append(way[0])
        way = way[1]
    return out[::-1]


def examples(count: int = 320, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated lines with their spans: PII in several forms, and look-alikes without; then half
    as many lines of announced secrets and of words that are none; then half as many of two or three
    spans in a row, of announced numbers as they are written within a country, and of such numbers
    and columns of numbers that nothing announces."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    letters = lambda n: "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    words = lambda n: " ".join(letters(int(rng.integers(2, 9))) for _ in range(n))

    def card(n: int, good: bool) -> str:
        head = pick("3456") + digits(n - 2)
        last = next(d for d in "0123456789" if luhn(head + d) == good)
        return head + last

    def grouped(s: str) -> str:
        sep = pick(" -")
        return sep.join(s[k : k + 4] for k in range(0, len(s), 4))

    def name() -> str:
        return pick([letters(6), f"{letters(5)}.{digits(2)}", f"{letters(4)}_{letters(5)}"])

    makers = {
        "email": lambda: pick([f"{name()}@{letters(5)}{digits(1)}.{letters(6)}.{pick(['com', 'org', 'net'])}", f"{letters(6)} at {letters(7)} dot {pick(['com', 'org', 'net'])}", f"{letters(6)} [at] {letters(7)} [dot] {pick(['com', 'org'])}"]),
        "ip": lambda: ".".join(str(int(x)) for x in rng.integers(1, 255, 4)),
        "card": lambda: pick([card(16, True), grouped(card(16, True)), card(15, True)]),
        "phone": lambda: pick([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"+{pick(['44', '33', '49'])} {digits(2)} {digits(4)} {digits(4)}"]),
        "secret": lambda: pick(["AKIA" + "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), "".join(pick("0123456789abcdef") for _ in range(int(pick([18, 20, 32, 40])))), "sk" + letters(3) + digits(4) + letters(9) + digits(5)]),
    }
    # Values behind their cue alone, without two adjacent digits; the last two stand without a cue.
    passwords = [
        lambda: f"{letters(4).title()}{digits(1)}{letters(4)}{digits(1)}",
        lambda: f"{letters(3)}{pick('!#$%&*')}{letters(4).title()}{digits(1)}",
        lambda: f"{pick('$#!')}{letters(5)}{digits(1)}{letters(2).upper()}{pick('!$%')}",
        lambda: f"{letters(5)}-{letters(6)}-{letters(5)}",
        lambda: letters(int(rng.integers(8, 15))),
        lambda: "AKIA" + letters(16).upper(),
        lambda: "sk" + letters(3) + digits(4) + letters(9) + digits(5),
    ]
    cue = {"email": ["", "mail ", "contact "], "ip": ["", "host ", "ip "], "card": ["", "card ", "visa "], "phone": ["", "tel ", "call "], "secret": ["", "password=", 'token = "', "key: "]}
    pass_cue = ["password=", "password: ", 'password = "', "pwd=", "the password is ", "passphrase: "]
    any_cue = ["token=", 'secret = "', "api_key: ", "key = ", "the secret is "]
    plain = [
        lambda: f"{int(rng.integers(1900, 2030))}",
        lambda: f"{int(rng.integers(1990, 2030))}-{int(rng.integers(10, 13))}-{int(rng.integers(10, 29))}",
        lambda: f"version {digits(1)}.{digits(2)}.{digits(1)}",
        lambda: card(16, False),
        lambda: grouped(card(16, False)),
        lambda: digits(int(rng.integers(2, 7))),
        lambda: digits(int(rng.integers(7, 14))),
        lambda: f"{digits(2)}, {digits(3)}, {digits(4)} and {digits(3)}",
        lambda: f"{digits(3)} {digits(3)} {digits(3)} {digits(3)}",
        lambda: f"{int(rng.integers(300, 999))}.{digits(3)}.{int(rng.integers(300, 999))}.{digits(3)}",
        lambda: f"@{letters(7)} {digits(2)}",
        lambda: f"the dot and at {words(2)}",
        lambda: f"{letters(9)}{digits(2)}",
        lambda: f"${digits(3)}.{digits(2)}",
        lambda: f"{digits(2)}:{digits(2)}:{digits(2)}",
        lambda: f"isbn 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
        lambda: f"{letters(6)}-{digits(4)}-{letters(4)}",
    ]
    unannounced = [
        lambda: f"{pick(['key: ', 'the key is ', 'secret: ', 'token: ', 'token = ', 'key='])}{words(2)}",
        lambda: f"the {pick(['password', 'passphrase'])} is {pick(['not', 'too', 'a', 'for', 'in', 'wrong', 'long'])} {words(1)}",
        lambda: f"{pick(['key', 'token', 'secret'])} {words(2)}",
        lambda: f"{letters(7).title()}{letters(8).title()}{letters(7).title()}",
        lambda: letters(int(rng.integers(16, 24))),
        lambda: letters(int(rng.integers(16, 24))).upper(),
    ]
    out = []
    for k in range(count + count // 2):
        line, spans = words(int(rng.integers(1, 5))) + " ", []
        if k % 2 == 0:
            kind = KINDS[(k // 2) % len(KINDS)] if k < count else "secret"
            if k >= count:
                at = (k // 2) % len(passwords)
                line += "" if at > 4 else pick(pass_cue if at > 2 or rng.integers(2) else any_cue)
                piece = passwords[at]()
            else:
                line += pick(cue[kind])
                piece = makers[kind]()
            spans.append((kind, len(line), len(line) + len(piece)))
            line += piece + ('"' if line.endswith('"') else "")
        else:
            line += pick(plain if k < count else unannounced)()
        line += pick(["", ".", ","]) + " " + words(int(rng.integers(1, 5)))
        out.append((line, spans))
    announced = ["call ", "tel ", "tel. ", "Tel.: ", "phone: ", "Phone ", "fax: ", "mobile ", "tél : "]
    national = [
        lambda: "0" + digits(int(rng.integers(9, 11))),
        lambda: f"{digits(3)}{pick(' -')}{digits(4)}",
        lambda: f"0{digits(3)} {digits(2)} {digits(int(rng.integers(6, 8)))}",
        lambda: f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}",
        lambda: f"0{digits(int(rng.integers(2, 5)))}{pick([' ', '-', '/'])}{digits(int(rng.integers(6, 8)))}",
    ]
    for k in range(count // 2):
        line, spans = words(int(rng.integers(1, 5))) + " ", []
        if k % 8 == 3:  # columns of numbers
            wide, rows = [int(x) for x in rng.integers(1, 5, int(rng.integers(1, 3)))], int(rng.integers(8, 20))
            line += " ".join(digits(w) for _ in range(rows) for w in wide)
        elif k % 4 == 3:
            line += pick(["", "no ", "order ", "item ", "lot "]) + pick([lambda: digits(int(rng.integers(7, 12))), lambda: f"{digits(3)} {digits(4)}", lambda: " ".join(digits(2) for _ in range(5))])()
        else:
            kinds = ["phone"] if k % 4 == 0 else [pick(["phone", "email", "card", "ip"])] * 2 if k % 4 == 1 else [pick(["email", "phone"]), "phone", "email"][: int(rng.integers(2, 4))]
            for n, kind in enumerate(kinds):
                if n:
                    line += pick([", ", "; ", " / ", " or "])
                elif k % 4 == 0:
                    line += pick(announced)
                piece = pick(national)() if k % 4 == 0 else makers[kind]()
                spans.append((kind, len(line), len(line) + len(piece)))
                line += piece
            if rng.integers(2):  # what stands near a span need not be one
                line += pick([", ", "; ", " / ", " or ", " on "]) + pick([*plain[:2], *plain[5:7], plain[14], plain[16]])()
        line += pick(["", ".", ","]) + " " + words(int(rng.integers(1, 5)))
        out.append((line, spans))
    return out


@lru_cache(maxsize=2)
def fit(count: int = 320, steps: int = 60, seed: int = 7) -> Field:
    """Weights of the field: gradient ascent on the likelihood of the segmentations.

    All lines go through the sums forward and backward at once, a token at a time.
    """
    where, rows, gold, pairs, n = [], [], [], np.zeros((len(KINDS), len(KINDS))), 0
    for number, (text, spans) in enumerate(examples(count, seed)):
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        known = {(a, b): KINDS.index(kind) for kind, a, b in spans}
        told = []
        for i, j, row in _candidates(text, 0, len(text), [], tokens):
            kind = known.get((tokens[i][0], tokens[j - 1][1]))
            where.append((number, i, j))
            rows.append(row)
            gold.append(np.eye(len(KINDS))[kind] if kind is not None else np.zeros(len(KINDS)))
            told += [(i, j, kind)] if kind is not None else []
        for (_, end, one), (first, _, two) in zip(told, told[1:], strict=False):
            pairs[one, two] += first - end <= GAP
        n = max(n, len(tokens))
    (line, first, last), rows, gold = np.array(where).T, np.array(rows), np.array(gold)
    lines, by_first = number + 1, [np.flatnonzero(first == i) for i in range(n)]
    shapes = [(len(_SHAPES), len(KINDS)), (len(KINDS), len(KINDS))]
    values, memory = [np.zeros(x) for x in shapes], [np.full(x, 1e-6) for x in shapes]
    for _ in range(steps):
        odds, move = np.exp(rows @ values[0]), np.exp(values[1])
        # Sums over the segmentations: of what ends at a token (by kind), of all before it, and of those that a span at it goes on from.
        ended, before, start = np.zeros((lines, n + 1, len(KINDS))), np.ones((lines, n + 1)), np.zeros((lines, n + 1, len(KINDS)))
        for i in range(n + 1):
            if i:
                before[:, i] = before[:, i - 1] + ended[:, i].sum(1)
            start[:, i] = (before[:, i - GAP - 1] if i > GAP else np.ones(lines))[:, None] + ended[:, max(0, i - GAP) : i + 1].sum(1) @ move
            if i < n:
                c = by_first[i]
                np.add.at(ended, (line[c], last[c]), start[line[c], i] * odds[c])
        # And of what follows an end of a kind, or begins at a token or later.
        rest, after, begun = np.ones((lines, n + GAP + 2)), np.ones((lines, n + 1, len(KINDS))), np.zeros((lines, n + GAP + 2, len(KINDS)))
        for i in range(n, -1, -1):
            if i < n:
                c = by_first[i]
                np.add.at(begun, (line[c], i), odds[c] * after[line[c], last[c]])
            rest[:, i] = rest[:, i + 1 if i < n else i] + begun[:, i].sum(1)
            after[:, i] = rest[:, i + GAP + 1][:, None] + begun[:, i : i + GAP + 1].sum(1) @ move.T
        whole = before[:, n]
        share = start[line, first] * odds * after[line, last] / whole[line][:, None]
        passed = sum((ended[:, : n + 1 - a] / whole[:, None, None]).reshape(-1, len(KINDS)).T @ begun[:, a : n + 1].reshape(-1, len(KINDS)) for a in range(GAP + 1)) * move
        for k, slope in enumerate((rows.T @ (gold - share), pairs - passed)):
            slope -= 0.02 * values[k]
            memory[k] += slope**2
            values[k] += 0.6 * slope / np.sqrt(memory[k])
    return Field(*values)


def _regions(text: str) -> list[tuple[int, int]]:
    """Stretches around what may be part of a span, cut at white space."""
    found: list[list[int]] = []
    hits = [(m.start(), m.end()) for m in _ANCHOR.finditer(text)]
    more = [(m.start(), m.end()) for m in _LONG.finditer(text) if _is_mixed(m[0])]
    more += [(start, stop) for start, (stop, _) in _openers(text).items()]
    for a, b in sorted(hits + more) if more else hits:
        at, end = max(0, a - _MARGIN), min(len(text), b + _MARGIN)
        if found and at <= found[-1][1]:
            found[-1][1] = max(found[-1][1], end)
        else:
            found.append([at, end])
    out = []
    for at, end in found:
        while at > 0 and text[at - 1].isalnum():
            at -= 1
        while end < len(text) and text[end].isalnum():
            end += 1
        if out and at <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((at, end))
    return out


def _united(spans) -> list[tuple[int, int]]:
    """The union of the spans: stretches without overlap, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cuts(text: str, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Pieces of a region, cut at line feeds, which no span crosses."""
    while at < end:
        stop = text.find("\n", min(at + _PIECE, end), end)
        stop = end if stop < 0 else stop
        yield at, stop
        at = stop


def find_spans(text: str | None, field: Field) -> tuple[list, list]:
    """The patterns' spans, and all spans: each (kind, start, end), by kind and start."""
    if not text:
        return [], []
    base = base_spans(text)
    taken = _united((a, b) for _, a, b in base)
    added, done = [], 0
    for at, end in _regions(text):
        while done < len(taken) and taken[done][1] <= at:
            done += 1
        near = list(takewhile(lambda x: x[0] < end, islice(taken, done, None)))
        for a, b in _cuts(text, at, end):
            tokens = [m.span() for m in _TOKEN.finditer(text, a, b)]
            added += [(KINDS[k], tokens[i][0], tokens[j - 1][1]) for i, j, k in _decoded(_scored(text, a, b, near, tokens, field), field.moves)]
    order = {k: n for n, k in enumerate(KINDS)}
    return base, sorted({*base, *added}, key=lambda s: (order[s[0]], s[1], s[2]))


def masked(text: str, spans: list) -> str:
    """The text with each span, or run of overlapping spans, as one mark of its first kind."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


_JOIN = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, masked string"


def _scan(field: Field, with_text: bool):
    names = [x.split()[0] for x in SPANS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            for text in batch.column("text").to_pylist():
                base, spans = find_spans(text, field)
                for c, kind in zip(columns, BASE_KINDS, strict=False):
                    c.append(sum(k == kind for k, _, _ in base))
                columns[4].append(hashlib.sha256(_JOIN(base).encode()).hexdigest())
                columns[5].append(_JOIN(spans))
                columns[6].append(sum(k == "secret" for k, _, _ in spans))
                columns[7].append(masked(text, spans) if with_text and text is not None else None)
            types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return run


def find_pii(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Counts, spans and (with_text) the masked text of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(fit(), with_text), SPANS)


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with the spans of every text masked and n_chars (where present) counted again."""
    field, at = fit(), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else masked(t, find_spans(t, field)[1]) for t in batch.column(at).to_pylist()]
            columns = [*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op1_pii_semicrf(spark, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents", "doc_id", "text"), with_text=False).drop("masked")
