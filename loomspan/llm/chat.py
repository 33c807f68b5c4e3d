"""Chat formatting: a finite-state machine over roles and a declarative template.

``format_conversations`` turns rows (conv_id, turn, role, text) into text segments in
order, each with a loss flag. ``read_back`` parses the formatted text again.

Defined cases: a null text or role is empty; a null conv_id is a conversation of its own;
rows of one turn number are ordered by role, then text, and repeated rows all stay; an
empty table gives no rows; columns besides the four are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Control strings by role. ``learn`` names the roles whose text is under the loss mask."""

    begin: str = "<s>"
    roles: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>", "<</SYS>>"),
            "user": ("[INST]", "[/INST]"),
            "assistant": ("[REPLY]", "</s>"),
        }
    )
    #: Any other role: its name stands between the first two, its text before the third.
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[END]")
    learn: frozenset[str] = frozenset({"assistant"})
    #: (state, role) -> state; what is missing leads to "invalid", which is never left.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "instructed",
            ("start", "user"): "asked",
            ("instructed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )

    def controls(self) -> list[str]:
        return [self.begin, *(c for pair in self.roles.values() for c in pair), *self.other]

    def split_pattern(self) -> re.Pattern:
        return re.compile("(" + "|".join(re.escape(c) for c in sorted(self.controls(), key=len, reverse=True)) + ")")

    def step(self, state: str, role: str) -> str:
        return self.moves.get((state, role), "invalid")


class Escaper:
    r"""Breaks control strings inside texts: ``\`` is doubled and ``\|`` put behind the first
    character of each control string. No control string holds a backslash or a bar."""

    def __init__(self, template: ChatTemplate):
        self._control = re.compile("(?=" + "|".join(re.escape(c) for c in template.controls()) + ")(.)", re.S)
        self._escape = re.compile(r"\\([\\|])")

    def escape(self, text: str) -> str:
        return self._control.sub(r"\1\\|", text.replace("\\", "\\\\"))

    def unescape(self, text: str) -> str:
        return self._escape.sub(lambda m: "\\" if m[1] == "\\" else "", text)


SEGMENTS = "conv_id long, turn long, seq long, segment string, loss boolean, state string"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, final_state string"
)
_BATCH = 512


def _emit(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _segmenter(template: ChatTemplate):
    names, types = ["conv_id", "turn", "seq", "segment", "loss", "state"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escaper, now, state, seq, out, chars = Escaper(template), (), "start", 0, [], 0
        for batch in batches:
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                role, text = role or "", escaper.escape(text or "")
                if now != (conv,):
                    now, state, seq = (conv,), "start", 0
                    pieces = [(template.begin, False)]
                else:
                    pieces = []
                state = template.step(state, role)
                if role in template.roles:
                    before, after = template.roles[role]
                    pieces += [(before, False), (text, role in template.learn), (after, False)]
                else:
                    before, middle, after = template.other
                    pieces += [(before, False), (escaper.escape(role), False), (middle, False), (text, role in template.learn), (after, False)]
                for piece, loss in pieces:
                    out.append((conv, turn, seq, piece, loss, state))
                    seq += 1
                    chars += len(piece)
                if len(out) >= _BATCH or chars > 1 << 22:
                    yield _emit(out, names, types)
                    out, chars = [], 0
        if out:
            yield _emit(out, names, types)

    return run


def format_conversations(conversations: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Segments (conv_id, turn, seq, segment, loss, state), in order inside each partition.

    Rows are dealt by conv_id and sorted; a task streams them and holds one batch, however
    long a conversation is. ``state`` is the machine's state after the segment's turn.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_segmenter(template or ChatTemplate()), SEGMENTS)


def _reader(template: ChatTemplate):
    split, openers, closers = template.split_pattern(), {a: r for r, (a, _) in template.roles.items()}, {b for _, b in template.roles.values()} | {template.other[2]}
    names, types = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "final_state"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escaper, now, out = Escaper(template), (), []

        def done():
            return (now[0], turns, all_text.hexdigest(), loss_chars, loss_text.hexdigest(), chars, last)

        for batch in batches:
            for conv, segment, loss, state in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss", "state")), strict=True):
                if now != (conv,):
                    if now:
                        out.append(done())
                    now, turns, all_text, loss_text, loss_chars, chars, role, parts = (conv,), 0, hashlib.sha256(), hashlib.sha256(), 0, 0, "", []
                chars, last = chars + len(segment), state
                for k, piece in enumerate(split.split(segment)):
                    if k % 2 == 0:  # text between control strings
                        parts.append(piece)
                        if loss:
                            plain = escaper.unescape(piece)
                            loss_text.update(plain.encode())
                            loss_chars += len(plain)
                    elif piece in openers:
                        role, parts = openers[piece], []
                    elif piece in (template.begin, template.other[0]):
                        parts = []
                    elif piece == template.other[1]:
                        role, parts = escaper.unescape("".join(parts)), []
                    elif piece in closers:
                        all_text.update(f"{role}\n{escaper.unescape(''.join(parts))}\n".encode())
                        turns, parts = turns + 1, []
                if len(out) >= _BATCH:
                    yield _emit(out, names, types)
                    out = []
        if now:
            out.append(done())
        if out:
            yield _emit(out, names, types)

    return run


def read_back(segments: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """A digest of each conversation, parsed from the formatted text alone.

    Takes the output of ``format_conversations`` as it is partitioned and ordered.
    """
    return segments.select("conv_id", "segment", "loss", "state").mapInArrow(_reader(template or ChatTemplate()), DIGESTS)


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold the template's own control strings."""
    from loomspan.llm.common import table

    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(rows.unionByName(own)))
