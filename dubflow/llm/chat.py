"""Chat formatting: a finite-state machine over roles, and a declarative template whose output can be read back.

Turns of a conversation stream in order through one task; nothing is gathered, so a conversation may have any length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dubflow.llm.common import prepare

SEGMENT_DDL = "conv_id long, seg_no long, segment string, loss boolean, kind string, valid boolean"


@dataclass(frozen=True)
class Template:
    """What stands around a turn of each role, which roles are learned, and the machine of allowed orders.

    A role without an entry in `before` is written with `other`, its name escaped. `control` are all strings that have a
    meaning; inside a text each gets a backslash after its first character, and backslashes are doubled.
    """

    begin: str = "<s>"
    end: str = "</s>"
    before: dict = field(default_factory=lambda: {"system": "<<SYS>>", "user": "[INST]", "assistant": "[ANS]"})
    after: dict = field(default_factory=lambda: {"system": "<</SYS>>", "user": "[/INST]", "assistant": "[/ANS]"})
    other: tuple = ("[ROLE]", "[AS]", "[/ROLE]")
    learned: frozenset = frozenset({"assistant"})
    #: state -> role -> state; a conversation is valid if every turn has a step and it ends in `final`.
    steps: dict = field(default_factory=lambda: {"start": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    final: frozenset = frozenset({"answered"})

    @property
    def control(self) -> list[str]:
        return sorted({self.begin, self.end, *self.before.values(), *self.after.values(), *self.other}, key=lambda s: (-len(s), s))

    @property
    def pattern(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, self.control)))

    def escape(self, text: str) -> str:
        return self.pattern.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size > 8 << 20 or len(held) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


SEGMENTS = pa.schema([("conv_id", pa.int64()), ("seg_no", pa.int64()), ("segment", pa.string()), ("loss", pa.bool_()), ("kind", pa.string()), ("valid", pa.bool_())])


def format_turns(turns: Iterator[tuple], t: Template) -> Iterator[tuple]:
    """Segments of (conv_id, role, text) that come conversation by conversation. The end segment says if the order was valid."""
    pattern = t.pattern
    now, state, no = (), "start", 0

    def escaped(text: str) -> str:
        return pattern.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))

    for conv, role, text in turns:
        if now != (conv,):
            if now:
                yield (now[0], no, t.end, False, "end", state in t.final)
            now, state, no = (conv,), "start", 1
            yield (conv, 0, t.begin, False, "begin", None)
        state = t.steps.get(state, {}).get(role, "broken")
        if role in t.before:
            before, after = t.before[role], t.after[role]
        else:
            before, after = t.other[0] + escaped(role) + t.other[1], t.other[2]
        yield (conv, no, before, False, "before", None)
        yield (conv, no + 1, escaped(text), role in t.learned, "text", None)
        yield (conv, no + 2, after, False, "after", None)
        no += 3
    if now:
        yield (now[0], no, t.end, False, "end", state in t.final)


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of every conversation, in order: conv_id, seg_no, segment, loss, kind, valid (on the end segment).

    The formatted conversation is its segments joined; loss marks the assistants' texts. Null roles and texts count as
    empty; turns of equal number go by role and text; rows that are equal throughout stay, each as a turn. An order that
    the machine does not allow makes valid false; the turns are written all the same. Rows without conv_id form one
    conversation. Other columns play no part. No rows: no segments.
    """
    t = template or Template()
    prepare(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        turns = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
        yield from _batches(format_turns(turns, t), SEGMENTS)

    return rows.mapInArrow(run, SEGMENT_DDL)


def parse_segments(segments: Iterator[tuple], t: Template) -> Iterator[tuple]:
    """Reads formatted conversations back: a tuple of op10's columns for each. Only control strings are trusted, not kinds."""
    pattern, by_before = t.pattern, {v: k for k, v in t.before.items()}

    def one(conv, parts):
        turns, chars, loss_chars = 0, 0, 0
        whole, learned = hashlib.sha256(), hashlib.sha256()
        rest, role, valid = "", None, None
        for _, _, text, loss, _, said in parts:
            chars += len(text)
            valid = said if said is not None else valid
            if loss:
                plain = t.unescape(text)
                loss_chars += len(plain)
                learned.update(plain.encode())
            rest += text
            at = 0
            for m in pattern.finditer(rest):
                token = m[0]
                if token in by_before:
                    role = by_before[token]
                elif token == t.other[1]:
                    role = t.unescape(rest[at : m.start()])
                elif token not in (t.begin, t.end, t.other[0]):
                    plain = t.unescape(rest[at : m.start()])
                    whole.update(f"{role}\n{plain}\n".encode())
                    turns += 1
                at = m.end()
            rest = rest[at:]
        return (conv, turns, whole.hexdigest(), loss_chars, learned.hexdigest(), chars, valid)

    from itertools import groupby

    for conv, parts in groupby(segments, key=lambda s: s[0]):
        yield one(conv, parts)


PARSED = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])
PARSED_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(segments: DataFrame, template: Template | None = None, ordered: bool = False) -> DataFrame:
    """Per conversation, from the formatted segments alone: counts and digests.

    Segments are put in order first, as those of a stored table need; `ordered` says that they come straight from
    format_conversations. No segments: no rows.
    """
    t = template or Template()
    if not ordered:
        segments = segments.repartition("conv_id").sortWithinPartitions("conv_id", "seg_no")

    def run(batches):
        rows = (x for b in batches for x in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True))
        yield from _batches(parse_segments(rows, t), PARSED)

    return segments.select(*SEGMENTS.names).mapInArrow(run, PARSED_DDL)
