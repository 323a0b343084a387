"""Path-dependent folds: a media item's rows in order through a machine whose state holds earlier decisions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dubflow.functions.text import SPACE_CLASS
from dubflow.operators.streams import fold

_ENDS = re.compile(f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$")


def _joined(a: str | None, b: str | None) -> str | None:
    """join_texts() of two texts."""
    if a is None or b is None:
        return None
    a, b = _ENDS.sub("", a), _ENDS.sub("", b)
    return a + b if a.endswith("-") or b.startswith("-") else f"{a} {b}"


def merge_short(df: DataFrame, least: float = 2.0, gap: float = 0.5) -> DataFrame:
    """Joins a segment to the one before while that is short, near and of the same speaker (or neither has one)."""

    def machine():
        held = None

        def step(row):
            nonlocal held
            if row is None:
                yield held
                return
            seq, start, end, text, speaker = row
            if held is None:
                held = row
            elif held[2] - held[1] < least and start - held[2] < gap and held[4] == speaker:
                held = (held[0], held[1], end, _joined(held[3], text), speaker)
            else:
                yield held
                held = row

        return step

    rows = df.select("media_id", F.col("seq").cast("long").alias("seq"), F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"), "text", F.col("speaker").cast("string").alias("speaker"))
    kind = rows.schema["media_id"].dataType.simpleString()
    return fold(rows, ["seq"], ["seq", "start_s", "end_s", "text", "speaker"], f"media_id {kind}, seq long, start_s double, end_s double, text string, speaker string", machine)


def delay_schedule(df: DataFrame, total: float, stretch: bool = True, most: float = 1.5) -> DataFrame:
    """Places clips (media_id, seq, start_s, actual_dur, valid) without overlap by a delay that grows up to `most`, never shrinks.

    Clips go by start, ties by seq. Invalid ones are not placed, but the room of the one before ends at their start.
    """

    def machine():
        delay = prev = 0.0
        held = None  # waits for the next clip's start

        def placed(clip, ahead):
            nonlocal delay, prev
            seq, start_s, actual, _ = clip
            wanted = start_s + delay
            if wanted < prev:
                delay = min(delay + prev - wanted, most)
            start = start_s + delay
            room = max((total if ahead is None else ahead + delay) - start, 0.5)
            raw = actual / room
            ratio = min(max(raw, 0.8), 1.35) if stretch and actual > 0 and not 0.9 <= raw <= 1.1 else 1.0
            prev = start + actual / ratio
            return seq, start, actual / ratio, ratio

        def step(row):
            nonlocal held
            if held is not None:
                yield placed(held, row and row[1])
            held = row if row is not None and row[3] else None

        return step

    rows = df.select("media_id", F.col("seq").cast("long").alias("seq"), F.col("start_s").cast("double").alias("start_s"), F.col("actual_dur").cast("double").alias("actual_dur"), "valid")
    kind = rows.schema["media_id"].dataType.simpleString()
    return fold(rows, ["start_s", "seq"], ["seq", "start_s", "actual_dur", "valid"], f"media_id {kind}, seq long, new_start double, final_dur double, ratio double", machine)


def assign_voices(df: DataFrame, voices: list[str]) -> DataFrame:
    """Each speaker's first use takes the first voice not used in the item; when all are, by the number of speakers known,
    and that choice is not remembered."""

    def machine():
        known: dict = {}

        def step(row):
            if row is None:
                return
            seq, speaker = row
            if speaker not in known and len(known) < len(voices):
                known[speaker] = voices[len(known)]
            yield seq, speaker, known.get(speaker, voices[len(known) % len(voices)])

        return step

    rows = df.select("media_id", F.col("seq").cast("long").alias("seq"), "speaker")
    kind = rows.schema["media_id"].dataType.simpleString()
    return fold(rows, ["seq"], ["seq", "speaker"], f"media_id {kind}, seq long, speaker string, voice string", machine)


def reference_fallback(df: DataFrame, clip: Column) -> DataFrame:
    """Voice references (media_id, seq, speaker, ref: null if invalid): a valid one is remembered for the item and the speaker;
    else the speaker's last, or the item's without a speaker, else the item's clip, remembered as both."""

    def machine():
        last, by = None, {}

        def step(row):
            nonlocal last
            if row is None:
                return
            seq, speaker, ref, spare = row
            used = ref
            if used is None:
                used = by.get(speaker) if speaker is not None else last
            if used is None:
                used = spare
            if used is not None and (ref is not None or speaker is None or speaker not in by):
                last = used
            if speaker is not None and used is not None:
                by[speaker] = used
            yield seq, speaker, used

        return step

    rows = df.select("media_id", F.col("seq").cast("long").alias("seq"), "speaker", "ref", clip.alias("spare"))
    kind = rows.schema["media_id"].dataType.simpleString()
    return fold(rows, ["seq"], ["seq", "speaker", "ref", "spare"], f"media_id {kind}, seq long, speaker string, used string", machine)


def translate_in_context(df: DataFrame, model, out: str = "translated") -> DataFrame:
    """Segments (media_id, seq, text, and `cached` if known) translated in order, each with the translation of the one before.

    model() loads, on the executor, a function of (text, previous translation or null); where it fails the text stays and
    `translated_ok` is false. Cached rows go to no model and their translation is no one's context, as no context is one's
    own before the first. Null or blank texts stay as they are.
    """

    def machine():
        previous, ask = None, model()

        def step(row):
            nonlocal previous
            if row is None:
                return
            seq, text, cached = row
            if cached is not None:
                yield seq, cached, True
                return
            if text is None or not _ENDS.sub("", text):
                yield seq, text, True
                return
            try:
                previous = ask(text, previous)
                yield seq, previous, True
            except Exception:  # the row says so
                previous = text
                yield seq, text, False

        return step

    cached = F.col("cached") if "cached" in df.columns else F.lit(None).cast("string")
    rows = df.select("media_id", F.col("seq").cast("long").alias("seq"), "text", cached.alias("cached"))
    kind = rows.schema["media_id"].dataType.simpleString()
    return fold(rows, ["seq"], ["seq", "text", "cached"], f"media_id {kind}, seq long, `{out}` string, translated_ok boolean", machine)
