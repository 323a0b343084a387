"""Literal cases of the operators."""

import json

import pytest
from pyspark.sql import functions as F

from dubflow.functions import dims, text
from dubflow.operators import folds, frames, intervals, islands, signal


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("seconds", "stamp"), [(0.0, "00:00:00,000"), (1.5, "00:00:01,500"), (65.0, "00:01:05,000"), (3661.0, "01:01:01,000"), (1.234, "00:00:01,234"), (1.001, "00:00:01,000"), (360000.0, "100:00:00,000")])
def test_stamp(spark, seconds, stamp):
    assert one(spark, text.timestamp(F.lit(seconds))) == stamp


@pytest.mark.parametrize(("rows", "least", "want"), [
    ([(0.0, 1.0, "Hello", None), (1.2, 2.2, "world", None)], 2.0, [(0.0, 2.2, "Hello world")]),
    ([(0.0, 1.0, "Hello", None), (2.0, 3.0, "world", None)], 2.0, [(0.0, 1.0, "Hello"), (2.0, 3.0, "world")]),
    ([(0.0, 3.0, "Long", None), (3.1, 4.1, "Next.", None)], 2.0, [(0.0, 3.0, "Long"), (3.1, 4.1, "Next.")]),
    ([(0.0, 0.5, "A", None), (0.6, 1.1, "B", None), (1.2, 1.7, "C", None), (5.0, 6.0, "D", None)], 5.0, [(0.0, 1.7, "A B C"), (5.0, 6.0, "D")]),
    ([(1.0, 1.8, "Hello", "S01"), (2.0, 2.8, "world", "S02")], 2.0, [(1.0, 1.8, "Hello"), (2.0, 2.8, "world")]),
    ([(0.0, 0.5, "re-", "a"), (0.6, 1.1, "do", "a")], 2.0, [(0.0, 1.1, "re-do")]),
])
def test_merge_short(spark, rows, least, want):
    df = spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "media_id long, seq long, start_s double, end_s double, text string, speaker string")
    assert [(r.start_s, r.end_s, r.text) for r in folds.merge_short(df, least).orderBy("seq").collect()] == want


def test_words_and_runs(spark):
    words = [("Hello", 1.0, 1.5), (" how", 1.5, 1.8), (" are", 1.8, 2.0), (" you?", 2.0, 2.5), (" I", 2.5, 2.8), (" am", 2.8, 3.0), (" fine.", 3.0, 3.5)]
    w = spark.createDataFrame([(1, k, t, a, z) for k, (t, a, z) in enumerate(words)], "media_id long, seq long, text string, start_s double, end_s double")
    turns = spark.createDataFrame([(1, 0, 0.8, 2.4, "S01"), (1, 1, 2.4, 4.2, "S02")], "media_id long, seq long, start_s double, end_s double, speaker string")
    got = islands.speaker_runs(intervals.word_speaker(w, turns).withColumnRenamed("turn_speaker", "speaker")).orderBy("start_s").collect()
    assert [(r.speaker, r.start_s, r.end_s, r.text) for r in got] == [("S01", 1.0, 2.5, "Hello how are you?"), ("S02", 2.5, 3.5, "I am fine.")]


def test_schedule(spark):
    clips = spark.createDataFrame([(1, k, s, 1.0, True) for k, s in enumerate((1.0, 1.8, 3.0))], "media_id long, seq long, start_s double, actual_dur double, valid boolean")
    got = folds.delay_schedule(clips, 5.0).orderBy("seq").collect()
    assert [(round(r.new_start, 6), round(r.final_dur, 6)) for r in got] == [(1.0, 0.8), (1.8, 1.2), (3.0, 1.25)]


def test_boxes(spark):
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate((10, 12, 10, 8, 10))] + [(2, 0, None), (2, 1, 7), (2, 2, None), (3, 0, None)], "media_id long, frame int, x1 int")
    got = {(r.media_id, r.frame): r.x1 for r in frames.smooth(rows, "x1").collect()}
    assert got[1, 2] == 10 and got[2, 0] == got[2, 2] == 7 and got[3, 0] is None


def test_languages(spark):
    assert [one(spark, dims.language_code(F.lit(x))) for x in ("fr", "French", "InvalidLang", "Auto Detect", "Chinese (Simplified)")] == ["fr", "fr", "en", "auto", "zh"]
    assert one(spark, dims.model_size(F.lit("Large v3 Turbo (Fast)"), F.lit("base"))) == "large-v3-turbo"
    assert one(spark, dims.is_accelerator_error(F.lit("CUDA failed"), F.lit("RuntimeError")))


def test_crossfade(spark):
    for kind in ("linear", "cosine", "exponential"):
        w = one(spark, signal.crossfade(100, kind))
        assert len(w) == 100 and w[0] == 0 and abs(w[-1] - 1) < 1e-9
    assert one(spark, signal.crossfade(0)) == []


def test_fallback(spark):
    rows = spark.createDataFrame([(1, 0, "a", "p"), (1, 1, None, None), (1, 2, "b", None), (1, 3, "a", None)], "media_id long, seq long, speaker string, ref string")
    assert [r.used for r in folds.reference_fallback(rows, F.lit("clip")).orderBy("seq").collect()] == ["p", "p", "clip", "p"]


def test_cache(spark, tmp_path):
    from dubflow.sources import formats

    assert formats.read_cache(spark, str(tmp_path / "none")).count() == 0
    formats.write_cache(spark.createDataFrame([("en|es|Hé|x", "Hola")], "key string, translated string"), str(tmp_path / "c"))
    assert [tuple(r) for r in formats.read_cache(spark, str(tmp_path / "c")).collect()] == [("en|es|Hé|x", "Hola")]
    formats.write_cache(spark.createDataFrame([("a|b", 'say "x"'), ("é", "ü\n")], "key string, translated string"), str(tmp_path / "one"), single=True)
    text_ = next((tmp_path / "one").glob("part*.txt")).read_text()
    assert json.loads(text_) == {"a|b": 'say "x"', "é": "ü\n"} and "é" in text_
    assert len(list((tmp_path / "one").glob("part*.txt"))) == 1 and {r.key for r in formats.read_cache(spark, str(tmp_path / "one")).collect()} == {"a|b", "é"}
    formats.write_cache(spark.createDataFrame([], "key string, translated string"), str(tmp_path / "none_"), single=True)
    assert formats.read_cache(spark, str(tmp_path / "none_")).count() == 0
