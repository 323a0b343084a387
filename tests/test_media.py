"""Waveforms, model boundary and clip expressions on small cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dubflow.functions import media
from dubflow.operators import audio, frames, models


def tone(hz: float, rate: int = 16_000, seconds: float = 1.0) -> np.ndarray:
    return (0.5 * np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)).astype(np.float32)


def test_wav_round_trip(spark, tmp_path):
    stereo = np.stack([tone(440), tone(880)])
    (tmp_path / "a.wav").write_bytes(audio.encode(stereo, 16_000))
    (tmp_path / "b.wav").write_bytes(b"not a wave")
    (tmp_path / "c.wav").write_bytes(audio.encode(np.zeros((1, 0), np.float32), 16_000))
    rows = {r["path"][-5:]: r for r in audio.read_wav(spark, str(tmp_path), 24_000).collect()}
    assert rows["a.wav"]["channels"] == 2 and len(rows["a.wav"]["samples"]) == 48_000
    assert rows["b.wav"]["samples"] is None and rows["b.wav"]["error"] and rows["c.wav"]["error"]
    mono = audio.read_wav(spark, str(tmp_path / "a.wav"), mono=True)
    assert np.allclose(mono.first()["samples"], stereo.mean(0), atol=1e-4)
    back = audio.wav_bytes(mono.withColumn("name", F.lit("x"))).first()["content"]
    assert np.allclose(audio.decode(bytes(back))[1][0], stereo.mean(0), atol=1e-4)


def test_mel(spark):
    rows = spark.createDataFrame([(1, 16_000, tone(1000).tolist()), (2, 16_000, []), (3, 16_000, None)], "media_id long, sample_rate int, samples array<float>")
    got = audio.mel_frames(rows).collect()
    assert {r["media_id"] for r in got} == {1} and len(got) == 16_000 // 200 + 1
    m = np.array([r["mel"] for r in got])
    assert m.shape[1] == 80 and 0 <= m.min() and m.max() <= 1
    edges = np.argmax(m[10:-10].mean(0))
    centre = audio.mel_filters(16_000, 800, 80, 55.0, 7600.0)[edges].argmax() * 16_000 / 800
    assert abs(centre - 1000) < 80


def test_spectrum_inverts():
    x = np.random.default_rng(1).standard_normal(5000)
    assert np.allclose(audio.waveform(audio.spectrum(x, 2048, 512), 2048, 512, len(x)), x, atol=1e-6)


def test_match(spark):
    quiet = (tone(500) * 0.5).tolist()
    clips = spark.createDataFrame([(1, 0, quiet), (2, 0, quiet), (1, 1, None)], "media_id long, seq int, samples array<float>")
    got = {(r[0], r[1]): r for r in audio.match_spectra(clips, spark.createDataFrame([(1, tone(500).tolist())], "media_id long, reference array<float>"), 1.0).collect()}
    assert got[1, 0]["matched"] and len(got[1, 0]["samples"]) == len(quiet)
    assert np.abs(got[1, 0]["samples"]).max() == pytest.approx(0.5, abs=0.05)
    assert not got[2, 0]["matched"] and np.allclose(got[2, 0]["samples"], quiet) and got[1, 1]["samples"] is None


def test_failed_command_gives_null(spark):
    rows = spark.createDataFrame([("/nowhere.mp4", "/tmp/never.wav")], "source string, target string")
    assert audio.run_command(rows, audio.EXTRACT_AUDIO).first()["target"] is None


def test_predict_falls_back(spark):
    def picky():
        def f(xs):
            if "bad" in xs:
                raise ValueError
            return [x.upper() for x in xs]

        return f

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "c")], "i int, t string").coalesce(1)
    got = {r["i"]: (r["o"], r["backend"]) for r in models.predict(rows, "t", "o", "string", [("picky", picky)], last=lambda x: x).collect()}
    assert got == {1: ("A", "picky"), 2: ("bad", None), 3: (None, None), 4: ("C", "picky")}


def test_sync_plan(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (4.0, 1.0), (1.0, 3.0), (5.0, 1.0), (0.0, 1.0), (1.0, 4.0), (None, 1.0)], "a double, b double")
    got = [r["p"] for r in rows.select(media.sync_plan(F.col("a"), F.col("b")).alias("p")).collect()]
    assert [p["action"] for p in got] == ["copy", "stretch", "stretch", "stretch", "fit", "unchanged", "stretch", "unchanged"]
    for p in (got[1], got[2], got[3], got[6]):
        assert math.prod(p["tempo"]) == pytest.approx(p["speed"]) and all(0.5 <= t <= 2 for t in p["tempo"])


def test_zip_holds_last(spark):
    source = spark.range(4).select(F.lit(1).alias("media_id"), F.col("id").alias("frame"))
    driving = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "media_id int, frame long, d string")
    assert [r["d"] for r in frames.zip_frames(source, driving).orderBy("frame").collect()] == ["a", "b", "b", "b"]
    assert frames.zip_frames(source, driving.limit(0)).count() == 0
