"""Model boundaries, files and expressions on small cases."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dubflow.functions import dims, media, text
from dubflow.operators import audio, backends, frames, signal
from dubflow.sources import formats, shared


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_synthesis(spark):
    def cloning():
        def f(texts):
            if "bad batch" in texts:
                raise RuntimeError
            return [[0.5] * (100 if "short" not in t else 3) for t in texts]

        return f

    def network():
        return lambda texts: [None if "mute" in t else [0.1] * 80 for t in texts]

    rows = [(1, 0, "hello", True), (1, 1, "no reference", False), (1, 2, " ! ", True), (1, 3, None, True), (1, 4, "short one", True), (1, 5, "mute one", False), (1, 6, "mute short", True)]
    tasks = spark.createDataFrame(rows, "media_id long, seq long, text string, reference_ok boolean").coalesce(1)
    got = {r.seq: (r.backend, len(r.samples)) for r in backends.synthesise(tasks, "xtts", {"xtts": cloning, "edge": network}).collect()}
    words = lambda n: int(max(0.5, 0.3 * n) * 24_000)
    assert got == {0: ("xtts", 100), 1: ("edge", 80), 2: ("placeholder", words(1)), 3: ("placeholder", words(1)), 4: ("edge", 80), 5: ("placeholder", words(2)), 6: ("placeholder", words(2))}
    tasks = spark.createDataFrame([(1, 0, "bad batch", True), (1, 1, "fine", True)], tasks.schema).coalesce(1)
    assert {r.seq: r.backend for r in backends.synthesise(tasks, "xtts", {"xtts": cloning, "edge": network}).collect()} == {0: "edge", 1: "xtts"}
    assert {r.backend for r in backends.synthesise(tasks, "unknown", {"edge": network}).collect()} == {"edge"}
    assert {r.backend for r in backends.synthesise(tasks, "piper", {}).collect()} == {"placeholder"}
    assert backends.placeholder("a b") == backends.placeholder("a b") != backends.placeholder("a c")
    assert np.std(backends.placeholder("some words here")) == pytest.approx(1e-3, rel=0.1)


def test_synthesis_holds_few_clips(spark):
    """Clips come and go in small batches, however many rows Spark hands over; every row gets its clip."""
    network = lambda: lambda texts: [None if "mute" in t else [float(len(texts))] * 60 for t in texts]
    tasks = spark.range(100).selectExpr("1L as media_id", "id as seq", "if(id % 10 = 0, 'mute', concat('said ', id)) as text", "true as reference_ok").coalesce(1)
    got = {r.seq: r for r in backends.synthesise(tasks, "edge", {"edge": network}).collect()}
    assert len(got) == 100 and max(r.samples[0] for r in got.values()) == 32.0
    assert all(r.samples == backends.placeholder("mute") if k % 10 == 0 else r.backend == "edge" and len(r.samples) == 60 for k, r in got.items())


def test_recognition(spark):
    def load(device):
        def f(path):
            if path == "gpu" and device == "accelerator":
                raise RuntimeError("CUDA out of memory")
            if path == "never":
                raise ValueError("no such file")
            return [(0.0, 1.0, device, [(device, 0.0, 1.0, 0.4)])]

        return f

    files = spark.createDataFrame([(1, "any"), (2, "gpu"), (3, "never")], "media_id long, path string")
    rows = backends.recognise(files, load)
    got = {r.media_id: (r.text, r.error) for r in rows.collect()}
    assert got == {1: ("accelerator", None), 2: ("cpu", None), 3: (None, "ValueError('no such file')")}
    assert {r.media_id: r.text for r in backends.transcript(rows, None, 0.5).collect()} == {1: "accelerator", 2: "cpu"}  # no sure word: the text stays
    speech = spark.createDataFrame([(1, 2.0, 3.0)], "media_id long, start_s double, end_s double")
    assert [r.media_id for r in backends.transcript(rows, speech).collect()] == [2]
    assert backends.detect_speech(files, []) is None


def test_diarization_without_vectors(spark):
    turns = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 1.0, 1.2), (2, 0, 0.0, 5.0)], "media_id long, seq long, start_s double, end_s double")
    length = spark.createDataFrame([(1, 10.0), (2, 10.0)], "media_id long, seconds double")

    def broken():
        def f(clips):
            if any(c["end_s"] > 4 for c in clips):
                raise ValueError
            return [[1.0, 0.0] for _ in clips]

        return f

    vectors = backends.embedded(turns, length, [("x", broken)])
    assert [(r.media_id, r.seq) for r in vectors.collect()] == [(1, 0)]
    assert {(r.media_id, r.seq): r.speaker for r in backends.clustered(turns, vectors).collect()} == {(1, 0): "SPEAKER_00", (2, 0): "SPEAKER_00"}


def test_separation_without_model(spark):
    def none():
        raise ImportError

    got = backends.separate(spark.createDataFrame([(1, [0.5, 1.0]), (2, None)], "media_id long, samples array<float>"), none).collect()
    assert [(list(r.vocals), list(r.background), r.separated) for r in sorted(got)] == [([0.5, 1.0], [0.0, 0.0], False), ([], [], False)]


def test_separation_keeps_the_models_precision(spark):
    model = lambda: lambda x: [x.astype(float) * w for w in (0.1, 0.2, 0.3, 0.4)]
    x = np.arange(1, 101, dtype=np.float32) / 100
    got = backends.separate(spark.createDataFrame([(1, x.tolist())], "media_id long, samples array<float>"), model).first()
    assert got.separated and sum(got.vocals) == pytest.approx(0.4 * x.sum(dtype=float), rel=1e-13)
    assert sum(got.background) == pytest.approx(0.6 * x.sum(dtype=float), rel=1e-13)


def test_separated_query(spark):
    """On sf0.01 a total of rounded products fell on the other side of a half."""
    import duckdb

    from dubflow.plans.catalog import ORACLES, QUERIES

    data = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.sql(f"create view events as from '{data}/events.parquet'")
    want = sorted(db.sql(ORACLES["separated"]).fetchall())
    assert sorted(map(tuple, QUERIES["separated"](spark, data).collect())) == want


def test_registry(spark):
    backends.register("translate", "shout", lambda: lambda texts: [t.upper() for t in texts])
    rows = spark.createDataFrame([(1, "a"), (2, None)], "i int, text string")
    got = {r.i: (r.translated, r.backend) for r in backends.translate_batches(rows, backends.chain("translate", "absent", "shout"), "llama").collect()}
    assert got == {1: ("A", "shout"), 2: (None, None)}


def test_expressions(spark):
    for raw, want in ((" a ", "a"), ("\x1c b　", "b"), ("​", "​")):
        assert one(spark, text.strip(F.lit(raw))) == want == raw.strip()
    assert one(spark, text.sanitize(F.lit("a\tb  c"))) == "ab c" and one(spark, text.sanitize(F.lit(" ! "))) is None and one(spark, text.sanitize(F.lit("नमस्ते"))) is None
    assert one(spark, text.sentences(F.lit('One. Two!  x "Three?" 。四五。六七'))) == ["One.", "Two!", 'x "Three?" 。', "四五。", "六七"]
    assert [one(spark, text.on_screen(F.lit(t), F.lit(g), F.lit("de"), F.lit(m))) for t, g, m in (("x", "en", "y"), ("word", "de", "y"), ("word", "en", "y"), ("word", "en", ""), ("word", "en", None))] == ["x", "word", "y", "word", "word"]
    words = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(p).cast("double").alias("probability")) for w, p in (("a", 0.9), ("b", 0.1), ("c", None))])
    assert one(spark, text.confident(words, F.lit("whole"), 0.5)).text == "a c" and one(spark, text.confident(words, F.lit("whole"))).text == "whole"
    none = one(spark, text.confident(words, F.lit("whole"), 1.1))
    assert none.text == "whole" and none.words == []
    assert one(spark, dims.font(F.lit("ja"), F.array(F.lit("meiryo.ttc")))) == "meiryo.ttc" and one(spark, dims.font(F.lit("ja"), F.array(F.lit("x")))) == "arial.ttf"
    crop = one(spark, frames.square_crop(F.struct(F.lit(10.0).alias("x1"), F.lit(10.0).alias("y1"), F.lit(50.0).alias("x2"), F.lit(60.0).alias("y2")), F.lit(100), F.lit(100)))
    assert (crop.x1, crop.y1, crop.x2, crop.y2) == (0, 0, 100, 100) and crop.scale_x == pytest.approx(100 / 256)
    assert one(spark, frames.fitted_font(F.lit("ab"), F.lit(1000), F.lit(20))) == 22
    assert one(spark, frames.ocr_line(F.lit("broken"))) is None and one(spark, frames.ocr_line(F.lit('[[[0,0]],["t",null]]'))).conf == 1.0
    assert one(spark, media.seconds(F.lit(3), F.lit(0))) == 0.0 and one(spark, F.size(media.silence(F.lit(3), F.lit(2)))) == 6


def test_font_sizes(spark):
    """The step by step rule."""
    for length, width, height in ((1, 100, 3), (5, 30, 40), (30, 60, 21), (30, 1, 20), (7, 50, 11)):
        size = max(8, height + 2)
        while length * 0.6 * size > width and size > 8:
            size -= 2
        assert one(spark, frames.fitted_font(F.lit("x" * length), F.lit(width), F.lit(height))) == size


def test_files(spark, tmp_path):
    for name in ("a.mp4", "b.txt", "sub"):
        (tmp_path / name).mkdir() if name == "sub" else (tmp_path / name).write_bytes(b"12")
    (tmp_path / "sub" / "c.mkv").write_bytes(b"123")
    assert sorted((r.path[-5:], r.length) for r in formats.media_files(spark, str(tmp_path)).collect()) == [("a.mp4", 2), ("c.mkv", 3)]
    formats.write_manifest(spark.createDataFrame([("x.wav", 1.5)], "path string, seconds double").coalesce(1), str(tmp_path / "m"))
    line = json.loads(next((tmp_path / "m").glob("part*")).read_text())
    assert line["audio_filepath"] == "x.wav" and line["duration"] == 1.5 and line["num_speakers"] is None and set(line) == {"audio_filepath", "offset", "duration", "label", "text", "num_speakers", "rttm_filepath", "uniq_id"}
    assert shared.validated(spark, f"{tmp_path}/x/../a.mp4", True, [str(tmp_path)]).endswith("/a.mp4")
    for path, must, allowed in ((f"{tmp_path}/none", True, None), ("/a/bc", False, ["/a/b"]), ("/a/b/../c", False, ["/a/b"])):
        with pytest.raises((FileNotFoundError, ValueError)):
            shared.validated(spark, path, must, allowed)
    waves = spark.createDataFrame([("t.wav", 8000, 1, [0.0, 0.5, -0.5])], "name string, sample_rate int, channels int, samples array<float>")
    written = audio.write_wav(waves, str(tmp_path / "w")).collect()
    assert [(r.path.rsplit("/", 1)[1], r.length) for r in written] == [("t.wav", 50)]
    assert np.allclose(audio.decode((tmp_path / "w" / "t.wav").read_bytes())[1][0], [0, 0.5, -0.5], atol=1e-4)


def test_chunks(spark):
    rows = [(1, c, i) for c, n in ((2, 3), (10, 2), (1000, 1)) for i in range(n)]
    chunks = spark.createDataFrame([(m, c, i, {2: 3, 10: 2, 1000: 1}[c]) for m, c, i in rows], "media_id long, chunk long, at long, frames long")
    got = [r.at for r in formats.concatenated(chunks).orderBy("chunk", "at").collect()]
    assert got == list(range(6))
    assert [one(spark, formats.chunk_number(F.lit(n))) for n in ("a_002.mp4", "a_1000.mp4", "x.mp4")] == [2, 1000, None]


def test_joined_clips(spark):
    a, b = np.ones(100, np.float32), np.full(100, 3, np.float32)
    got = audio.joined_clips([a, b], 1000, 0.05)
    assert len(got) == 150 and got[49] == 1 and got[-1] == 3 and np.all(np.diff(got) >= 0)
    assert len(audio.joined_clips([], 10)) == 0
    parts = spark.createDataFrame([(1, 0, 1, b.tolist()), (1, 0, 0, a.tolist()), (1, 1, 0, None)], "media_id long, seq long, part int, samples array<float>")
    assert [(r.seq, np.allclose(r.samples, got)) for r in audio.spoken_sentences(parts, 1000).collect()] == [(0, True)]


def test_profile_and_resampling(spark):
    wave = spark.createDataFrame([(1, i, math.sin(i / 3)) for i in range(2000)], "media_id long, idx long, val double")
    got = [r.val for r in signal.profile_wave(wave, 100).orderBy("idx").collect()]
    assert len(got) == 1500 and max(map(abs, got)) == pytest.approx(10 ** (-3 / 20), rel=0.02) and got[0] == 0
    for rate, target in ((2, 3), (3, 2), (100, 7), (5, 5)):
        n = 50
        x = np.random.default_rng(rate).standard_normal(n)
        df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "media_id long, idx long, val double")
        got = [r.val for r in signal.resampled(df, rate, target).orderBy("idx").collect()]
        at = np.arange(max(1, round(n * target / rate))) * (rate / target)
        assert np.allclose(got, np.interp(at, np.arange(n), x))


def test_mel_by_definition():
    """One frame of the spectrum from sums of cosines and sines, and its bands one by one."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal(2000).astype(np.float32) * 0.1
    got = audio.mel(x, 16_000)
    y = np.append(x[:1], x[1:] - 0.97 * x[:-1]).astype(np.float64)
    padded, t = np.pad(y, 400), 3
    part = padded[t * 200 : t * 200 + 800] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(800) / 800))
    bins = np.array([abs((part * np.exp(-2j * np.pi * k * np.arange(800) / 800)).sum()) for k in range(401)])
    filters = audio.mel_filters(16_000, 800, 80, 55.0, 7600.0)
    for band in (0, 17, 79):
        level = 20 * math.log10(max(1e-5, float((filters[band] * bins).sum()))) - 20
        assert got[t, band] == pytest.approx(min(1, max(0, (level + 100) / 100)), abs=1e-6)


def test_spectral_match_by_definition():
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal(6000) * 0.1, rng.standard_normal(5000) * 0.3
    size, hop = 2048, 512
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    def frames_of(x):
        padded = np.pad(x, size // 2)
        return np.array([np.fft.rfft(padded[i : i + size] * w) for i in range(0, len(padded) - size + 1, hop)])

    s, r = frames_of(a), frames_of(b)
    gain = np.clip(abs(r).mean(0) / np.maximum(abs(s).mean(0), 1e-10), 0.3, 3) * 0.5 + 0.5
    out, weight = np.zeros(len(a) + size), np.zeros(len(a) + size)
    for i, f in enumerate(s * gain):
        out[i * hop : i * hop + size] += np.fft.irfft(f, size) * w
        weight[i * hop : i * hop + size] += w * w
    want = (out / np.maximum(weight, 1e-8))[size // 2 : size // 2 + len(a)]
    got = audio.match(a, b, 0.5)
    inside = slice(size, len(a) - size)
    assert np.allclose(got[inside], want[inside], atol=1e-5)


def test_fitted_clips(spark):
    rate = 8000
    tone = np.sin(2 * np.pi * 440 * np.arange(rate) / rate)
    for target in (0.6, 1.7):
        got = audio.fitted(tone, rate, target)
        assert abs(len(got) - target * rate) <= 1
        inside = got[1000:-1000]
        peak = np.argmax(abs(np.fft.rfft(inside * np.hanning(len(inside))))) * rate / len(inside)
        assert abs(peak - 440) < 5 and 0.6 < abs(inside).max() < 1.3  # the pitch stays
    assert len(audio.fitted(tone, rate, 0.1)) == 800 and len(audio.fitted(tone, rate, 5.0)) == 40_000 and not audio.fitted(tone, rate, 5.0)[8000:].any()
    assert audio.fitted(tone, rate, 1.01) is not None and len(audio.fitted(tone, rate, 1.01)) == rate and len(audio.fitted([], rate, 1.0)) == 0
    rows = spark.createDataFrame([(1, 0, tone.tolist(), rate, 2.0), (1, 1, None, rate, 2.0)], "media_id long, seq long, samples array<float>, sample_rate int, target double")
    assert {r.seq: len(r.samples) for r in audio.fit_clips(rows).collect()} == {0: 16_000, 1: 0}


def test_wide_samples():
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(3)
        f.setframerate(8000)
        f.writeframes(b"".join(int(v).to_bytes(3, "little", signed=True) for v in (0, 1 << 22, -(1 << 23))))
    assert audio.decode(out.getvalue())[1].tolist() == [[0.0, 0.5, -1.0]]


def test_largest_first_or_last(spark):
    rows = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 1, 9), (1, 0, 2, 9)], "media_id long, frame int, pos int, area int")
    assert frames.largest(rows, F.col("area")).first().pos == 2 and frames.largest(rows, F.col("area"), last_of_equals=False).first().pos == 1
