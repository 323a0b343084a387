"""The models of a dubbing run at their boundaries: recognition, diarization, separation, translation, synthesis, reading of
screen texts, lip synchronisation, enhancement. Weights are no part of this engine: a backend is a name and a loader, run on
the executors batch by batch; a stub stands for it in tests. What surrounds the models - chains, retries, last resorts,
filters - is here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dubflow.functions import dims, media, text
from dubflow.operators import intervals, islands, signal
from dubflow.operators.models import Loader, predict

#: Backends by kind and name, as plug-ins register them.
REGISTRY: dict[str, dict[str, Loader]] = {}


def register(kind: str, name: str, loader: Loader) -> None:
    REGISTRY.setdefault(kind, {})[name] = loader


def chain(kind: str, *names: str) -> list[tuple[str, Loader]]:
    """The registered backends of these names, in order; unknown names are passed over."""
    return [(n, REGISTRY[kind][n]) for n in names if n in REGISTRY.get(kind, {})]


# Recognition


def recognise(files: DataFrame, load: Callable[[str], Callable[[str], list[tuple]]]) -> DataFrame:
    """Files (media_id, path) to segments (media_id, seq, start_s, end_s, text, words, error).

    load(device) gives, once a task, a function from a path to (start, end, text, [(word, start, end, probability)]). A file
    whose accelerator fails is tried once more on the processor; a file that fails is one row with its error.
    """

    def run(batches):
        ready: dict = {}

        def attempt(device, path):
            if device not in ready:
                ready[device] = load(device)
            return ready[device](path)

        def of(path):
            try:
                return attempt("accelerator", path), None
            except Exception as e:  # the row carries it unless the processor helps
                if not any(w in f"{e} {type(e).__name__}".lower() for w in dims.ACCELERATOR_ERRORS):
                    return [], repr(e)
                try:
                    return attempt("cpu", path), None
                except Exception as again:
                    return [], repr(again)

        for b in batches:
            for i, path in zip(b["media_id"], b["path"]):
                found, error = of(path)
                rows = [(i, k, a, z, t, [dict(zip(("word", "start_s", "end_s", "probability"), w)) for w in ws], None) for k, (a, z, t, ws) in enumerate(found)]
                yield pd.DataFrame(rows or ([(i, None, None, None, None, None, error)] if error else []), columns=["media_id", "seq", "start_s", "end_s", "text", "words", "error"])

    words = "array<struct<word:string,start_s:double,end_s:double,probability:double>>"
    return files.select("media_id", "path").mapInPandas(run, f"media_id long, seq long, start_s double, end_s double, text string, words {words}, error string")


def transcript(segments: DataFrame, speech: DataFrame | None = None, least_confidence: float = 0.0) -> DataFrame:
    """Recognised segments after the filters: speech regions (if a detector gave any), confident words, spoken texts, repeats."""
    rows = segments.where("seq is not null")
    rows = intervals.speech_filter(rows, speech) if speech is not None else rows
    sure = text.confident(F.col("words"), F.col("text"), least_confidence)
    rows = rows.withColumn("sure", sure).withColumns({"text": F.col("sure.text"), "words": F.col("sure.words")}).drop("sure")
    return islands.clean_segments(rows.where(text.spoken(F.col("text"))))


def detect_speech(files: DataFrame, backends: list[tuple[str, Loader]]) -> DataFrame | None:
    """Speech regions (media_id, start_s, end_s) of files; None without a detector, which filters nothing."""
    if not backends:
        return None
    found = predict(files.select("media_id", "path"), "path", "regions", "array<struct<start_s:double,end_s:double>>", backends)
    return found.select("media_id", F.explode("regions").alias("r")).select("media_id", "r.*")


# Diarization


def first_with_rows(*results: DataFrame) -> DataFrame:
    """For each media item the rows of the first result that has any."""
    rows = reduce(DataFrame.unionByName, [r.withColumn("__rank", F.lit(k)) for k, r in enumerate(results)])
    best = rows.groupBy(F.col("media_id").alias("__m")).agg(F.min("__rank").alias("__first"))
    return rows.join(best, (F.col("media_id") == F.col("__m")) & (F.col("__rank") == F.col("__first")), "left_semi").drop("__rank")


def embedded(turns: DataFrame, length: DataFrame, backends: list[tuple[str, Loader]]) -> DataFrame:
    """Turns (media_id, seq, start_s, end_s) with `vector`: clamped to the media's length (media_id, seconds), too short ones
    and those whose model fails left out."""
    rows = turns.join(length, "media_id").withColumn("clip", media.clamped(F.col("start_s"), F.col("end_s"), F.col("seconds"))).where("clip is not null")
    rows = rows.select("media_id", "seq", "start_s", "end_s", "clip")
    return predict(rows, "clip", "vector", "array<double>", backends).where("vector is not null").drop("clip", "backend")


def clustered(turns: DataFrame, vectors: DataFrame, most: int = 10) -> DataFrame:
    """Turns (media_id, seq, start_s, end_s, speaker) by clusters of their vectors. Items without any vector have one speaker;
    in others turns without one are left out."""
    named = signal.cluster_embeddings(vectors, most)
    known = turns.join(named, ["media_id", "seq"]).select("media_id", "seq", "start_s", "end_s", "speaker")
    alone = turns.join(vectors.select("media_id").distinct(), "media_id", "left_anti")
    return known.unionByName(alone.select("media_id", "seq", "start_s", "end_s", F.lit("SPEAKER_00").alias("speaker")))


# Separation


def separate(waves: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """Mono waveforms (media_id, samples) to (media_id, vocals, background, separated).

    The model gives drums, bass, other and vocals; the first three are the background. Its samples keep the precision that it
    gives them. Where it fails the vocals are the input and the background is silence.
    """

    def run(batches):
        try:
            model = load()
        except Exception:  # no model: the last resort for every row
            model = None
        for b in batches:
            out = []
            for i, s in zip(b["media_id"], b["samples"]):
                x = np.asarray(s if s is not None else [], np.float32)
                try:
                    sources = np.asarray(model(x), float)
                    out.append((i, sources[3], sources[:3].sum(0), True))
                except Exception:
                    out.append((i, x, np.zeros_like(x), False))
            yield pd.DataFrame(out, columns=["media_id", "vocals", "background", "separated"])

    return waves.select("media_id", "samples").mapInPandas(run, "media_id long, vocals array<double>, background array<double>, separated boolean")


def enhance(waves: DataFrame, backends: list[tuple[str, Loader]]) -> DataFrame:
    """(media_id, samples, enhanced) by the first enhancer that works; without one the samples stay as they are."""
    got = predict(waves.select("media_id", "samples"), "samples", "better", "array<float>", backends)
    return got.select("media_id", F.coalesce("better", "samples").alias("samples"), F.col("backend").isNotNull().alias("enhanced"))


# Translation


def translate_batches(segments: DataFrame, backends: list[tuple[str, Loader]], family: str = "default") -> DataFrame:
    """segments (text, ...) with translated and backend, in batches of 8, of 4 for the large families; what fails keeps its text."""
    size = 4 if family in ("llama", "alma") else 8
    return predict(segments, "text", "translated", "string", backends, last=lambda x: x, size=size)


def detect_language(rows: DataFrame, column: str, out: str, backends: list[tuple[str, Loader]]) -> DataFrame:
    """rows with the language of a text column, `unknown` for short texts and where no detector answers."""
    asked = predict(rows.withColumn("__asked", text.detectable(F.col(column))), "__asked", out, "string", backends)
    return asked.withColumn(out, F.coalesce(out, F.lit("unknown"))).drop("__asked", "backend")


# Synthesis


def _noise(words: str, rate: int = 24_000) -> np.ndarray:
    seconds = max(0.5, min(0.3 * (len(words.split()) if words else 1), 5.0))
    seed = int.from_bytes(hashlib.sha256(words.encode("utf-8", "replace")).digest()[:8], "little")
    return (np.random.default_rng(seed).standard_normal(int(seconds * rate)) * 1e-3).astype(np.float32)


def placeholder(words: str, rate: int = 24_000) -> list[float]:
    """Faint noise as long as the words would take, the same for the same words."""
    return _noise(words, rate).tolist()


def synthesise(tasks: DataFrame, model: str, backends: dict[str, Loader], tries: int = 3, least: int = 50, size: int = 32) -> DataFrame:
    """Tasks (media_id, seq, text, reference_ok, ...) with samples and backend, a row each, in whatever order they come, `size`
    rows at a time.

    The text is sanitised; where nothing speakable is left the row gets a placeholder. Cloning models (xtts, f5) speak only
    rows with a valid reference (or `forced`); the others, and rows of unknown models, go to the network backend, `edge`. A
    backend answers a batch; what it leaves out is asked for again by itself, then by edge, `tries` times, then it is a
    placeholder. Clips of under `least` samples count as none.
    """
    clones = model in ("xtts", "f5")
    name = model if model in backends else "edge"
    forced = F.col("forced") if "forced" in tasks.columns else F.lit(False)
    rows = tasks.withColumn("__clean", text.sanitize(F.col("text"))).withColumn("__own", F.coalesce(forced | F.col("reference_ok"), F.lit(False)) if clones else F.lit(True))

    def run(batches):
        ready: dict = {}

        def speak(backend, texts):
            if backend not in backends:
                return [None] * len(texts)
            if backend not in ready:
                ready[backend] = backends[backend]()
            got = list(ready[backend](texts))
            return [g if g is not None and len(g) >= least else None for g in got] if len(got) == len(texts) else [None] * len(texts)

        def quietly(backend, texts):
            try:
                return speak(backend, texts)
            except Exception:  # the next attempt takes over
                return [None] * len(texts)

        # one placeholder has up to 120,000 samples, so no more rows than `size` are held with their clips
        for b in (whole.iloc[k : k + size] for whole in batches for k in range(0, len(whole), size)):
            clips: list = [None] * len(b)
            made: list = [None] * len(b)
            clean, own = b["__clean"].tolist(), b["__own"].tolist()
            for backend, which in ((name, True), ("edge", False)):
                some = [k for k, t in enumerate(clean) if isinstance(t, str) and bool(own[k]) is which]
                for k, clip in zip(some, quietly(backend, [clean[k] for k in some]) if some else []):
                    clips[k], made[k] = clip, backend
            for k, t in enumerate(clean):
                attempts = [name if own[k] else "edge"] + ["edge"] * tries if isinstance(t, str) else []
                for backend in attempts:
                    if clips[k] is None:
                        clips[k], made[k] = quietly(backend, [t])[0], backend
                if clips[k] is None:
                    clips[k], made[k] = _noise(t if isinstance(t, str) else "silence"), "placeholder"
            samples = pd.Series([np.asarray(c, np.float32) for c in clips], index=b.index, dtype=object)
            yield b.drop(columns=["__clean", "__own"]).assign(samples=samples, backend=made)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema)
    return rows.mapInPandas(run, f"{fields}, samples array<float>, backend string")


# Pictures


def read_screen(frames: DataFrame, backends: list[tuple[str, Loader]], strict: bool = False, least: float = 0.4) -> DataFrame:
    """Frames (media_id, frame, picture) to detections (media_id, frame, status, box, text, conf).

    A reader gives a frame's lines as JSON, in any of their shapes; malformed lines are passed over, unsure ones left out.
    A frame that no reader answers is one row of status `error`, one without detections one of status `ok` and null text.
    """
    from dubflow.operators.frames import ocr_line, readable

    got = predict(frames.select("media_id", "frame", "picture"), "picture", "lines", "array<string>", backends)
    lines = F.filter(F.transform("lines", ocr_line), lambda x: x.isNotNull() & readable(x.conf, least, strict))
    got = got.select("media_id", "frame", F.when(F.col("lines").isNull(), "error").otherwise("ok").alias("status"), F.explode_outer(lines).alias("x"))
    return got.select("media_id", "frame", "status", "x.box", "x.text", "x.conf")


def sync_lips(frames: DataFrame, engines: dict[str, list[tuple[str, Loader]]], label: str, last: Callable | None = None) -> DataFrame:
    """Frames (media_id, frame, input: what the engine needs, null without a face) with `output` and backend.

    The label picks the engine. Items without any face are not sent: their frames' output is null, as of frames that fail
    everywhere, and the picture stays as it is.
    """
    engine = "live_portrait" if "LivePortrait" in (label or "") else "wav2lip"
    kind = frames.schema["input"].dataType.simpleString()
    return predict(frames.select("media_id", "frame", "input"), "input", "output", kind, engines.get(engine, []), last=last, size=32)
