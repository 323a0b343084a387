"""Whole waveforms, one array a row: WAV files in and out, mel spectra, spectral matching.

Kernels run over Arrow batches, a waveform at a time; none sees more than one batch.
"""

from __future__ import annotations

import io
import os
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WAVEFORM = "path string, sample_rate int, channels int, samples array<float>, error string"
MEL = {"rate": 16_000, "size": 800, "hop": 200, "bands": 80, "low": 55.0, "high": 7600.0}


def decode(content: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and samples [channels, frames] from -1 to 1 of 8, 16, 24 or 32 bit PCM."""
    with wave.open(io.BytesIO(content)) as f:
        width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
        raw = f.readframes(f.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = wide.view("<i4").ravel().astype(np.float32) / float(1 << 31)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / float(1 << (8 * width - 1))
    if not len(x):
        raise ValueError("no samples")
    return rate, x.reshape(-1, channels).T


def encode(x: np.ndarray, rate: int) -> bytes:
    """16-bit PCM of [channels, frames]."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(len(x))
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.clip(np.round(x.T * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation along the last axis."""
    if rate == target:
        return x
    at = np.arange(max(1, round(x.shape[-1] * target / rate))) * (rate / target)
    return np.stack([np.interp(at, np.arange(x.shape[-1]), c) for c in x]).astype(np.float32)


def read_wav(spark: SparkSession, path: str, rate: int | None = None, mono: bool = False) -> DataFrame:
    """A row a file; samples channel after channel. A file that can't be decoded, or is empty, has `error` and no samples."""

    def run(batches):
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"]):
                try:
                    found, x = decode(c)
                    x = resample(x.mean(0, keepdims=True) if mono else x, found, rate or found)
                    rows.append((p, rate or found, len(x), x.ravel(), None))
                except Exception as e:  # the row carries it
                    rows.append((p, None, None, None, repr(e)))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "channels", "samples", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, WAVEFORM)


def wav_bytes(waves: DataFrame) -> DataFrame:
    """(name, content): the WAV files of (name, sample_rate, channels, samples); store them as a binary column or by a sink of your own."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"name": b["name"], "content": [encode(np.asarray(s, np.float32).reshape(int(c), -1), int(r)) for s, r, c in zip(b["samples"], b["sample_rate"], b["channels"])]})

    return waves.select("name", "sample_rate", "channels", "samples").mapInPandas(run, "name string, content binary")


def spectrum(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Complex [frames, bins] of Hann windows centred on every hop, zeros beyond the ends."""
    padded = np.pad(x, size // 2)
    frames = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop]
    return np.fft.rfft(frames * _hann(size), axis=1)


def waveform(s: np.ndarray, size: int, hop: int, length: int) -> np.ndarray:
    """The inverse of spectrum: overlapped windows over their summed squares."""
    w, total = _hann(size), (len(s) - 1) * hop + size
    out, weight = np.zeros(total), np.zeros(total)
    for i, frame in enumerate(np.fft.irfft(s, size, axis=1)):
        out[i * hop : i * hop + size] += frame * w
        weight[i * hop : i * hop + size] += w * w
    x = (out / np.maximum(weight, 1e-8))[size // 2 : size // 2 + length]
    return np.pad(x, (0, length - len(x)))


def _hann(size: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)


def mel_filters(rate: int, size: int, bands: int, low: float, high: float) -> np.ndarray:
    """Triangles of equal area on a scale linear below 1 kHz and logarithmic above, [bands, bins]."""
    step = np.log(6.4) / 27
    to_mel = lambda f: np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) / step)
    to_hz = lambda m: np.where(m < 15, m * 200 / 3, 1000 * np.exp(step * (m - 15)))
    edges = to_hz(np.linspace(to_mel(np.float64(low)), to_mel(np.float64(high)), bands + 2))
    f = np.fft.rfftfreq(size, 1 / rate)
    up = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mel(x: np.ndarray, rate: int) -> np.ndarray:
    """Normalised log mel spectrum [frames, bands] of a mono waveform, after pre-emphasis."""
    x = resample(x[None], rate, MEL["rate"])[0].astype(np.float64)
    x = np.append(x[:1], x[1:] - 0.97 * x[:-1])
    s = np.abs(spectrum(x, MEL["size"], MEL["hop"])) @ mel_filters(MEL["rate"], MEL["size"], MEL["bands"], MEL["low"], MEL["high"]).T
    return np.clip((20 * np.log10(np.maximum(1e-5, s)) - 20 + 100) / 100, 0, 1)


def mel_frames(waves: DataFrame) -> DataFrame:
    """(media_id, sample_rate, samples) of mono waveforms to (media_id, frame, mel). No samples, no frames."""

    def run(batches):
        for b in batches:
            for i, r, s in zip(b["media_id"], b["sample_rate"], b["samples"]):
                if s is not None and len(s):
                    m = mel(np.asarray(s, np.float32), int(r))
                    yield pd.DataFrame({"media_id": i, "frame": np.arange(len(m), dtype=np.int32), "mel": list(m)})

    return waves.select("media_id", "sample_rate", "samples").mapInPandas(run, "media_id long, frame int, mel array<double>")


def match(source: np.ndarray, reference: np.ndarray, strength: float = 0.5, size: int = 2048, hop: int = 512) -> np.ndarray:
    """source with its mean spectrum moved towards the reference's by a share; phase and length stay."""
    s = spectrum(np.asarray(source, np.float64), size, hop)
    to, at = np.abs(spectrum(np.asarray(reference, np.float64), size, hop)).mean(0), np.abs(s).mean(0)
    gain = np.clip(to / np.maximum(at, 1e-10), 0.3, 3) * strength + (1 - strength)
    return waveform(s * gain, size, hop, len(source)).astype(np.float32)


def match_spectra(clips: DataFrame, references: DataFrame, strength: float = 0.5) -> DataFrame:
    """clips (media_id, seq, samples), references (media_id, reference) to (media_id, seq, samples, matched); without a reference a clip stays."""

    def run(batches):
        for b in batches:
            out, done = [], []
            for s, r in zip(b["samples"], b["reference"]):
                ok = s is not None and r is not None and len(s) > 0 and len(r) > 0
                out.append(match(s, r, strength) if ok else s)
                done.append(ok)
            yield pd.DataFrame({"media_id": b["media_id"], "seq": b["seq"], "samples": out, "matched": done})

    rows = clips.join(references.select("media_id", "reference"), "media_id", "left")
    return rows.select("media_id", "seq", F.col("samples"), "reference").mapInPandas(run, "media_id long, seq int, samples array<float>, matched boolean")


def run_command(files: DataFrame, attempts: list[list[str]]) -> DataFrame:
    """Media tools at their boundary: (source, target) to (source, target or null), by the first command that succeeds.

    `{source}`, `{target}` and, if the rows have it, `{audio}` stand for the row's paths, on storage that all executors mount.
    A retried task writes anew.
    """

    def run(batches):
        import subprocess

        for b in batches:
            got = []
            for s, t, u in zip(b["source"], b["target"], b["audio"]):
                done = None
                for a in attempts:
                    try:
                        subprocess.run([x.format(source=s, target=t, audio=u) for x in a], check=True, capture_output=True)
                        done = t if os.path.exists(t) else None
                    except (OSError, subprocess.CalledProcessError):
                        continue
                    if done:
                        break
                got.append(done)
            yield pd.DataFrame({"source": b["source"], "target": got})

    audio = F.col("audio") if "audio" in files.columns else F.lit("")
    return files.select("source", "target", audio.alias("audio")).mapInPandas(run, "source string, target string")


EXTRACT_AUDIO = [["ffmpeg", "-y", "-i", "{source}", "-vn", "-ac", "1", "-ar", "24000", "{target}"]]
# First the picture as it is, else encoded again.
REPLACE_AUDIO = [
    ["ffmpeg", "-y", "-i", "{source}", "-i", "{audio}", "-c:v", "copy", "-c:a", "aac", "-map", "0:v:0", "-map", "1:a:0", "-shortest", "{target}"],
    ["ffmpeg", "-y", "-i", "{source}", "-i", "{audio}", "-c:v", "libx264", "-c:a", "aac", "-map", "0:v:0", "-map", "1:a:0", "-shortest", "{target}"],
]


def joined_clips(clips: list[np.ndarray], rate: int, overlap: float = 0.05) -> np.ndarray:
    """Mono clips one after the other, linear ramps of `overlap` seconds over each other where two meet."""
    out = np.zeros(0, np.float32)
    for c in clips:
        c = np.asarray(c, np.float32)
        n = min(int(overlap * rate), len(out), len(c))
        ramp = np.linspace(0, 1, n, dtype=np.float32)
        met = out[len(out) - n :] * (1 - ramp) + c[:n] * ramp
        out = np.concatenate([out[: len(out) - n], met, c[n:]])
    return out


def spoken_sentences(parts: DataFrame, rate: int, overlap: float = 0.05) -> DataFrame:
    """Sentences' clips (media_id, seq, part, samples) to one clip a segment (media_id, seq, samples), in the order of part."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("part")
        return pd.DataFrame([(*key, joined_clips(rows["samples"].tolist(), rate, overlap))], columns=["media_id", "seq", "samples"])

    return parts.where("samples is not null").groupBy("media_id", "seq").applyInPandas(run, "media_id long, seq long, samples array<float>")


def write_wav(waves: DataFrame, folder: str) -> DataFrame:
    """Writes (name, sample_rate, channels, samples) as folder/name on a path that all executors see; (path, length) of the files.

    A file appears whole under its name, so a task that runs again replaces it.
    """

    def run(batches):
        from pyarrow import fs as pafs

        files, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        files.create_dir(root, recursive=True)
        for b in batches:
            out = []
            for name, content in zip(b["name"], b["content"]):
                part = f"{root}/.{name}.{os.getpid()}"
                with files.open_output_stream(part) as f:
                    f.write(content)
                files.move(part, f"{root}/{name}")
                out.append((f"{folder}/{name}", len(content)))
            yield pd.DataFrame(out, columns=["path", "length"])

    return wav_bytes(waves).mapInPandas(run, "path string, length long")


def stretched(x: np.ndarray, speed: float, size: int = 1024, hop: int = 256) -> np.ndarray:
    """x played `speed` times as fast at its pitch: a phase vocoder."""
    s = spectrum(np.asarray(x, np.float64), size, hop)
    steps = np.arange(0, max(1e-9, len(s) - 1), speed)
    low = steps.astype(int)
    high, share = np.minimum(low + 1, len(s) - 1), (steps - low)[:, None]
    size_of = abs(s[low]) * (1 - share) + abs(s[high]) * share
    expected = 2 * np.pi * hop * np.arange(s.shape[1]) / size
    turn = np.angle(s[high]) - np.angle(s[low]) - expected
    turn = turn - 2 * np.pi * np.round(turn / (2 * np.pi)) + expected
    phase = np.angle(s[0]) + np.concatenate([np.zeros((1, s.shape[1])), np.cumsum(turn, axis=0)[:-1]])
    return waveform(size_of * np.exp(1j * phase), size, hop, round(len(x) / speed))


def fitted(x: np.ndarray, rate: int, target: float) -> np.ndarray:
    """A clip at its target length, as media.sync_plan says: as it is, padded or cut, or stretched."""
    x = np.asarray(x, np.float64)
    seconds = len(x) / rate
    if seconds <= 0 or target <= 0 or 0.95 < seconds / target < 1.05:
        return x
    if seconds / target < 0.25 or seconds / target > 4:
        n = int(target * rate)
        return np.pad(x[:n], (0, max(0, n - len(x))))
    return stretched(x, seconds / target)


def fit_clips(clips: DataFrame) -> DataFrame:
    """(media_id, seq, samples, sample_rate, target) to (media_id, seq, samples) of the target length."""

    def run(batches):
        for b in batches:
            out = [fitted(s if s is not None else [], int(r), float(t)).astype(np.float32) for s, r, t in zip(b["samples"], b["sample_rate"], b["target"])]
            yield pd.DataFrame({"media_id": b["media_id"], "seq": b["seq"], "samples": out})

    return clips.select("media_id", "seq", "samples", "sample_rate", "target").mapInPandas(run, "media_id long, seq long, samples array<float>")
