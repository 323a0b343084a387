"""Column expressions on clips, frames and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sync_plan(seconds: Column, target: Column) -> Column:
    """How a clip gets its target length: action, speed and the tempo steps, each from 0.5 to 2, whose product is the speed."""
    speed = F.when((seconds > 0) & (target > 0), seconds / target)
    action = F.when(speed.isNull(), "unchanged").when((speed > 0.95) & (speed < 1.05), "copy").when((speed < 0.25) | (speed > 4), "fit").otherwise("stretch")
    steps = F.greatest(F.lit(0), F.ceil(F.abs(F.log2(speed))) - 1).cast("int")
    step = F.when(speed > 1, 2.0).otherwise(0.5)
    return F.struct(action.alias("action"), speed.alias("speed"), F.concat(F.array_repeat(step, steps), F.array(speed / F.pow(step, steps))).alias("tempo"))


def frame_range(start: Column, end: Column, total: Column, before: int = 0, after: int = 0) -> Column:
    """The padded range [first, last) within the media, and where `start` lies in it."""
    first = F.greatest(F.lit(0), start - before)
    return F.struct(first.alias("first"), F.least(total, end + after).alias("last"), (start - first).alias("inside"))


def clamped(start: Column, end: Column, length: Column, least: float = 0.3) -> Column:
    """(start, end) within the media, null where less than `least` seconds are left."""
    a, b = F.greatest(start, F.lit(0.0)), F.least(end, length)
    return F.when(b - a >= least, F.struct(a.alias("start_s"), b.alias("end_s")))


def within(path: Column, folder: str) -> Column:
    """Whether a path lies in a folder, by whole components; any path with .. does not."""
    root = folder.rstrip("/")
    return ((path == root) | path.startswith(root + "/")) & ~F.array_contains(F.split(path, "/"), "..")


def voice_path(name: Column) -> Column:
    """Folder of a voice file named language_REGION-speaker-quality."""
    parts = F.split(name, "-")
    part = lambda i: F.get(parts, F.lit(i))
    return F.concat_ws("/", F.get(F.split(part(0), "_"), F.lit(0)), part(0), part(1), part(2), name)


def denormalize(x: Column) -> Column:
    """The inverse of mel normalisation within its range."""
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 100 - 100


def seconds(frames: Column, rate: Column) -> Column:
    """A clip's length, 0 where it can't be told."""
    return F.coalesce(F.when(rate > 0, frames / rate), F.lit(0.0))


def whole_file(length: Column, least: int = 100, strict: bool = False) -> Column:
    """Whether a file is there (its length is known) and has at least `least` bytes, or more than that if strict."""
    n = F.coalesce(length, F.lit(0))
    return n > least if strict else n >= least


def silence(frames: Column, channels: Column) -> Column:
    """Zeros of a waveform's shape, channel after channel."""
    return F.array_repeat(F.lit(0.0).cast("float"), (frames * channels).cast("int"))
