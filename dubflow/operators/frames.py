"""Frame tables: boxes, held detections, keypoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_frame():
    """An item's rows in their order."""
    return Window.partitionBy("media_id").orderBy("frame")


def fill(df: DataFrame, *columns: str) -> DataFrame:
    """The last known value, before the first one that."""
    for c in columns:
        back = F.last(c, True).over(by_frame().rowsBetween(Window.unboundedPreceding, 0))
        ahead = F.first(c, True).over(by_frame().rowsBetween(0, Window.unboundedFollowing))
        df = df.withColumn(c, F.coalesce(back, ahead))
    return df


def smooth(df: DataFrame, *columns: str, window: int = 5) -> DataFrame:
    """Filled, then the centred mean, cut at the ends and towards zero."""
    df = fill(df, *columns)
    near = by_frame().rowsBetween(-(window // 2), window // 2)
    return df.select(*[c for c in df.columns if c not in columns], *[F.avg(c).over(near).cast("int").alias(c) for c in columns])


def held_detection(frames: DataFrame, detections: DataFrame, every: int) -> DataFrame:
    """Each frame with the detections of its key frame; a failed key frame keeps those of the one before, an empty one clears."""
    keys = detections.select(F.col("media_id").alias("m"), F.col("frame").alias("key_frame"), "status", "text")
    good = F.last(F.when(F.col("status") != "error", F.struct(F.col("text").alias("text"))), True).over(Window.partitionBy("m").orderBy("key_frame").rowsBetween(Window.unboundedPreceding, 0))
    keys = keys.select("m", "key_frame", good["text"].alias("held"))
    return frames.withColumn("k0", F.col("frame") - F.col("frame") % every).join(keys, (F.col("media_id") == F.col("m")) & (F.col("k0") == F.col("key_frame")), "left").drop("m", "k0", "key_frame")


def lip_open(points: Column) -> Column:
    """Distance of the lips' keypoints, 0 if they are missing."""
    return F.coalesce(F.abs(F.get(F.get(points, F.lit(19)), F.lit(1)) - F.get(F.get(points, F.lit(18)), F.lit(1))), F.lit(0.0))


def lip_transfer(source: Column, driving: Column, share: float = 0.8) -> Column:
    """Keypoints 17 to 20 moved by a share of the way to the driving ones."""
    moved = F.zip_with(source, driving, lambda s, d: F.zip_with(s, d, lambda a, b: a + share * (b - a)))
    return F.transform(source, lambda p, i: F.when((i >= 17) & (i <= 20), F.get(moved, i)).otherwise(p))


def scale_boxes(boxes: Column, scale: float) -> Column:
    return boxes if scale == 1.0 else F.transform(boxes, lambda p: F.struct((p.x / scale).alias("x"), (p.y / scale).alias("y")))


def ocr_size(width: Column, height: Column, most: int = 1280) -> Column:
    scale = F.lit(most) / width
    return F.when(width <= most, F.struct(width.alias("w"), height.alias("h"))).otherwise(F.struct(F.lit(most).cast("int").alias("w"), (height * scale).cast("int").alias("h")))


def largest(df: DataFrame, area: Column, last_of_equals: bool = True) -> DataFrame:
    """Per frame the row with the largest area."""
    order = F.struct(area, F.col("pos") if last_of_equals else -F.col("pos"))
    return df.groupBy("media_id", "frame").agg(F.max_by("pos", order).alias("pos"), F.max(area).alias("area"))


def zip_frames(source: DataFrame, driving: DataFrame) -> DataFrame:
    """Source frames with the driving frame of the same number; beyond the last the last is held. No driving frames, no rows."""
    last = driving.groupBy("media_id").agg(F.max("frame").alias("__last"))
    rows = source.join(last, "media_id").withColumn("__at", F.least("frame", "__last"))
    return rows.join(driving.withColumnRenamed("frame", "__at"), ["media_id", "__at"]).drop("__at", "__last")


def readable(confidence: Column, least: float = 0.4, strict: bool = False) -> Column:
    """Whether a detection counts: at least `least`, or above it; a missing confidence counts as 1."""
    c = F.coalesce(confidence, F.lit(1.0))
    return c > least if strict else c >= least


def ocr_line(line: Column) -> Column:
    """(box, text, conf) of a detected line's JSON in any of its shapes, null if it has none of them:
    {"text_region", "text", "confidence"}, [box, [text, confidence]], [box, text]. A missing confidence is 1."""
    get = lambda path: F.get_json_object(line, path)
    point = "array<array<double>>"
    as_dict = F.when(get("$.text_region").isNotNull() & get("$.text").isNotNull(), F.struct(F.from_json(get("$.text_region"), point).alias("box"), get("$.text").alias("text"), F.coalesce(get("$.confidence").cast("double"), F.lit(1.0)).alias("conf")))
    pair = get("$[1]").startswith("[")
    as_list = F.when(get("$[0]").isNotNull() & get("$[1]").isNotNull(), F.struct(F.from_json(get("$[0]"), point).alias("box"), F.when(pair, get("$[1][0]")).otherwise(get("$[1]")).alias("text"), F.when(pair, F.coalesce(get("$[1][1]").try_cast("double"), F.lit(1.0))).otherwise(1.0).alias("conf")))
    found = F.coalesce(as_dict, as_list)
    return F.when(found.box.isNotNull() & found.text.isNotNull(), found)


def square_crop(box: Column, width: Column, height: Column, scale: float = 2.3, size: int = 256) -> Column:
    """The square round a face (x1, y1, x2, y2), clamped to the frame: x1, y1, x2, y2 and the inverse map's scales, pixels
    of the frame to one of the crop resized to `size`."""
    side = (F.greatest(box.x2 - box.x1, box.y2 - box.y1) * scale).cast("int")
    x1 = F.greatest(F.lit(0), ((box.x1 + box.x2) / 2 - side / 2).cast("int"))
    y1 = F.greatest(F.lit(0), ((box.y1 + box.y2) / 2 - side / 2).cast("int"))
    x2, y2 = F.least(width, x1 + side), F.least(height, y1 + side)
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), ((x2 - x1) / size).alias("scale_x"), ((y2 - y1) / size).alias("scale_y"))


def expanded(box: Column, width: Column, height: Column, factor: float = 1.6) -> Column:
    """A face box grown round its centre and clamped to the frame."""
    w, h = box.x2 - box.x1, box.y2 - box.y1
    cx, cy = box.x1 + w / 2, box.y1 + h / 2
    return F.struct(
        F.greatest(F.lit(0), (cx - w * factor / 2).cast("int")).alias("x1"), F.greatest(F.lit(0), (cy - h * factor / 2).cast("int")).alias("y1"),
        F.least(width, (cx + w * factor / 2).cast("int")).alias("x2"), F.least(height, (cy + h * factor / 2).cast("int")).alias("y2"),
    )


def fitted_font(text: Column, width: Column, height: Column, em: float = 0.6, least: int = 8) -> Column:
    """The size a text is drawn in: two more than its box's height, two less at a time until it fits the width or is `least`.

    em: a character's mean width in a size of 1; a font's own measure may stand in its place.
    """
    first = F.greatest(F.lit(least), (height + 2).cast("int"))
    steps = F.greatest(F.lit(0), F.ceil((first - F.lit(least)) / 2)).cast("int")
    needed = F.greatest(F.lit(0), F.ceil((first - width / (F.greatest(F.lit(1), F.length(text)) * em)) / 2)).cast("int")
    return (first - 2 * F.least(steps, needed)).cast("int")


def retargeted(source: Column, driving: Column, delta: Column) -> Column:
    """Keypoints moved by a model's deltas (their coordinates in one array); without deltas the lips are moved by a share."""
    moved = F.transform(source, lambda p, i: F.transform(p, lambda v, j: v + F.get(delta, i * 3 + j)))
    return F.when(delta.isNotNull() & (F.size(delta) >= 3 * F.size(source)), moved).otherwise(lip_transfer(source, driving))


def stitched(driving: Column, delta: Column, share: float = 0.5) -> Column:
    """Driving keypoints with half a model's deltas, of which those beyond the keypoints' coordinates are left out; without
    deltas as they are."""
    moved = F.transform(driving, lambda p, i: F.transform(p, lambda v, j: v + share * F.get(delta, i * 3 + j)))
    return F.when(delta.isNotNull() & (F.size(delta) >= 3 * F.size(driving)), moved).otherwise(driving)


def mel_windows(mel: DataFrame, steps: int = 16) -> DataFrame:
    """(media_id, step, values) to (media_id, step, window): the values of `steps` steps from each on, zeros past the end."""
    ahead = Window.partitionBy("media_id").orderBy("step").rowsBetween(0, steps - 1)
    got = mel.select("media_id", "step", F.collect_list("values").over(ahead).alias("w"), F.size("values").alias("n"))
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), F.col("n")), F.lit(steps) - F.size("w"))
    return got.select("media_id", "step", F.concat("w", zeros).alias("window"))


def audio_windows(rows: DataFrame, mel: DataFrame, fps: float, offset: int = 0, steps: int = 16, around: int = 2) -> DataFrame:
    """Frames (media_id, frame) with `window`, the spectrum at the frame's time, and `context`, those of the frames around it,
    the first frame's before the start. Windows that begin past the end are null."""
    windows = mel_windows(mel, steps)
    at = lambda f: (f * 80.0 / fps).cast("long")
    wanted = F.concat(F.array(F.struct(F.lit(-1).alias("i"), (at(F.col("frame")) + offset).alias("step"))), *[F.array(F.struct(F.lit(i + around).alias("i"), at(F.greatest(F.lit(0), F.col("frame") + i)).alias("step"))) for i in range(-around, around + 1)])
    each = rows.select("media_id", "frame", F.explode(wanted).alias("x")).select("media_id", "frame", "x.i", "x.step")
    each = each.join(windows, ["media_id", "step"], "left").groupBy("media_id", "frame").agg(F.array_sort(F.collect_list(F.struct("i", "window"))).alias("l"))
    return each.select("media_id", "frame", F.get("l", F.lit(0)).window.alias("window"), F.transform(F.slice("l", 2, 2 * around + 1), lambda x: x.window).alias("context"))
