"""Interval joins per media item, in time buckets: no task compares all of an item's rows with each other.

Overlaps meet in buckets of `bucket` seconds that both sides cover. "The last before" and "the first after" are running
maxima inside buckets plus a carry from the buckets before, so an item may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket.
BUCKET = 300.0


def latest(left: DataFrame, right: DataFrame, bucket: float = BUCKET, strict: bool = False) -> DataFrame:
    """left (media_id, at, ...) with `found`: the largest `value` of right (media_id, at, value) up to its `at`, or before
    it if strict; null where there is none. Rows of left are told apart by nothing and all stay."""
    columns = [c for c in left.columns if c not in ("media_id", "at")]
    kind = right.schema["value"].dataType
    # at one time, right comes first unless it must be earlier
    a = left.select("media_id", "at", F.lit(0 if strict else 1).alias("side"), F.struct(*columns).alias("row"), F.lit(None).cast(kind).alias("value"))
    b = right.select("media_id", "at", F.lit(1 if strict else 0).alias("side"), F.lit(None).cast(a.schema["row"].dataType).alias("row"), "value")
    both = a.unionByName(b).withColumn("b", F.floor(F.col("at") / bucket))
    sums = both.groupBy("media_id", "b").agg(F.max("value").alias("most"))
    carry = sums.select("media_id", "b", F.max("most").over(Window.partitionBy("media_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    inside = F.max("value").over(Window.partitionBy("media_id", "b").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("inside", inside).where(F.col("side") == (0 if strict else 1)).join(carry, ["media_id", "b"])
    more = F.when(F.col("carry").isNull() | (F.col("inside") >= F.col("carry")), F.col("inside")).otherwise(F.col("carry"))
    return rows.select("media_id", "at", "row.*", F.when(F.col("inside").isNull(), F.col("carry")).otherwise(more).alias("found"))


def _covering(df: DataFrame, start: str, end: str, bucket: float) -> DataFrame:
    """df once for each bucket that it covers, in `b`."""
    first, last = F.floor(F.col(start) / bucket), F.floor(F.greatest(start, end) / bucket)
    return df.withColumn("b", F.explode(F.sequence(first, last)))


def _turns(turns: DataFrame) -> DataFrame:
    return turns.select(F.col("media_id").alias("m"), F.col("seq").alias("turn_seq"), F.col("start_s").alias("a"), F.col("end_s").alias("z"), F.col("speaker").alias("turn_speaker"))


def touching(segments: DataFrame, turns: DataFrame, bucket: float = BUCKET) -> DataFrame:
    """(media_id, seq, turn_seq, turn_speaker, shared, crosses) of pairs that overlap or touch; shared seconds are 0 where they
    only touch and where one without length lies in the other, which crosses."""
    # a turn that ends where a bucket begins touches what starts there: both ends are covered
    s = _covering(segments.select("media_id", "seq", "start_s", "end_s"), "start_s", "end_s", bucket)
    t = _covering(_turns(turns), "a", "z", bucket).withColumnRenamed("b", "tb")
    meet = (F.col("media_id") == F.col("m")) & (F.col("b") == F.col("tb")) & (F.col("start_s") <= F.col("z")) & (F.col("end_s") >= F.col("a"))
    once = F.col("b") == F.floor(F.greatest("start_s", "a") / bucket)  # the first bucket that both cover
    shared = F.greatest(F.lit(0.0), F.least("end_s", "z") - F.greatest("start_s", "a"))
    crosses = (F.col("start_s") < F.col("z")) & (F.col("end_s") > F.col("a"))
    return s.join(t, meet & once).select("media_id", "seq", "turn_seq", "turn_speaker", shared.alias("shared"), crosses.alias("crosses"))


def speech_filter(segments: DataFrame, speech: DataFrame, bucket: float = BUCKET) -> DataFrame:
    """Segments that overlap a speech region; items without any region keep all.

    A segment overlaps one if the latest end among the regions that start before its end comes after its start.
    """
    regions = speech.select("media_id", F.col("start_s").alias("at"), F.col("end_s").alias("value"))
    some = speech.select(F.col("media_id").alias("m")).distinct()
    rows = segments.select("media_id", F.col("end_s").alias("at"), F.struct(*segments.columns).alias("whole"), "start_s")
    hit = latest(rows, regions, bucket, strict=True).where(F.col("found") > F.col("start_s")).select("whole.*")
    return hit.unionByName(segments.join(some, F.col("media_id") == F.col("m"), "left_anti"))


def _by_overlap() -> Column:
    return F.min_by("turn_speaker", F.struct(-F.col("shared"), F.col("turn_seq")))


def overlap_speaker(segments: DataFrame, turns: DataFrame, bucket: float = BUCKET, moments: bool = False) -> DataFrame:
    """Adds turn_speaker: of the turn with the longest overlap, the earliest of equals; null without overlap.

    moments: what has no length overlaps what it lies in, for no seconds."""
    best = touching(segments, turns, bucket).where("crosses" if moments else "shared > 0").groupBy("media_id", "seq").agg(_by_overlap().alias("turn_speaker"))
    return segments.join(best, ["media_id", "seq"], "left")


def word_speaker(words: DataFrame, turns: DataFrame, default: str = "SPEAKER_00", bucket: float = BUCKET) -> DataFrame:
    """Adds turn_speaker: by longest overlap, else of the nearest turn, the earliest of equals; without turns the default."""
    met = touching(words, turns, bucket).groupBy("media_id", "seq").agg(_by_overlap().alias("met"))
    rows = words.join(met, ["media_id", "seq"], "left")
    alone = rows.where("met is null").select("media_id", "seq", "start_s", "end_s")
    t = turns.select("media_id", "seq", "start_s", "end_s", "speaker")
    # the turn that ends last before the word, and the one that starts first after it; of equals the smallest seq
    ended = t.select("media_id", F.col("end_s").alias("at"), F.struct("end_s", (-F.col("seq")).alias("s"), "speaker").alias("value"))
    begun = t.select("media_id", (-F.col("start_s")).alias("at"), F.struct((-F.col("start_s")).alias("start"), (-F.col("seq")).alias("s"), "speaker").alias("value"))
    near = latest(alone.withColumn("at", F.col("start_s")), ended, bucket).withColumnRenamed("found", "before").drop("at")
    near = latest(near.withColumn("at", -F.col("end_s")), begun, bucket).withColumnRenamed("found", "after").drop("at")
    back, ahead = F.col("start_s") - F.col("before.end_s"), -F.col("after.start") - F.col("end_s")
    first = F.col("after.start").isNull() | (back < ahead) | ((back == ahead) & (-F.col("before.s") < -F.col("after.s")))
    near = near.select("media_id", "seq", F.when(F.col("before.end_s").isNotNull() & first, F.col("before.speaker")).otherwise(F.col("after.speaker")).alias("near"))
    return rows.join(near, ["media_id", "seq"], "left").select(*words.columns, F.coalesce("met", "near", F.lit(default)).alias("turn_speaker"))
