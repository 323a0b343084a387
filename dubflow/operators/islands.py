"""Gaps and islands over ordered segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dubflow.functions.text import strip


def in_order():
    """An item's rows in their order."""
    return Window.partitionBy("media_id").orderBy("seq")


def islands(df: DataFrame, starts: Column, name: str = "island") -> DataFrame:
    return df.withColumn(name, F.sum(starts.cast("int")).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))


def clean_segments(df: DataFrame, most: int = 4, gap: float = 5.0) -> DataFrame:
    """Drops blanks and what comes more than `most` times (texts of over 3 characters), merges repeats that follow closely."""
    key = F.lower(strip(F.col("text")))
    rows = df.where(strip(F.col("text")) != "").withColumn("key", key)
    nth = F.row_number().over(Window.partitionBy("media_id", "key").orderBy("seq"))
    rows = rows.withColumn("nth", nth).where((F.length("key") <= 3) | (F.col("nth") <= most))
    new = ~F.coalesce((F.col("key") == F.lag("key").over(in_order())) & (F.col("start_s") - F.lag("end_s").over(in_order()) < gap), F.lit(False))
    rows = islands(rows.withColumn("new", new), F.col("new"))
    return rows.groupBy("media_id", "island").agg(F.min("seq").alias("seq"), F.min_by("start_s", "seq").alias("start_s"), F.max_by("end_s", "seq").alias("end_s"), F.min_by("text", "seq").alias("text")).drop("island")


def speaker_runs(df: DataFrame) -> DataFrame:
    """Runs of one speaker: first start, last end, texts joined."""
    new = ~F.coalesce(F.col("speaker") == F.lag("speaker").over(in_order()), F.lit(False))
    rows = islands(df.withColumn("new", new), F.col("new"))
    runs = rows.groupBy("media_id", "island").agg(F.min("speaker").alias("speaker"), F.min_by("start_s", "seq").alias("start_s"), F.max_by("end_s", "seq").alias("end_s"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x.text), "").alias("text"))
    return runs.withColumn("text", strip(F.col("text")))


def energy_speech(df: DataFrame, frame: float, quantile: float = 0.3, least: float = 0.5, gap: float = 0.3) -> DataFrame:
    """Speech regions of frames (media_id, seq from 0, val): runs above the quantile, short ones dropped, near ones merged.

    A run ends where the first frame without speech begins, the last one at the end of the frames.
    """
    cut = df.groupBy("media_id").agg(F.percentile("val", F.lit(quantile)).alias("cut"))
    loud = df.join(cut, "media_id").where("val > cut").withColumn("run", F.col("seq") - F.row_number().over(in_order()))
    runs = loud.groupBy("media_id", "run").agg((F.min("seq") * frame).alias("start_s"), ((F.max("seq") + 1) * frame).alias("end_s")).where(F.col("end_s") - F.col("start_s") >= least)
    w = Window.partitionBy("media_id").orderBy("start_s")
    new = ~F.coalesce(F.col("start_s") - F.lag("end_s").over(w) < gap, F.lit(False))
    runs = runs.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(w))
    return runs.groupBy("media_id", "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).drop("island")
