"""Text formats: RTTM, delimited worker output, the flat JSON cache, subtitles."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_rttm(lines: DataFrame) -> DataFrame:
    """Adds start_s, end_s, speaker to the lines (column value) with at least 8 tokens, the first SPEAKER."""
    t = F.split(F.trim("value"), r"\s+")
    rows = lines.withColumn("t", t).where((F.size("t") >= 8) & (F.get("t", F.lit(0)) == "SPEAKER"))
    start = F.get("t", F.lit(3)).cast("double")
    return rows.withColumns({"start_s": start, "end_s": start + F.get("t", F.lit(4)).cast("double"), "speaker": F.get("t", F.lit(7))}).drop("t", "value")


def worker_payload(output: Column, schema: str) -> Column:
    """The JSON between the worker's marks, also in the output of a crashed one; null without."""
    found = F.regexp_extract(output, r"(?s)<<<<JSON>>>>(.*?)<<<<ENDJSON>>>>", 1)
    return F.from_json(F.when(found != "", found), schema)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(key, translated) of a flat JSON cache; nothing if it is missing or corrupt."""
    schema = "key string, translated string"
    try:
        raw = spark.read.text(path, wholetext=True)
    except Exception as e:  # the path is missing: an empty cache
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "translated"))


def write_cache(cache: DataFrame, path: str, single: bool = False) -> None:
    """A JSON object per partition, non-ASCII kept; single: one object in one file, its entries streamed by one task, for
    readers of the flat form. The table form of a cache is Parquet."""
    rows = cache.select("key", "translated")
    if single:

        def lines(batches):
            first = True
            for b in batches:
                entries = [f"{json.dumps(k, ensure_ascii=False)}: {json.dumps(v, ensure_ascii=False)}" for k, v in zip(b["key"], b["translated"])]
                yield pd.DataFrame({"value": [("{" if first and not i else ",") + e for i, e in enumerate(entries)]})
                first = first and not entries
            yield pd.DataFrame({"value": ["{}" if first else "}"]})

        rows.coalesce(1).mapInPandas(lines, "value string").write.mode("error").text(path)
        return
    rows.groupBy(F.spark_partition_id().alias("p")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "translated")))).alias("value")).select("value").write.mode("error").text(path)


def write_srt(blocks: DataFrame, path: str) -> None:
    """A folder per media item with its subtitles (media_id, srt)."""
    blocks.select("media_id", F.col("srt").alias("value")).write.mode("error").partitionBy("media_id").option("lineSep", "").text(path)


def write_manifest(files: DataFrame, path: str) -> None:
    """A JSON line for each audio file (path, seconds), as a diarizer's manifest has them; null fields are written."""
    line = F.struct(
        F.col("path").alias("audio_filepath"), F.lit(0).alias("offset"), F.col("seconds").alias("duration"), F.lit("infer").alias("label"), F.lit("-").alias("text"),
        F.lit(None).cast("int").alias("num_speakers"), F.lit(None).cast("string").alias("rttm_filepath"), F.lit("").alias("uniq_id"),
    )
    files.select(F.to_json(line, {"ignoreNullFields": "false"}).alias("value")).write.mode("error").text(path)


# The media files that are taken.
MEDIA = "*.{mp4,avi,mov,mkv}"


def media_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified) of the media files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", MEDIA).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def concatenated(chunks: DataFrame, length: str = "frames") -> DataFrame:
    """Rows (media_id, chunk, at, ...) of all chunks on one time line: `at` plus the lengths of the chunks before.

    Chunks go by number, so the thousandth comes after the second. `length` is a chunk's own length, equal in all its
    rows; no row is dropped, none made one.
    """
    each = chunks.groupBy("media_id", "chunk").agg(F.max(length).alias("__length"))
    before = Window.partitionBy("media_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select("media_id", "chunk", F.coalesce(F.sum("__length").over(before), F.lit(0)).alias("__start"))
    return chunks.join(starts, ["media_id", "chunk"]).withColumn("at", F.col("at") + F.col("__start")).drop("__start")


def chunk_number(name: Column) -> Column:
    """The number at the end of a chunk's name, which sorts as the name should; null without one."""
    return F.regexp_extract(F.regexp_replace(name, r"\.[A-Za-z]\w*$", ""), r"(\d+)$", 1).try_cast("long")


def first_mirror(attempts: DataFrame) -> DataFrame:
    """(item, url) of the first mirror, by position, that answered 200 with a whole file (item, position, url, status, whole);
    refused ones (401, 403) and failures are passed over, an item without any has a null url."""
    good = (F.col("status") == 200) & F.coalesce(F.col("whole"), F.lit(False))
    return attempts.groupBy("item").agg(F.min_by("url", F.when(good, F.col("position"))).alias("first"), F.count_if(good).alias("n")).select("item", F.when(F.col("n") > 0, F.col("first")).alias("url"))
