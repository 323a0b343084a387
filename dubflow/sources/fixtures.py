"""Adapters from the driver's tables to the engine's schemas, and the same rows as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, seq, start_s, end_s (hours since 2024), speaker, val, k."""
    zero = F.unix_micros(F.expr("cast(timestamp_ntz'2024-01-01 00:00:00' as timestamp)"))
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - zero) / F.lit(1e6) / 3600
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("media_id"), seq.alias("seq"), start.alias("start_s"), F.col("event_type").alias("speaker"), F.col("value").alias("val"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return rows.withColumn("end_s", F.col("start_s") + F.col("val") / 10)


EV = """ev AS (SELECT user_id AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS seq,
    (epoch_us(ts) - 1704067200000000) / 1e6 / 3600 AS start_s, (epoch_us(ts) - 1704067200000000) / 1e6 / 3600 + value / 10 AS end_s,
    event_type AS speaker, value AS val, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""


def conversation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, seq, start_s, end_s (16 characters a second), speaker, text; every fourth text is blank."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), F.expr("if(turn % 4 = 3, '', text)").alias("text"), (F.length("text") / 16).alias("dur"))
    before = Window.partitionBy("media_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start_s", F.coalesce(F.sum("dur").over(before), F.lit(0.0)))
    return rows.select("media_id", "seq", "start_s", (F.col("start_s") + F.col("dur")).alias("end_s"), "speaker", "text")


CS = """cs AS (SELECT media_id, seq, start_s, start_s + dur AS end_s, speaker, text FROM (
    SELECT conv_id AS media_id, turn AS seq, role AS speaker, CASE WHEN turn % 4 = 3 THEN '' ELSE text END AS text, length(text) / 16.0::DOUBLE AS dur,
        coalesce(sum(length(text) / 16.0::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS start_s
    FROM conversations))"""
