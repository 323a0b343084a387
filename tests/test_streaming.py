"""Streams cut into several batches against the same rows as one table."""

import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from dubflow.operators import cache, folds
from dubflow.plans import catalog
from dubflow.streaming import keyed
from dubflow.streaming.chunks import stream_chunk_counts


def test_all_chunks(spark):
    """Chunks that are open when the file ends are in the result."""
    path = "/root/testdata/sf0.001/events.parquet"
    got = {(r.start, r.event_type): r.n for r in stream_chunk_counts(spark, path).collect()}
    rows = spark.read.parquet(path).groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours").start.alias("start"), "event_type").count().collect()
    assert got == {(r["start"], r["event_type"]): r["count"] for r in rows}


def streamed(spark, tmp_path, rows, schema, step, ddl, names, order):
    """The rows as three files, one a batch."""
    size = -(-len(rows) // 3)
    for k in range(3):
        spark.createDataFrame(rows[k * size : k * size + size], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = keyed.keyed(source, order, ddl, names, step)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(query.recentProgress) >= 3
    return spark.read.schema(ddl).parquet(str(tmp_path / "out"))


def test_voices(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k % 3, k, f"s{rng.randrange(5)}") for k in range(60)]
    schema = "media_id long, seq long, speaker string"
    got = streamed(spark, tmp_path, rows, schema, keyed.assign_voices(["a", "b", "c"]), schema + ", voice string", ["seq", "speaker", "voice"], ["seq"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, folds.assign_voices(spark.createDataFrame(rows, schema), ["a", "b", "c"]).collect()))


def test_ttl(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k % 2, k, f"k{rng.randrange(6)}", float(k), rng.random() < 0.8) for k in range(120)]
    schema = "media_id long, seq long, key string, at double, ok boolean"
    got = streamed(spark, tmp_path, rows, schema, keyed.ttl_cache(25.0, 3), "media_id long, seq long, hit boolean", ["seq", "hit"], ["at", "seq"])
    want = cache.ttl_hits(spark.createDataFrame(rows, schema), 25.0, 3).select("media_id", "seq", "hit")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_progress_and_cancel(spark, tmp_path):
    told, rows = [], spark.readStream.format("rate").option("rowsPerSecond", 50).load()
    listener = keyed.Progress(told.append)
    spark.streams.addListener(listener)
    try:
        query = rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
        assert not keyed.run_until(query, lambda: query.lastProgress is not None, 0.2) and not query.isActive
        done = spark.readStream.schema("n_nationkey int").parquet("/root/testdata/sf0.001/nation.parquet".rsplit("/", 1)[0]).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
        assert keyed.run_until(done, lambda: False)
    finally:
        spark.streams.removeListener(listener)
    assert keyed.cancellable(spark, "some", lambda: spark.range(3).count()) == 3


def test_streamed_chunks(spark, tmp_path):
    zero = datetime(2024, 1, 1)
    rows = [(zero + timedelta(hours=h), t) for h, t in [(0, "a"), (5.9, "a"), (6, "b"), (40, "a"), (3, "b"), (41, "a"), (47.9, "c")]]
    spark.createDataFrame(rows, "ts timestamp, event_type string").coalesce(1).write.parquet(str(tmp_path / "out"))
    next((tmp_path / "out").glob("*.parquet")).rename(tmp_path / "events.parquet")
    want = Counter((zero + (t - zero) // timedelta(hours=6) * timedelta(hours=6), e) for t, e in rows)
    got = catalog.QUERIES["streamed_chunks"](spark, str(tmp_path)).selectExpr("cast(start AS string) AS start", "event_type", "n").collect()
    assert {(datetime.fromisoformat(r.start), r.event_type): r.n for r in got} == want and len(got) == len(want)
