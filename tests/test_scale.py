"""Interval joins, folds and clustering against plain loops on random rows, and on one long item."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from dubflow.operators import cache, folds, intervals, signal

SEGMENT = "media_id long, seq long, start_s double, end_s double"


def spans(rng, n, media=3, most=40.0):
    """Some of no length, some that touch, some equal."""
    out = []
    for k in range(n):
        a = rng.choice((rng.uniform(0, most), float(rng.randrange(int(most)))))
        out.append((rng.randrange(media), k, a, a + rng.choice((0.0, 1.0, rng.uniform(0, 9)))))
    return out


def brute_speaker(w, turns, nearest):
    best = None
    for m, k, a, z, who in turns:
        if m == w[0]:
            shared = max(0, min(z, w[3]) - max(a, w[2]))
            away = a - w[3] if a >= w[3] else max(0, w[2] - z)
            rank = (0, -shared, k) if shared > 0 else (1, away, k)
            if (shared > 0 or nearest) and (best is None or rank < best[0]):
                best = (rank, who)
    return best[1] if best else "SPEAKER_00" if nearest else None


@pytest.mark.parametrize("seed", range(3))
def test_intervals(spark, seed):
    rng = random.Random(seed)
    words, turns = spans(rng, 80), [(*t, f"S{t[1] % 5}") for t in spans(rng, 25, 2)]
    w, t = spark.createDataFrame(words, SEGMENT).repartition(3), spark.createDataFrame(turns, SEGMENT + ", speaker string").repartition(2)
    for bucket in (2.0, 7.0, 1000.0):
        got = {r.seq: r.turn_speaker for r in intervals.word_speaker(w, t, bucket=bucket).collect()}
        assert got == {x[1]: brute_speaker(x, turns, True) for x in words}
        got = {r.seq: r.turn_speaker for r in intervals.overlap_speaker(w, t, bucket).collect()}
        assert got == {x[1]: brute_speaker(x, turns, False) for x in words}
        got = {r.seq for r in intervals.speech_filter(w, t, bucket).collect()}
        assert got == {x[1] for x in words if not any(y[0] == x[0] for y in turns) or any(y[0] == x[0] and x[2] < y[3] and x[3] > y[2] for y in turns)}
    assert intervals.word_speaker(w, t.limit(0)).where("turn_speaker = 'SPEAKER_00'").count() == 80
    assert intervals.speech_filter(w.limit(0), t).count() == 0 == intervals.overlap_speaker(w.limit(0), t).count()


def test_overlaps_of_no_length(spark):
    """A moment inside a turn overlaps it for no seconds; one at a turn's edge does not. The query's SQL counts such moments."""
    w = spark.createDataFrame([(1, 1, 2.0, 2.0), (1, 2, 0.0, 0.0), (1, 3, 5.0, 5.0), (1, 4, 6.0, 9.0), (1, 5, 3.0, 3.0)], SEGMENT)
    t = spark.createDataFrame([(1, 1, 0.0, 5.0, "a"), (1, 2, 7.0, 7.0, "b"), (1, 3, 1.0, 4.0, "c")], SEGMENT + ", speaker string")
    for bucket in (2.0, 1000.0):
        got = {r.seq: r.turn_speaker for r in intervals.overlap_speaker(w, t, bucket, moments=True).collect()}
        assert got == {1: "a", 2: None, 3: None, 4: "b", 5: "a"}
        assert {r.turn_speaker for r in intervals.overlap_speaker(w, t, bucket).collect()} == {None}


def test_overlap_query_with_moments(spark, tmp_path):
    import duckdb

    from dubflow.plans.catalog import ORACLES, QUERIES

    db = duckdb.connect()
    times = "(0, 1, 10.0, 2), (1, 2, 0.0, 1), (2, 3, 0.0, 2), (3, 9, 40.0, 4)"
    db.sql(f"copy (select i::BIGINT as event_id, TIMESTAMP '2024-01-01' + to_minutes((h * 15)::BIGINT) as ts, 1::BIGINT as user_id, 'e' || i as event_type, v::DOUBLE as value, '{{\"k\": ' || k || '}}' as props from (values {times}) t(i, h, v, k)) to '{tmp_path}/events.parquet' (format parquet)")
    db.sql(f"create view events as from '{tmp_path}/events.parquet'")
    want = sorted(db.sql(ORACLES["overlap_speaker"]).fetchall())
    assert sorted(map(tuple, QUERIES["overlap_speaker"](spark, str(tmp_path)).collect())) == want
    assert [w[2] for w in want] == ["e0", "e0", "e0", "e3"]


def test_one_long_item(spark):
    """Folds are linear in an item's rows: ten times as many take far less than a hundred times as long."""
    rows = lambda n: spark.range(n).select(F.lit(1).alias("media_id"), F.col("id").alias("seq"), (F.col("id") * 0.5).alias("start_s"), F.lit(0.7).alias("actual_dur"), F.lit(True).alias("valid"))
    took = []
    for n in (20_000, 200_000):
        began = time.time()
        assert folds.delay_schedule(rows(n), 1e9).count() == n
        took.append(time.time() - began)
    assert took[1] < 30 * max(took[0], 0.3)
    merged = folds.merge_short(rows(200_000).select("media_id", "seq", "start_s", (F.col("start_s") + 0.4).alias("end_s"), F.lit("a").alias("text"), F.lit(None).cast("string").alias("speaker")))
    assert merged.count() == 40_000  # four make 1.9 seconds, so the fifth still joins


def test_folds_of_nothing(spark):
    empty = spark.createDataFrame([], "media_id long, seq long, start_s double, end_s double, text string, speaker string, actual_dur double, valid boolean, ref string")
    assert folds.merge_short(empty).count() == folds.delay_schedule(empty, 1.0).count() == folds.assign_voices(empty, ["a"]).count() == folds.reference_fallback(empty, F.lit("c")).count() == 0


def test_context_translation(spark):
    def model():
        return lambda text, previous: f"{text}<{previous}>"

    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, " "), (1, 2, None), (1, 3, "b")], "media_id long, seq long, text string")
    got = [r.translated for r in folds.translate_in_context(rows, model).orderBy("seq").collect()]
    assert got == ["a<None>", " ", None, "b<a<None>>"]


def naive_linkage(x, cut):
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        far, i, j = min((np.mean([np.linalg.norm(x[a] - x[b]) for a in groups[i] for b in groups[j]]), i, j) for i in range(len(groups)) for j in range(i))
        if far >= cut:
            break
        groups[i] += groups.pop(j) if j > i else groups[j]
        if j < i:
            groups.pop(j)
    label = np.zeros(len(x), int)
    for k, g in enumerate(groups):
        label[g] = k
    return signal.numbered(label)


@pytest.mark.parametrize("seed", range(4))
def test_linkage(seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((30, 4)) * 0.15 + rng.standard_normal((4, 4))[rng.integers(0, 4, 30)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for cut in (0.2, 0.5, 1.0):
        assert (signal.average_linkage(x, cut) == naive_linkage(x, cut)).all()


@pytest.mark.parametrize("seed", range(3))
def test_linkage_in_rounds(seed, monkeypatch):
    """Clusters by rounds and blocks of a few rows are those of the plain definition; copies, lone rows and dense groups too."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((60, 4)) * 0.15 + rng.standard_normal((4, 4))[rng.integers(0, 4, 60)]
    x = np.concatenate([x, x[:9], x[:3], rng.standard_normal((6, 4))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for block in (1, 1 << 21):
        monkeypatch.setattr(signal, "BLOCK", block)
        for cut in (0.2, 0.5, 1.0):
            for dense in (1, 10):
                assert (signal.average_linkage(x, cut, dense) == naive_linkage(x, cut)).all()


def test_blocks_of_many_rows(monkeypatch):
    """Beyond 500 rows distances come in blocks that end inside clusters; the sparse space is the dense one."""
    rng = np.random.default_rng(1)
    who = rng.integers(0, 4, 700)
    x = np.eye(12)[who] + rng.standard_normal((700, 12)) * 0.08
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(signal, "BLOCK", 700 * 7)
    want = signal.average_linkage(x, 0.6, 1000)
    assert (signal.average_linkage(x, 0.6, 20) == want).all() and (want == signal.numbered(who)).all()
    d = np.linalg.norm(x[:, None] - x, axis=2)
    size = np.array([1, 2, 300, 1, 396])
    edges = np.cumsum([0, *size])
    means = np.concatenate([m for _, m in signal._means(x, size)])
    for a in range(5):
        for b in range(5):
            assert means[a, b] == (np.inf if a == b else pytest.approx(d[edges[a] : edges[a + 1], edges[b] : edges[b + 1]].mean()))
    x = rng.standard_normal((600, 12))  # connected
    dense, sparse = signal.spectral_space(x, 6), signal.spectral_space(x, 6, dense=10)
    assert np.allclose(np.abs((dense / np.linalg.norm(dense, axis=0) * sparse / np.linalg.norm(sparse, axis=0)).sum(0)), 1)
    assert signal.silhouettes(x, [who[:600], who[:600] % 2]) == pytest.approx([signal.silhouette(x, who[:600]), signal.silhouette(x, who[:600] % 2)])


def test_clustering_holds_few_distances():
    """1,500 vectors of 64 numbers: all differences at once would be 1.2 GB."""
    import tracemalloc

    x = np.random.default_rng(2).standard_normal((1500, 64))
    tracemalloc.start()
    label = signal.speakers(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert label.max() > 0 and peak < 150e6


def test_speakers(spark):
    rng = np.random.default_rng(0)
    centres = np.eye(6)[:3]
    who = rng.integers(0, 3, 60)
    x = centres[who] + rng.standard_normal((60, 6)) * 0.05
    assert (signal.speakers(x) == signal.numbered(who)).all()  # linkage
    assert len(set(signal.speakers(x, most=2).tolist())) == 2  # too many for it: spectral
    assert signal.speakers(x[:1]).tolist() == [0] and signal.speakers(x[:0]).tolist() == []
    assert len(set(signal.speakers(np.eye(3)).tolist())) >= 2  # nothing is near: no linkage
    assert (signal.k_means(x, 3) == signal.numbered(who)).all() and (signal.spectral(x, 3) == signal.numbered(who)).all()
    label = signal.numbered(who)
    d = np.linalg.norm(x[:, None] - x, axis=2)
    plain = []
    for i in range(60):
        own = [d[i, j] for j in range(60) if label[j] == label[i] and j != i]
        other = min(np.mean([d[i, j] for j in range(60) if label[j] == c]) for c in range(3) if c != label[i])
        plain.append((other - np.mean(own)) / max(other, np.mean(own)))
    assert signal.silhouette(x, label) == pytest.approx(np.mean(plain))
    rows = spark.createDataFrame([(1, k, v.tolist()) for k, v in enumerate(x)] + [(2, 0, [1.0] * 6)], "media_id long, seq long, vector array<double>")
    got = {(r.media_id, r.seq): r.speaker for r in signal.cluster_embeddings(rows).collect()}
    assert got == {(1, k): f"SPEAKER_{v:02d}" for k, v in enumerate(label)} | {(2, 0): "SPEAKER_00"}


def test_cluster_query(spark):
    from dubflow.plans.catalog import QUERIES

    rows = QUERIES["cluster_embeddings"](spark, "/root/testdata/sf0.001").collect()
    table = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    for m in range(5):
        mine = sorted((r.seq, r.speaker) for r in rows if r.media_id == m)
        x = np.array([table[s] for s, _ in mine])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        label = naive_linkage(x, 0.5)
        if 2 <= label.max() + 1 <= 10 and label.max() + 1 < len(x):
            assert [w for _, w in mine] == [f"SPEAKER_{k:02d}" for k in label]
        else:
            assert 2 <= len({w for _, w in mine}) <= 10


def test_cache(spark):
    ddl = "seq int, src string, tgt string, text string, model string"
    rows = spark.createDataFrame([(0, "auto", "de", " hi ", "m"), (1, "en", "de", "hi", "m"), (2, "en", "de", "a|b", "m"), (3, "en", "de|a", "b", "m"), (4, "en", "de", "bad", "m"), (5, "en", "de", None, "m")], ddl)
    known = spark.createDataFrame([("en", "de", "hi", "m", "hallo")], "src string, tgt string, key string, model string, translated string")
    asked = []

    def model(misses):
        asked.append(misses.count())
        return misses.withColumn("translated", F.when(F.col("key") != "bad", F.upper("key")))

    got, after = cache.translate(rows, known, model)
    got = {r.seq: (r.translated, r.hit, r.ok) for r in got.collect()}
    assert got == {0: ("hallo", True, True), 1: ("hallo", True, True), 2: ("A|B", False, True), 3: ("B", False, True), 4: ("bad", False, False), 5: ("", False, True)} and asked == [4]
    assert {tuple(r)[:4] for r in after.collect()} == {("en", "de", "hi", "m"), ("en", "de", "a|b", "m"), ("en", "de|a", "b", "m"), ("en", "de", "", "m")}
    assert cache.translate(rows.limit(0), known, model)[0].count() == 0


def test_ttl(spark):
    rows = [(1, 0, "a", 0.0, True), (1, 1, "b", 1.0, True), (1, 2, "a", 2.0, True), (1, 3, "c", 3.0, True), (1, 4, "b", 4.0, True), (1, 5, "a", 9.0, True), (1, 6, "a", 10.0, False), (1, 7, "a", 11.0, True), (2, 0, "a", 1.0, False), (2, 1, "a", 2.0, True)]
    df = spark.createDataFrame(rows, "media_id long, seq long, key string, at double, ok boolean")
    got = {(r.media_id, r.seq): r.hit for r in cache.ttl_hits(df, ttl=10.0, most=2).collect()}
    # a is used at 2, so c drives out b, and b at 4 drives out a; a comes back at 9 and lives to 19
    assert got == {(1, 0): False, (1, 1): False, (1, 2): True, (1, 3): False, (1, 4): False, (1, 5): False, (1, 6): True, (1, 7): True, (2, 0): False, (2, 1): False}
