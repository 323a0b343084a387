"""Samples as rows (media_id, idx, val)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_sample():
    """An item's rows in their order."""
    return Window.partitionBy("media_id").orderBy("idx")


def peak_normalize(df: DataFrame, most: float = 0.95) -> DataFrame:
    """Scaled to the peak `most` where it is above."""
    peak = df.groupBy("media_id").agg(F.max(F.abs("val")).alias("peak"))
    return df.join(peak, "media_id").select("media_id", "idx", F.when(F.col("peak") > most, F.col("val") * (most / F.col("peak"))).otherwise(F.col("val")).alias("val"))


def mix(voice: DataFrame, background: DataFrame, voice_volume: float = 1.0, background_volume: float = 0.8, rate: int = 1, background_rate: int | None = None) -> DataFrame:
    """Both tracks added, the background at the voice's rate, the shorter one silent at its end; peaks are scaled down."""
    background = resampled(background, background_rate or rate, rate)
    b = background.select("media_id", "idx", F.col("val").alias("b"))
    both = voice.join(b, ["media_id", "idx"], "full_outer")
    return peak_normalize(both.select("media_id", "idx", (F.coalesce("val", F.lit(0.0)) * voice_volume + F.coalesce("b", F.lit(0.0)) * background_volume).alias("val")))


def canvas_sum(df: DataFrame, offset: Column) -> DataFrame:
    """Clips (media_id, idx, val) laid on a canvas at an offset; where they overlap they add."""
    return df.withColumn("at", offset).groupBy("media_id", (F.col("at") + F.col("idx")).alias("idx")).agg(F.sum("val").alias("val"))


def preemphasis(df: DataFrame, k: float = 0.97) -> DataFrame:
    return df.select("media_id", "idx", (F.col("val") - F.coalesce(F.lit(k) * F.lag("val").over(by_sample()), F.lit(0.0))).alias("val"))


def crossfade(n: int | Column, kind: str = "linear") -> Column:
    """n weights from 0 to 1; cosine and exponential (a square root) besides linear. None for n of 0 or less."""
    n = F.lit(n) if isinstance(n, int) else n.cast("int")
    t = lambda i: i / F.greatest(F.lit(1.0), n - F.lit(1.0))
    shape = {"linear": t, "cosine": lambda i: (1 - F.cos(t(i) * math.pi)) / 2, "exponential": lambda i: F.sqrt(t(i))}[kind]
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1)), shape)).otherwise(F.array().cast("array<double>"))


def overlap_add(df: DataFrame, size: int, stride: int, ramp: int, normalise: bool = False) -> DataFrame:
    """Windows of `size` every `stride` samples with linear ramps: sum(w * y) / (sum(w) + 1e-8); the last ones are cut short.

    normalise: the samples enter with a mean of 0 and a (sample) deviation of 1 and get theirs back, as a model's windows do.
    """
    if normalise:
        stats = df.groupBy("media_id").agg(F.avg("val").alias("mean"), (F.coalesce(F.stddev_samp("val"), F.lit(0.0)) + F.lit(1e-8)).alias("deviation"))
        rows = df.join(stats, "media_id")
        got = overlap_add(rows.select("media_id", "idx", ((F.col("val") - F.col("mean")) / F.col("deviation")).alias("val")), size, stride, ramp)
        return got.join(stats, "media_id").select("media_id", "idx", (F.col("val") * F.col("deviation") + F.col("mean")).alias("val"))
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - size + 1) / stride)).cast("int")
    rows = df.withColumn("win", F.explode(F.sequence(first, F.floor(F.col("idx") / stride).cast("int"))))
    inside = F.col("idx") - F.col("win") * stride
    w = F.least(F.lit(1.0), inside / F.lit(float(ramp)), (size - 1 - inside) / F.lit(float(ramp)))
    rows = rows.withColumn("w", w)
    return rows.groupBy("media_id", "idx").agg((F.sum(F.col("w") * F.col("val")) / (F.sum("w") + F.lit(1e-8))).alias("val"))


def canvas(clips: DataFrame, placed: DataFrame, rate: int, total: float) -> DataFrame:
    """(media_id, idx, val) of whole tracks: clips' samples (media_id, seq, idx, val) laid at their start (media_id, seq,
    new_start, final_dur), added where they overlap, zeros elsewhere, a second longer than the last end or `total`; peaks
    are scaled down."""
    at = placed.select("media_id", "seq", (F.col("new_start") * rate).cast("long").alias("at"))
    sums = canvas_sum(clips.join(at, ["media_id", "seq"]).select("media_id", "idx", "val", "at"), F.col("at"))
    length = placed.groupBy("media_id").agg(((F.greatest(F.lit(float(total)), F.max(F.col("new_start") + F.col("final_dur"))) * rate).cast("long") + rate).alias("n"))
    empty = length.select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("idx"))
    return peak_normalize(empty.join(sums, ["media_id", "idx"], "full_outer").select("media_id", "idx", F.coalesce("val", F.lit(0.0)).alias("val")))


def rms_valid(df: DataFrame, least_rms: float = 0.02, least_variance: float = 1e-5) -> DataFrame:
    got = df.groupBy("media_id").agg(F.sqrt(F.avg(F.col("val") * F.col("val"))).alias("rms"), F.var_pop("val").alias("variance"))
    return got.withColumn("ok", (F.col("rms") >= least_rms) & (F.col("variance") >= least_variance))


def reference_valid(df: DataFrame, rate: int, least_seconds: float = 2.0, heard: float = 10.0) -> DataFrame:
    """(media_id, seconds, rms, variance, ok) of voice references: long enough, and loud and varied in their first seconds."""
    first = F.col("idx") < int(heard * rate)
    x = F.when(first, F.col("val"))
    got = df.groupBy("media_id").agg((F.count(F.lit(1)) / rate).alias("seconds"), F.sqrt(F.avg(x * x)).alias("rms"), F.var_pop(x).alias("variance"))
    return got.withColumn("ok", (F.col("seconds") >= least_seconds) & (F.col("rms") >= 0.02) & (F.col("variance") >= 1e-5))


def fallback_reference(df: DataFrame, rate: int, most: float = 30.0) -> DataFrame:
    """(media_id, idx, val): each item's first seconds where they make a valid reference; other items have none."""
    clip = df.where(F.col("idx") < int(most * rate))
    good = reference_valid(clip, rate).where("ok").select(F.col("media_id").alias("m"))
    return clip.join(good, F.col("media_id") == F.col("m"), "left_semi")


def profile_clips(clips: DataFrame, least: float = 0.5, quiet: float = 0.01, most: float = 15.0, least_total: float = 1.0) -> DataFrame:
    """The clips (media_id, speaker, seq, dur, rms) that make each speaker's profile: the longest first, until they are
    `most` seconds together (the clip that crosses it included), if they are `least_total` at all."""
    rows = clips.where((F.col("dur") >= least) & (F.col("rms") >= quiet))
    order = Window.partitionBy("media_id", "speaker").orderBy(F.desc("dur"), "seq")
    rows = rows.withColumn("before", F.coalesce(F.sum("dur").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).where(F.col("before") < most)
    total = F.sum("dur").over(Window.partitionBy("media_id", "speaker"))
    return rows.withColumn("total", total).where(F.col("total") >= least_total).drop("total")


def profile_wave(df: DataFrame, rate: int, most: float = 15.0, fade: float = 0.01) -> DataFrame:
    """Samples (media_id, idx, val) of profiles: cut at `most` seconds, peak at -3 dB, linear fades at both ends if there is
    room for them."""
    cut = df.where(F.col("idx") < int(most * rate))
    peak = cut.groupBy("media_id").agg(F.max(F.abs("val")).alias("peak"), F.count(F.lit(1)).alias("n"))
    n, f = F.col("n"), int(fade * rate)
    ramp = F.when(n > 2 * f, F.least(F.lit(1.0), F.col("idx") / max(1, f - 1), (n - 1 - F.col("idx")) / max(1, f - 1))).otherwise(1.0) if f else F.lit(1.0)
    gain = F.when(F.col("peak") > 0, F.lit(10 ** (-3 / 20)) / F.col("peak")).otherwise(1.0)
    return cut.join(peak, "media_id").select("media_id", "idx", (F.col("val") * gain * ramp).alias("val"))


def genders(clips: DataFrame, most: float = 20.0, bound: float = 160.0) -> DataFrame:
    """(media_id, speaker, gender) of clips (media_id, speaker, seq, dur: null if out of bounds, f0): by the mean voiced
    pitch of the first clips up to `most` seconds, the one that crosses it included; Male where there is none."""
    order = Window.partitionBy("media_id", "speaker").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = clips.withColumn("before", F.coalesce(F.sum("dur").over(order), F.lit(0.0)))
    pitch = F.avg(F.when((F.col("before") <= most) & F.col("dur").isNotNull() & F.col("f0").between(65, 300), F.col("f0")))
    return rows.groupBy("media_id", "speaker").agg(F.when(F.coalesce(pitch, F.lit(0.0)) > bound, "Female").otherwise("Male").alias("gender"))


def with_gender(segments: DataFrame, found: DataFrame) -> DataFrame:
    """segments with their speaker's gender, Female where none was found."""
    known = found.select(F.col("media_id").alias("m"), F.col("speaker").alias("s"), "gender")
    rows = segments.join(known, (F.col("media_id") == F.col("m")) & (F.col("speaker") == F.col("s")), "left")
    return rows.select(*segments.columns, F.coalesce("gender", F.lit("Female")).alias("gender"))


def resampled(df: DataFrame, rate: int, target: int) -> DataFrame:
    """Samples (media_id, idx, val) at another rate, linear between neighbours; the last is held."""
    if rate == target:
        return df.select("media_id", "idx", "val")
    count = df.groupBy("media_id").agg((F.max("idx") + 1).alias("n"))
    after = F.lead("val").over(by_sample())
    rows = df.withColumn("next", F.coalesce(after, F.col("val"))).join(count, "media_id")
    # the new samples that lie at or after this one and before the next; beyond the last one, up to the new length
    length = F.greatest(F.lit(1), F.round(F.col("n") * target / rate)).cast("long")
    first = F.ceil(F.col("idx") * target / F.lit(float(rate)))
    last = F.when(F.col("idx") == F.col("n") - 1, length - 1).otherwise(F.least(F.ceil((F.col("idx") + 1) * target / F.lit(float(rate))), length) - 1)
    made = rows.where(last >= first).withColumn("at", F.explode(F.sequence(first, last)))
    share = F.least(F.lit(1.0), F.col("at") * rate / F.lit(float(target)) - F.col("idx"))
    return made.select("media_id", F.col("at").alias("idx"), (F.col("val") + (F.col("next") - F.col("val")) * share).alias("val"))


def mel_normalize(s: Column) -> Column:
    return F.least(F.greatest((s + 100) / 100, F.lit(0.0)), F.lit(1.0))


#: Rows or clusters up to which all distances are held at once; distances in a block beyond that.
DENSE, BLOCK = 2_048, 1 << 21


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y."""
    if max(len(x), len(y)) < 500:
        return ((x[:, None] - y) ** 2).sum(2)
    return np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T)


def _blocks(x: np.ndarray):
    """(first row, squared distances of some rows to all rows), row for row, so that a block has some BLOCK distances."""
    step = len(x) if len(x) < 500 else max(1, BLOCK // len(x))
    for r in range(0, len(x), step):
        d = _squares(x[r : r + step], x)
        d[np.arange(len(d)), r + np.arange(len(d))] = 0
        yield r, d


def _means(x: np.ndarray, size: np.ndarray):
    """(first cluster, mean distances of some clusters to all) for rows that stand cluster by cluster; infinite to themselves."""
    starts, of, carry = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size), None
    for r, d in _blocks(x):
        end = r + len(d)
        np.sqrt(d, out=d)
        if len(size) < len(x):
            d = np.add.reduceat(d, starts, axis=1)
        first, last = of[r], of[end - 1]
        sums = np.add.reduceat(d, np.maximum(starts[first : last + 1] - r, 0), axis=0)
        if starts[first] < r:  # the block before had its first rows
            sums[0] += carry
        carry = sums[-1].copy()
        sums = sums[: last - first + (starts[last] + size[last] <= end)]
        sums /= size[first : first + len(sums), None] * size
        sums[np.arange(len(sums)), first + np.arange(len(sums))] = np.inf
        yield first, sums


def _chain(d: np.ndarray, size: np.ndarray) -> list[tuple]:
    """All merges (distance, kept, gone) of clusters by mean distances, which are used up: nearest-neighbour chains."""
    n = len(d)
    size, live, merges, chain = size.astype(float), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        while True:
            a = chain[-1]
            b = int(d[a].argmin())
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        i, j = min(a, b), max(a, b)
        merges.append((d[a, b], i, j))
        d[i] = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[:, i], size[i] = d[i], size[i] + size[j]
        d[i, i], live[j] = np.inf, False
        d[j], d[:, j] = np.inf, np.inf
    return merges


def average_linkage(x: np.ndarray, cut: float, dense: int = DENSE) -> np.ndarray:
    """Clusters of rows, numbered by first member, whose merges lie below `cut`; quadratic time, memory by blocks of distances.

    While more than `dense` clusters are left, those that are each other's nearest merge, all at once, and those without
    another below `cut` are done: no merge of others brings one nearer. What is left goes by nearest-neighbour chains.
    """
    n = len(x)
    root = np.arange(n)
    if cut > 0 and n > dense:  # copies come first
        _, first, same = np.unique(x, axis=0, return_index=True, return_inverse=True)
        root = first[same.ravel()]
    live = np.unique(root)
    while len(live) > 1:
        rows = np.flatnonzero(np.isin(root, live))
        rows = rows[np.argsort(root[rows], kind="stable")]
        size = np.unique(root[rows], return_counts=True)[1]
        if len(live) <= dense:
            d = np.zeros((len(live), len(live)))
            for k, m in _means(x[rows], size):
                d[k : k + len(m)] = m
            for far, i, j in sorted(_chain(d, size), key=lambda m: m[0]):
                if far < cut:
                    root[root == root[live[j]]] = root[live[i]]
            break
        near, far = np.zeros(len(live), int), np.zeros(len(live))
        for k, m in _means(x[rows], size):
            near[k : k + len(m)], far[k : k + len(m)] = m.argmin(1), m.min(1)
        every, some = np.arange(len(live)), far < cut
        gone = some & (near[near] == every) & (near < every)
        if some.any() and not gone.any():  # rounding hides the closest pair
            a = int(far.argmin())
            gone[max(a, near[a])] = True
            near[max(a, near[a])] = min(a, near[a])
        to = np.arange(n)
        to[live[gone]] = live[near[gone]]
        root = to[root]
        some[near[gone]] = True
        live = live[some & ~gone]
    return numbered(root)


def numbered(labels: np.ndarray) -> np.ndarray:
    """Labels by first appearance, from 0."""
    names: dict = {}
    return np.array([names.setdefault(v, len(names)) for v in labels.tolist()])


def k_means(x: np.ndarray, k: int, seed: int = 42, tries: int = 10) -> np.ndarray:
    """Seeded k-means with spread first centres; the best of some tries."""
    rng, best, found = np.random.default_rng(seed), np.inf, None
    for _ in range(tries):
        centres = x[[int(rng.integers(len(x)))]]
        while len(centres) < k:
            away = _squares(x, centres).min(1)
            centres = np.vstack([centres, x[int(rng.choice(len(x), p=away / away.sum() if away.sum() else None))]])
        for _ in range(100):
            label = _squares(x, centres).argmin(1)
            moved = np.stack([x[label == c].mean(0) if (label == c).any() else centres[c] for c in range(k)])
            if np.allclose(moved, centres):
                break
            centres = moved
        cost = ((x - centres[label]) ** 2).sum()
        if cost < best - 1e-12:
            best, found = cost, label
    return numbered(found)


def leading(product, n: int, k: int, seed: int = 42, degree: int = 40, cycles: int = 100) -> np.ndarray:
    """Eigenvectors of the k largest eigenvalues, largest first, of a symmetric product with all of them in -1 to 1.

    A subspace is filtered by Chebyshev polynomials that are large above its least value, until its vectors stay.
    """
    v = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, min(n, k + 16))))[0]
    for _ in range(cycles):
        pv = product(v)
        value, turn = np.linalg.eigh(v.T @ pv)
        value, turn = value[::-1], turn[:, ::-1]
        v, pv = v @ turn, pv @ turn
        if np.linalg.norm(pv[:, :k] - v[:, :k] * value[:k], axis=0).max() < 1e-10:
            break
        top = min(max(value[-1], -0.5), 0.99)
        half, middle = (top + 1) / 2, (top - 1) / 2
        before, now = v, (pv - middle * v) / half
        for _ in range(degree - 1):
            before, now = now, (product(now) - middle * now) * (2 / half) - before
        v = np.linalg.qr(now / np.linalg.norm(now, axis=0))[0]
    return v[:, :k]


def spectral_space(x: np.ndarray, most: int, near: int = 10, seed: int = 42, dense: int = DENSE) -> np.ndarray:
    """The first `most` eigenvectors of the normalised graph of nearest neighbours, scaled; its edges are few, so it is sparse
    beyond `dense` rows."""
    n, near = len(x), min(near, len(x))
    mine = np.zeros((n, near), int)
    for r, d in _blocks(x):
        mine[r : r + len(d)] = (np.argsort(d, axis=1, kind="stable") if n < 500 else np.argpartition(d, near - 1, axis=1))[:, :near]
    i, j = np.repeat(np.arange(n), near), mine.ravel()
    i, j = i[i != j], j[i != j]
    edge, count = np.unique(np.concatenate([i * n + j, j * n + i]), return_counts=True)
    i, j, weight = edge // n, edge % n, count / 2
    root = 1 / np.sqrt(np.maximum(np.bincount(i, weight, n), 1e-12))
    weight = weight * root[i] * root[j]
    if n <= dense:
        graph = np.eye(n)
        graph[i, j] = -weight
        vectors = np.linalg.eigh(graph)[1]
    else:
        at = np.searchsorted(i, np.arange(n))  # each row has an edge: of two nearest, one is another's

        def product(v):
            return np.concatenate([np.add.reduceat(v[j, c : c + 8] * weight[:, None], at, axis=0) for c in range(0, v.shape[1], 8)], axis=1)

        vectors = leading(product, n, most, seed)
    return vectors[:, :most] * root[:, None]


def spectral(x: np.ndarray, k: int, near: int = 10, seed: int = 42) -> np.ndarray:
    """k-means in the first eigenvectors of the normalised graph of nearest neighbours."""
    return k_means(spectral_space(x, k, near, seed), k, seed)


def silhouettes(x: np.ndarray, labels: list[np.ndarray]) -> list[float]:
    """Mean silhouettes of several clusterings, by one pass over all distances; a cluster of one counts 0."""
    member = [(label[:, None] == np.arange(label.max() + 1)).astype(float) for label in labels]
    edges, every, total = np.cumsum([0] + [m.shape[1] for m in member]), np.hstack(member), np.zeros(len(labels))
    for r, d in _blocks(x):
        sums = np.sqrt(d) @ every
        at = np.arange(len(sums))
        for t, label in enumerate(labels):
            part, mine, count = sums[:, edges[t] : edges[t + 1]], label[r : r + len(sums)], np.bincount(label)
            own = part[at, mine] / np.maximum(count[mine] - 1, 1)
            other = part / count
            other[at, mine] = np.inf
            nearest = other.min(1)
            total[t] += np.where(count[mine] > 1, (nearest - own) / np.maximum(np.maximum(own, nearest), 1e-12), 0).sum()
    return (total / len(x)).tolist()


def silhouette(x: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette; a cluster of one counts 0."""
    return silhouettes(x, [label])[0]


def speakers(x: np.ndarray, most: int = 10, cut: float = 0.5) -> np.ndarray:
    """Speaker numbers of embeddings: average linkage if it gives 2 to `most` speakers and fewer than rows, else the spectral
    clustering with the best silhouette, else k-means."""
    n = len(x)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    if n < 2:
        return np.zeros(n, int)
    label = average_linkage(x, cut)
    if 2 <= label.max() + 1 <= most and label.max() + 1 < n:
        return label
    best, found = -1.0, None
    space = spectral_space(x, min(most, n))
    labels = [label for k in range(2, min(most, n) + 1) if (label := k_means(space[:, :k], k)).max() > 0]
    for label, score in zip(labels, silhouettes(x, labels) if labels else [], strict=True):
        if score > best:
            best, found = score, label
    return found if found is not None else k_means(x, max(2, min(most, n)))


def cluster_embeddings(df: DataFrame, most: int = 10, cut: float = 0.5) -> DataFrame:
    """(media_id, seq, vector) to (media_id, seq, speaker), numbered by first member. One item's segments are clustered by one
    task, in time that grows with their square, and memory with their number: an item is one recording, its segments phrases."""
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        label = speakers(np.array(part["vector"].tolist(), float), most, cut)
        return pd.DataFrame({"media_id": part["media_id"], "seq": part["seq"], "speaker": [f"SPEAKER_{k:02d}" for k in label]})

    return df.select("media_id", "seq", "vector").groupBy("media_id").applyInPandas(run, "media_id long, seq long, speaker string")
