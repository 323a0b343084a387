"""Long repeats by a run-length compressed Burrows-Wheeler index.

Every window of `least` bytes belongs to the segment of consecutive windows that have the same smallest k-gram hash, so
equal windows lie in segments with one hash f. Segments whose f occurs once have no repeat and go. The distinct segments
of every other f are indexed, each with its number of copies as a weight: their suffixes are sorted, the BWT is kept as
runs that weights lengthen, the matching statistics (longest match with any other place, a copy's included) are computed
at the sampled ends of runs only and streamed to all other positions, where they grow by one a step to the left. A
statistic of `least` marks a window that starts anywhere else too; every document with that segment gets its marks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dubflow.llm.common import join_classes, materialize, prepare, utf8

#: Bytes of the repeats to find; of the k-grams (a multiple of 32); of a piece of text hashed, and of segments indexed, at a time.
LEAST, KGRAM, PIECE_BYTES, INDEX_BYTES = 400, 96, 256 << 10, 256 << 10
#: Windows of one segment at most.
SEGMENT_STARTS = 16_384
MAX_HASH = np.uint64((1 << 64) - 1)


def kgram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """63-bit hashes of all k-grams, by doubling."""
    h, n, parts, at = data.astype(np.uint64) + np.uint64(1), 1, [], 0
    mul = lambda m: np.uint64((0x9E3779B97F4A7C15 * (2 * m + 1)) % (1 << 64) | 1)
    while True:
        if k & n:
            parts.append((n, h))
        if 2 * n > k:
            break
        h = (h[:-n] * mul(n)) ^ h[n:] if len(h) > n else h[:0]
        h ^= h >> np.uint64(29)
        n *= 2
    size = len(data) - k + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for n, h in reversed(parts):
        out = (out * mul(1000 + n)) ^ h[at : at + size]
        at += n
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out >> np.uint64(1)


def sliding_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of `width` values, by minima from both ends of blocks."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    padded = np.full(-(-len(h) // width) * width, MAX_HASH)
    padded[: len(h)] = h
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Demotion:
    """k-grams that very many segments had as their smallest: they count as larger than all others."""

    def __init__(self, hot: np.ndarray) -> None:
        self.hot = np.sort(hot.astype(np.uint64))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.hot & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if len(self.hot) and len(h):
            at = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFF)).astype(np.uint16)])
            i = np.minimum(np.searchsorted(self.hot, h[at]), len(self.hot) - 1)
            at = at[self.hot[i] == h[at]]
            h[at] |= np.uint64(1 << 63)
        return h


def segments(texts: list[bytes], demote: Demotion, least: int = LEAST, k: int = KGRAM) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text's index, f, first start, last start, inner) arrays of the segments; texts of a piece's size are hashed together.

    inner: the segment has f more than once, so it may repeat itself.
    """
    step, group, size = PIECE_BYTES, [], 0

    def work(group):
        data = np.frombuffer(b"".join([t for _, _, t in group]), np.uint8)
        h = demote(kgram_hashes(data, k))
        low = sliding_minimum((h >> np.uint64(20) << np.uint64(20)) | np.arange(len(h), dtype=np.uint64), least - k + 1)  # the leftmost of equals
        where = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
        ends = np.cumsum([len(t) for _, _, t in group])
        begins = ends - [len(t) for _, _, t in group]
        new = np.ones(len(low), bool)
        new[1:] = low[1:] >> np.uint64(20) != low[:-1] >> np.uint64(20)
        for (i, offset, t), begin in zip(group, begins, strict=True):
            n = len(t) - least + 1
            cut = new[begin : begin + n].copy()
            cut[::SEGMENT_STARTS] |= n > SEGMENT_STARTS
            cut[0] = True
            first = np.flatnonzero(cut)
            last = np.append(first[1:], n) - 1
            yield i, h[where[begin + first]].view(np.int64), first + offset, last + offset, where[begin + first] != where[begin + last]

    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - least + 1), step):
            part = t[a : a + step + least - 1]
            if len(part) < least:
                continue
            group.append((i, a, part))
            size += len(part)
            if size >= step:
                yield from work(group)
                group, size = [], 0
    if group:
        yield from work(group)


def _order(key: np.ndarray, bits: int) -> np.ndarray:
    """Where the sorted keys were; keys that leave `bits` bits are sorted together with their places."""
    if len(key) and int(key.max()).bit_length() + bits < 64:
        return np.sort((key << bits) | np.arange(len(key))) & (1 << bits) - 1
    return np.argsort(key, kind="stable")


class RunLengthIndex:
    """Run-compressed BWT of weighted byte strings with sampled run ends and matching statistics against every other place.

    A weight is the number of copies of a string: its rows of the matrix count that often, so copies only lengthen runs.
    Kept are, besides the strings, the runs (byte, weighted length) and at the sampled ends of runs the place in the
    strings and the matching statistic; the suffix order and its ranks go when the index is built.
    """

    def __init__(self, strings: list[bytes], cap: int, weights: list[int] | None = None) -> None:
        self.data, self.cap = np.frombuffer(b"".join(strings), np.uint8), cap
        lengths = np.array([len(s) for s in strings], np.int64)
        self.weights = np.ones(len(strings), np.int64) if weights is None else np.array(weights, np.int64)
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths
        end_of, weight_of = np.repeat(self.ends, lengths), np.repeat(self.weights, lengths)
        order, levels = self._sorted(end_of)
        self._runs(order, levels, end_of, weight_of)

    def _sorted(self, end: np.ndarray) -> tuple[np.ndarray, list]:
        """Suffixes, cut at their string's end and at `cap` bytes at least, in order; ranks of all prefix doublings."""
        n, data = len(self.data), self.data
        every = np.arange(n)
        present = np.zeros(256, bool)
        present[data] = True
        codes = np.cumsum(present)[data]
        bits, width = n.bit_length(), int(present.sum()).bit_length()
        first = max(1, min(16, (62 - bits) // width))
        key = np.zeros(n, np.int64)
        for j in range(first):
            key <<= width
            part = key[: n - j]
            np.bitwise_or(part, codes[j:], out=part, where=every[: n - j] + j < end[: n - j])
        order = _order(key, bits)
        heads = np.ones(n, bool)
        heads[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(heads, every, 0))
        levels, h = [(first, rank)], first
        while h < self.cap:
            tied = ~heads
            tied[:-1] |= ~heads[1:]
            idx = np.flatnonzero(tied)
            if len(idx):
                rank = rank.copy()
                pos = order[idx]
                at = pos + h
                second = np.where(at < end[pos], levels[-1][1].take(at, mode="clip") + 1, 0)
                k = (np.cumsum(heads[idx]) << bits) | second
                o = _order(k, bits)
                pos, k = pos[o], k[o]
                order[idx] = pos
                head = np.ones(len(k), bool)
                head[1:] = k[1:] != k[:-1]
                heads[idx] = head
                rank[pos] = np.maximum.accumulate(np.where(head, idx, 0))
            h *= 2
            levels.append((h, rank))
        return order, levels

    def _runs(self, order: np.ndarray, levels: list, end: np.ndarray, weight: np.ndarray) -> None:
        n = len(self.data)
        before = np.zeros(n, np.int16)
        before[1:] = self.data[:-1].astype(np.int16) + 1
        before[self.begins] = 0  # no byte before: equal to nothing
        # the empty suffixes of the strings come first
        bwt = np.concatenate([self.data[self.ends - 1].astype(np.int16) + 1, before[order]])
        head = np.ones(len(bwt), bool)
        head[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)
        at = np.flatnonzero(head)
        self.run_byte = bwt[at] - 1
        self.run_length = np.add.reduceat(np.concatenate([self.weights, weight[order]]), at)
        s = len(self.ends)
        edge = (head | np.append(head[1:], True))[s:]
        q = order[edge & (bwt[s:] != 0)]
        chosen = np.zeros(n, bool)
        chosen[q - 1] = chosen[self.ends - 1] = True
        self.samples = np.flatnonzero(chosen)
        self.sampled = np.minimum(end[self.samples] - self.samples, self.cap)  # of a string with copies: a copy goes to its end
        alone = np.flatnonzero(weight[self.samples] == 1)
        place = np.empty(n, np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        i = self.samples[alone]
        p = place[i]
        self.sampled[alone] = np.maximum(self._common(levels, end, i, order[np.maximum(p - 1, 0)], p > 0), self._common(levels, end, i, order[np.minimum(p + 1, n - 1)], p < n - 1))

    def _common(self, levels: list, end: np.ndarray, i: np.ndarray, j: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, up to cap."""
        most = np.where(real, np.minimum(np.minimum(end[i] - i, end[j] - j), self.cap), 0)
        done = np.zeros(len(i), np.int64)
        for h, rank in reversed(levels):
            same = (done < most) & (rank.take(i + done, mode="clip") == rank.take(j + done, mode="clip"))
            done = np.minimum(done + h * same, most)
        for _ in range(levels[0][0] - 1):
            done += (done < most) & (self.data.take(i + done, mode="clip") == self.data.take(j + done, mode="clip"))
        return done

    def count(self, patterns: np.ndarray) -> np.ndarray:
        """Occurrences of each row of bytes (at most `cap` of them), copies included: backward search over the runs."""
        start = np.cumsum(self.run_length) - self.run_length
        o = np.argsort(self.run_byte, kind="stable")
        key, length = (self.run_byte[o].astype(np.int64) + 1 << 48) | start[o], self.run_length[o]
        earlier = np.cumsum(length) - length  # rows of smaller bytes and of earlier runs of this byte
        first = np.searchsorted(key, np.arange(258, dtype=np.int64) << 48)
        # the matrix begins with the rows of empty suffixes, each string's weight; rows without a byte before come first here
        smaller = np.append(earlier, length.sum())[first] - np.append(earlier, length.sum())[first[1]] + self.weights.sum()

        def occurrences(c, i):
            j = np.searchsorted(key, (c + 1 << 48) | i) - 1
            inside = j >= first[c + 1]
            j = np.maximum(j, 0)
            return np.where(inside, earlier[j] - earlier[np.minimum(first[c + 1], len(key) - 1)] + np.minimum(i - (key[j] & (1 << 48) - 1), length[j]), 0)

        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.run_length.sum())
        for c in patterns.T[::-1].astype(np.int64):
            low, high = smaller[c + 1] + occurrences(c, low), smaller[c + 1] + occurrences(c, high)
        return np.maximum(high - low, 0)

    def statistics(self) -> np.ndarray:
        """For every position the longest match with any other, up to cap: from the next sample on, one more a step back."""
        every = np.arange(len(self.data))
        k = np.searchsorted(self.samples, every)
        return np.minimum(self.sampled[k] + self.samples[k] - every, self.cap)

    def repeated(self) -> Iterator[tuple[int, int, int]]:
        """(string, first, last) of the stretches of starts whose cap bytes occur elsewhere."""
        hit = np.zeros(len(self.data) + 2, np.int8)
        hit[1:-1] = self.statistics() >= self.cap
        edge = np.flatnonzero(np.diff(hit))
        for a, b, s in zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), np.searchsorted(self.ends, edge[::2], "right").tolist(), strict=True):
            while a <= b:  # strings follow each other without a gap
                last = min(int(b), int(self.ends[s]) - 1)
                yield s, int(a - self.begins[s]), int(last - self.begins[s])
                a, s = last + 1, s + 1


def _batch(rows: list, types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))


LONG = pa.int64()
TAKEN = {"f": LONG, "sub": LONG, "seg": LONG, "base": LONG, "c": LONG, "bytes": pa.binary()}
MARKS = {"f": LONG, "seg": LONG, "c": LONG, "starts": pa.list_(LONG), "ends": pa.list_(LONG)}
SEGMENT = {"f": LONG, "seg": LONG, "doc": LONG, "rk": LONG, "s1": LONG, "s2": LONG, "inner": pa.bool_()}


def repeated_spans(docs: DataFrame, least: int = LEAST, k: int = KGRAM, id_col: str = "doc_id", text_col: str = "text", index_bytes: int = INDEX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): docs' rows as (doc, rk, doc_id, text) and the windows' stretches (doc, rk, start, end), end exclusive."""
    spark = docs.sparkSession
    prepare(spark)
    text = utf8(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumns({"doc": F.coalesce("doc_id", F.lit(-(1 << 63))), "rk": F.xxhash64("doc_id", "text")})
    long = rows.where(F.octet_length("text") >= least).select("doc", "rk", "text")

    def smallest(batches):
        for b in batches:
            fs = [np.unique(f) for _, f, _, _, _ in segments(b.column(2).to_pylist(), Demotion(np.zeros(0, np.uint64)), least, k)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*fs, np.zeros(0, np.int64)]))], names=["f"])

    # by a sample of documents: only where a very common passage is dealt depends on it, not what is found
    sample = long.where(F.pmod("rk", F.lit(16)) == 0)
    often = sample.mapInArrow(smallest, "f long").groupBy("f").count().where("count >= 8").orderBy(F.desc("count"), "f").limit(10_000)
    hot = np.array([r[0] for r in often.collect()], np.int64)
    send = spark.sparkContext.broadcast(hot)

    def cut(batches):
        demote = Demotion(send.value)
        for b in batches:
            doc, rk, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            out = {n: [] for n in SEGMENT}
            for i, f, s1, s2, inner in segments(texts, demote, least, k):
                t = memoryview(texts[i])
                seg = b"".join([hashlib.blake2b(t[a:z], digest_size=8).digest() for a, z in zip(s1.tolist(), (s2 + least).tolist(), strict=True)])
                for n, v in zip(SEGMENT, (f, np.frombuffer(seg, np.int64), np.full(len(f), doc[i]), np.full(len(f), rk[i]), s1, s2, inner), strict=True):
                    out[n].append(v)
            if out["f"]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out.values()], names=list(out))

    ddl = "f long, seg long, doc long, rk long, s1 long, s2 long, inner boolean"
    found = materialize(long.mapInArrow(cut, ddl), "segments")
    again = found.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.max("inner").alias("i")).where("n > 1 or i").select("f", "n")
    again = materialize(again, "repeated-keys")
    total = again.agg(F.sum("n")).first()[0] or 0
    close = join_classes(found.drop("inner"), again, ["f"], "n", total, F.xxhash64("rk", "s1"))
    close = materialize(close.where("n is not null").drop("n"), "close-segments")
    distinct = close.groupBy("f", "seg").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc", "rk", "s1", "s2")).alias("x"))
    distinct = materialize(distinct.select("f", "seg", "c", "x.*"), "distinct-segments")

    # the bytes of each distinct segment, from the whole text of one document that has it
    large = distinct.groupBy("f").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("s2") - F.col("s1") + least).alias("size")).where(F.col("size") > 4 * index_bytes).select("f", "k")
    flagged = join_classes(distinct, large, ["f"], "k", distinct.count(), F.xxhash64("rk", "s1")).withColumn("wide", F.col("k").isNotNull())
    wanted = flagged.groupBy(F.col("doc").alias("d"), F.col("rk").alias("r")).agg(F.collect_list(F.struct("f", "seg", "c", "wide", "s1", "s2")).alias("l")).hint("shuffle_hash")  # a document's own segments
    taken = long.join(wanted, (F.col("doc") == F.col("d")) & (F.col("rk") == F.col("r"))).select(F.explode("l").alias("x"), "text")
    taken = taken.select("x.f", "x.seg", "x.c", "x.wide", F.expr(f"substring(text, int(x.s1) + 1, int(x.s2 - x.s1) + {least})").alias("bytes"))

    def dealt(batches):
        """Segments of an f with more than four blocks of bytes are cut anew, by the smallest of longer k-grams: equal windows stay together."""
        none, deep = Demotion(np.zeros(0, np.uint64)), min(least, 2 * k)
        for b in batches:
            rows = []
            for f, seg, c, wide, data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if wide:
                    for _, g, s1, s2, _ in segments([data], none, least, deep):
                        rows += [(f, x, seg, a, c, data[a : z + least]) for x, a, z in zip(g.tolist(), s1.tolist(), s2.tolist(), strict=True)]
                else:
                    rows.append((f, 0, seg, 0, c, data))
            if rows:
                yield _batch(rows, TAKEN)

    taken = taken.mapInArrow(dealt, "f long, sub long, seg long, base long, c long, bytes binary")
    taken = taken.repartition("f", "sub").sortWithinPartitions("f", "sub", "seg", "base")

    def index(batches):
        held, size, last = [], 0, None
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if held and row[:4] == held[-1][:4]:
                    continue  # a repeated row of documents brought the same segment
                if size > index_bytes and row[:2] != last:
                    yield from mark(held)
                    held, size = [], 0
                held.append(row)
                last, size = row[:2], size + len(row[5])
        if held:
            yield from mark(held)

    def mark(held):
        out: dict[int, list] = {}
        for s, a, z in RunLengthIndex([r[5] for r in held], least, [r[4] for r in held]).repeated():
            out.setdefault(s, []).append((held[s][3] + a, held[s][3] + z + least))
        if out:
            yield _batch([(held[s][0], held[s][2], held[s][4], [a for a, _ in v], [z for _, z in v]) for s, v in out.items()], MARKS)

    marks = materialize(taken.mapInArrow(index, "f long, seg long, c long, starts array<long>, ends array<long>"), "marks")
    whole = join_classes(close, marks, ["f", "seg"], "c", total, F.xxhash64("rk", "s1")).where("c is not null")
    spans = whole.select("doc", "rk", "s1", F.explode(F.arrays_zip("starts", "ends")).alias("x"))
    return rows, spans.select("doc", "rk", (F.col("s1") + F.col("x.starts")).alias("start"), (F.col("s1") + F.col("x.ends")).alias("end"))


def remove_repeats(docs: DataFrame, least: int = LEAST, k: int = KGRAM, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (and kept, the bytes that remain, if asked for).

    Removed is each byte covered by a string of `least` bytes that also starts anywhere else, in this document or another;
    all strings are judged on the input. Null text counts as empty; texts shorter than `least` keep all. A row that
    repeats another's text loses all of it. No rows: no rows. Other columns play no part.
    """
    rows, spans = repeated_spans(docs, least, k, id_col, text_col)
    lists = spans.groupBy(F.col("doc").alias("d"), F.col("rk").alias("r")).agg(F.collect_set(F.struct("start", "end")).alias("l")).hint("shuffle_hash")  # a document's own spans
    joined = rows.join(lists, (F.col("doc") == F.col("d")) & (F.col("rk") == F.col("r")), "left").select("doc_id", "text", F.transform("l", lambda x: x.start).alias("starts"), F.transform("l", lambda x: x.end).alias("ends"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"] + ["kept"] * keep_bytes

    def finish(batches):
        for b in batches:
            out = []
            for doc, text, starts, ends in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                runs: list[list[int]] = []
                for a, z in sorted(zip(starts or (), ends or (), strict=True)):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(z, runs[-1][1])
                    else:
                        runs.append([a, z])
                cuts = [0, *(x for r in runs for x in r), len(text)]
                kept = b"".join([text[a:z] for a, z in zip(cuts[::2], cuts[1::2], strict=True)])
                out.append((doc, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [x for r in runs for x in r], *[kept] * keep_bytes))
            if out:
                types = (LONG, LONG, LONG, LONG, pa.string(), pa.list_(LONG), pa.binary())
                yield _batch(out, dict(zip(names, types, strict=False)))

    return joined.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>" + ", kept binary" * keep_bytes)
