"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and their characters, in numpy.

A word enters as its own vector (frequent words of the training sample; the others share one) plus the mean of vectors of
its character n-grams plus learnt directions times its evidence: how much more often toxic documents of the sample have
the word, or twice one of its n-grams, than others. In training a document's words have the evidence of the other folds'
documents, so the network learns what evidence is worth on documents it was not counted on, also from few labels. A long word counts as several, its overlapping pieces. A document is cut into overlapping windows, all of them are scored, and the largest counts; in
training too, where the gradient flows through the largest window of each document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dubflow.llm.common import prepare
from dubflow.llm.quality import fold, training_sample

#: Labelled rows that the network is fitted on at most, all windows of each. Scoring has no such bound.
TRAIN_ROWS = 4_000
#: Windows that pass through the network at once.
TOGETHER = 4096
THRESHOLD = 0.5
#: Steps of training at least, however few the rows.
LEAST_STEPS = 320
WINDOW, STRIDE = 64, 48
WORDS, NGRAMS, DIM, HIDDEN = 4096, 8192, 16, 8
#: Words with evidence at most, hashed n-grams with evidence, folds of the training rows that it is counted by, and
#: pseudo-documents behind each word.
EVIDENCE_WORDS, EVIDENCE_GRAMS, FOLDS, PSEUDO = 16_384, 1 << 20, 5, 4.0
#: Standard errors from which on evidence counts.
SURE = 2.0
CACHE_WORDS = 200_000
#: Bytes of a word at most, and bytes that neighbouring pieces of a longer one share.
PIECE, SHARED = 96, 16
_TRIM = ".,;:!?\"'()[]{}|#$%&*-_~`<>/\\=+@^"


def pieces(word: str) -> list[str]:
    """The word, or if it has over PIECE bytes, overlapping pieces of whole characters that hold all of it, a space before each."""
    raw = word.encode("utf-8", "replace")
    if len(raw) <= PIECE:
        return [word]
    out, a, z = [], 0, 0
    while z < len(raw):
        z = min(a + PIECE, len(raw))
        while z < len(raw) and raw[z] & 0xC0 == 0x80:
            z -= 1
        out.append(" " + raw[a:z].decode("utf-8"))
        a = z - SHARED
        while raw[a] & 0xC0 == 0x80:
            a -= 1
    return out


def split_words(text: str) -> list[str]:
    words = text.lower().split()
    if len(max(words, key=len, default="")) * 4 <= PIECE:
        return words
    return [p for w in words for p in (pieces(w) if len(w) * 4 > PIECE else (w,))]


def bare(word: str) -> str:
    """The word without signs around it; a piece of a word, known by its space, whole."""
    return word[1:] if word[:1] == " " else word.strip(_TRIM) or word[:1]


def ngram_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of the words between their ends, where each word's rows begin, and longer n-grams hashed more finely.

    A row for each byte, a column for each n (3 to 5 bytes, 4 to 6); NGRAMS and EVIDENCE_GRAMS stand for none.
    """
    raw = [b"<" + (w.encode("utf-8", "replace") or b" ") + b">" for w in words]
    begins = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    left = np.repeat(begins[1:], np.diff(begins)) - np.arange(len(data))
    out, fine = np.full((len(data), 3), NGRAMS, np.int64), np.full((len(data), 3), EVIDENCE_GRAMS, np.int64)
    h = data * np.uint32(2654435761)
    for n in (2, 3, 4, 5, 6):
        shifted = np.concatenate([data[n - 1 :], np.zeros(n - 1, np.uint32)])[: len(data)]
        h = (h ^ shifted) * np.uint32(16777619) + np.uint32(n)
        if 2 < n < 6:
            out[:, n - 3] = np.where(left >= n, (h >> np.uint32(9)) % np.uint32(NGRAMS), NGRAMS)
        if n > 3:
            fine[:, n - 4] = np.where(left >= n, (h ^ h >> np.uint32(15)) % np.uint32(EVIDENCE_GRAMS), EVIDENCE_GRAMS)
    return out, begins[:-1], fine


def windows(n: int) -> list[tuple[int, int]]:
    """(start, end) of the windows over n words: each STRIDE words one, the last reaching the end."""
    if n <= WINDOW:
        return [(0, n)]
    starts = list(range(0, n - WINDOW, STRIDE)) + [n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _tanh(x):
    return 2 / (1 + np.exp(-2 * x)) - 1


def evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """From 0 to 1, of what so many documents of each class have: by the log odds over the classes' own, shrunk, as far as
    they are sure and large."""
    if not n_toxic or not n_clean:
        return np.zeros(len(toxic), np.float32)
    share = n_toxic / (n_toxic + n_clean)
    a, b = toxic + PSEUDO * share, clean + PSEUDO * (1 - share)
    odds = np.maximum(np.log(a / b) - np.log(share / (1 - share)), 0)
    return (np.tanh(np.maximum(odds / np.sqrt(1 / a + 1 / b) - SURE, 0) / 2) * np.tanh(odds / 2)).astype(np.float32)


def largest(table: np.ndarray, fine: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The largest value among each word's n-grams."""
    return np.maximum.reduceat(table.take(fine).max(1), begins) if len(begins) else np.zeros(0, np.float32)


class Network:
    """Parameters p: the directions of evidence E; word and n-gram vectors; for each direction W (inputs), U (state), b of update, reset and candidate; attention; output."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.vocabulary, self.evidence, self.gram_evidence = vocabulary, {}, np.zeros(EVIDENCE_GRAMS + 1, np.float32)
        new = lambda *s, k=0.3: (rng.standard_normal(s) * k).astype(np.float32)
        self.p = {"words": new(WORDS, DIM, k=0.1), "ngrams": new(NGRAMS, DIM, k=0.1), "E": new(2, DIM, k=1.0)}
        for d in "fb":
            self.p |= {f"W{d}": new(DIM, 3 * HIDDEN), f"U{d}": new(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": new(2 * HIDDEN, HIDDEN), "a": new(HIDDEN), "o": new(2 * HIDDEN), "o0": np.array([-2.0], np.float32)}

    # words to vectors

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word rows, the words' n-grams in one array with where each word's begin, and their evidence."""
        bares = [bare(w) for w in words]
        grams, begins, fine = ngram_ids(bares)
        known = np.stack([np.array([self.evidence.get(w, 0) for w in bares], np.float32), largest(self.gram_evidence, fine, begins)], 1)
        return np.array([self.vocabulary.get(w, 0) for w in bares], np.int64), grams, begins, known

    def vectors(self, looked: tuple) -> np.ndarray:
        rows, grams, begins, known = looked
        table = np.concatenate([self.p["ngrams"], np.zeros((1, DIM), np.float32)])
        each = table.take(grams[:, 0], 0)
        each += table.take(grams[:, 1], 0)
        each += table.take(grams[:, 2], 0)
        return self.p["words"][rows] + known @ self.p["E"] + np.add.reduceat(each, begins, axis=0) / self.sizes(looked)[:, None]

    @staticmethod
    def sizes(looked: tuple) -> np.ndarray:
        return np.add.reduceat((looked[1] < NGRAMS).sum(1), looked[2]).astype(np.float32)

    # windows to logits; x: a row per distinct word, at: words of each window, real: which are not padding

    def forward(self, x: np.ndarray, at: np.ndarray, real: np.ndarray, keep: bool = False):
        p, (n, t) = self.p, at.shape
        by_step, live = np.ascontiguousarray(at.T), np.ascontiguousarray(real.T)[:, :, None].astype(np.float32)
        states, tape = np.empty((t, n, 2 * HIDDEN), np.float32), {}
        for k, d in enumerate("fb"):
            inputs, u, h = x @ p[f"W{d}"] + p[f"b{d}"], p[f"U{d}"], np.zeros((n, HIDDEN), np.float32)
            steps = []
            for s in range(t) if d == "f" else range(t - 1, -1, -1):
                i = inputs.take(by_step[s], 0)
                zr = _sigmoid(i[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = _tanh(i[:, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
                new = h + z * (c - h) * live[s]
                if keep:
                    steps.append((s, h, z, r, c))
                h = new
                states[s, :, k * HIDDEN : (k + 1) * HIDDEN] = h
            tape[d] = steps
        m = _tanh(states @ p["A"])
        e = np.where(real.T, m @ p["a"], -1e9)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tn,tnh->nh", w, states)
        logit = pooled @ p["o"] + p["o0"][0]
        return (logit, (states, m, w, pooled, tape)) if keep else logit

    def backward(self, x, at, real, kept, g):
        """Gradients of all parameters but the vectors', and of x, for the logits' gradient g."""
        p, (states, m, w, pooled, tape) = self.p, kept
        grad = {"o": pooled.T @ g, "o0": np.array([g.sum()], np.float32)}
        to_pooled = g[:, None] * p["o"]
        to_states = w[:, :, None] * to_pooled
        to_w = np.einsum("tnh,nh->tn", states, to_pooled)
        to_e = w * (to_w - (w * to_w).sum(0))
        grad["a"] = np.einsum("tn,tnh->h", to_e, m)
        to_m = to_e[:, :, None] * p["a"] * (1 - m * m)
        grad["A"] = np.einsum("tnh,tnk->hk", states, to_m)
        to_states = to_states + to_m @ p["A"].T
        gx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u, to_inputs, gu = p[f"U{d}"], np.zeros((len(x), 3 * HIDDEN), np.float32), np.zeros_like(p[f"U{d}"])
            gh = np.zeros((at.shape[0], HIDDEN), np.float32)
            for s, h, z, r, c in reversed(tape[d]):
                gh = gh + to_states[s, :, k * HIDDEN : (k + 1) * HIDDEN]
                live = real[:, s, None]
                gc = gh * z * live * (1 - c * c)
                grh = gc @ u[:, 2 * HIDDEN :].T
                gz = gh * (c - h) * live * z * (1 - z)
                gr = grh * h * r * (1 - r)
                gzr = np.concatenate([gz, gr], 1)
                gu[:, 2 * HIDDEN :] += (r * h).T @ gc
                gu[:, : 2 * HIDDEN] += h.T @ gzr
                np.add.at(to_inputs, at[:, s], np.concatenate([gzr, gc], 1))
                gh = gh * (1 - z * live) + grh * r + gzr @ u[:, : 2 * HIDDEN].T
            grad |= {f"U{d}": gu, f"W{d}": x.T @ to_inputs, f"b{d}": to_inputs.sum(0)}
            gx += to_inputs @ p[f"W{d}"].T
        return grad, gx


def _windows_of(docs: list[np.ndarray], spans: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, real, document) of all windows; padding is word 0."""
    owner = np.repeat(np.arange(len(docs)), [len(s) for s in spans])
    at, real = np.zeros((len(owner), WINDOW), np.int64), np.zeros((len(owner), WINDOW), bool)
    k = 0
    for ids, some in zip(docs, spans, strict=True):
        for a, b in some:
            at[k, : b - a] = ids[a:b]
            real[k, : b - a] = True
            k += 1
    return at, real, owner


def train(texts: list[str], y: np.ndarray, epochs: int = 4, batch: int = 128, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam on the logistic loss of each document's largest window. Without both classes the network gives a low score to all."""
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in split_words(t)], np.int32) for t in texts]
    bares: dict[str, int] = {}
    names = np.array([bares.setdefault(bare(w), len(bares)) for w in index], np.int64)  # words differ by signs around them
    listed = list(bares)
    _, starts, fine = ngram_ids(listed)
    stops = np.append(starts[1:], len(fine))
    fold_of = np.random.default_rng(seed).permutation(len(docs)) % FOLDS
    have = np.zeros((FOLDS, 2, len(listed)), np.int32)
    have_grams = np.zeros((FOLDS, 2, EVIDENCE_GRAMS + 1), np.int32)  # documents that have one twice
    for ids, k, label in zip(docs, fold_of, y, strict=True):
        mine, times = np.unique(names[ids], return_counts=True)
        have[k, int(label), mine] += 1
        n = stops[mine] - starts[mine]
        at = np.repeat(starts[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
        grams, where = np.unique(fine[at], return_inverse=True)
        have_grams[k, int(label), grams[np.bincount(where.ravel(), np.repeat(np.repeat(times, n), 3), len(grams)) > 1]] += 1
    seen = have.sum((0, 1))
    frequent = sorted(np.flatnonzero(seen >= 3).tolist(), key=lambda i: (-seen[i], listed[i]))[: WORDS - 1]
    net = Network({listed[i]: k + 1 for k, i in enumerate(frequent)}, seed)
    if len(y) == 0 or y.min() == y.max():
        net.p["o"][:] = 0
        return net

    def known(folds: list[int]) -> tuple[np.ndarray, np.ndarray]:
        mine = np.isin(fold_of, folds)
        sizes = int(y[mine].sum()), int((1 - y[mine]).sum())
        table = evidence(have_grams[folds, 1].sum(0), have_grams[folds, 0].sum(0), *sizes)
        table[EVIDENCE_GRAMS] = 0
        return evidence(have[folds, 1].sum(0), have[folds, 0].sum(0), *sizes), table

    every, net.gram_evidence = known(list(range(FOLDS)))
    strongest = np.argsort(-every, kind="stable")[:EVIDENCE_WORDS]
    net.evidence = {listed[i]: float(every[i]) for i in strongest if every[i]}
    elsewhere = []
    for k in range(FOLDS):
        words, table = known([j for j in range(FOLDS) if j != k])
        elsewhere.append(np.stack([words, largest(table, fine, starts)], 1)[names])
    rows, grams, begins, _ = net.lookup(list(index))
    ends = np.append(begins[1:], len(grams))

    def some(used: np.ndarray, k: int) -> tuple:
        n = ends[used] - begins[used]
        first = np.cumsum(n) - n
        return rows[used], grams[np.repeat(begins[used] - first, n) + np.arange(n.sum())], first, elsewhere[k][used]

    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    rng, step = np.random.default_rng(seed), 0
    batch = min(batch, max(16, len(docs) // 8))
    epochs = max(epochs, -(-LEAST_STEPS * batch // len(docs)))
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        parts = [(k, mine[i : i + batch]) for k in range(FOLDS) for mine in [order[fold_of[order] == k]] for i in range(0, len(mine), batch)]
        for j in rng.permutation(len(parts)):
            fold_now, mine = parts[j]
            spans = [windows(len(docs[k])) for k in mine]
            flat = [(k, span) for k, each in enumerate(spans) for span in each]
            top, best = np.full(len(mine), -np.inf), [None] * len(mine)
            for j in range(0, len(flat), TOGETHER):
                now = flat[j : j + TOGETHER]
                at, real, _ = _windows_of([docs[mine[k]] for k, _ in now], [[span] for _, span in now])
                used, inverse = np.unique(at, return_inverse=True)
                logit = net.forward(net.vectors(some(used, fold_now)), inverse.reshape(real.shape), real)
                for (k, span), v in zip(now, logit.tolist(), strict=True):
                    if best[k] is None or v > top[k]:
                        top[k], best[k] = v, span
            at, real, _ = _windows_of([docs[k] for k in mine], [[span] for span in best])
            used, inverse = np.unique(at, return_inverse=True)
            part, inverse = some(used, fold_now), inverse.reshape(-1, WINDOW)
            x = net.vectors(part)
            logit, kept = net.forward(x, inverse, real, keep=True)
            g = ((_sigmoid(logit) - y[mine]) / len(mine)).astype(np.float32)
            grad, gx = net.backward(x, inverse, real, kept, g)
            each = np.repeat(gx / net.sizes(part)[:, None], np.diff(np.append(part[2], len(part[1]))), axis=0)
            at_rows, at_grams = part[0], part[1].T.ravel()
            grad["E"] = part[3].T @ gx
            grad["words"] = np.stack([np.bincount(at_rows, gx[:, j], WORDS) for j in range(DIM)], 1)
            grad["ngrams"] = np.stack([np.bincount(at_grams, np.tile(each[:, j], 3), NGRAMS + 1)[:NGRAMS] for j in range(DIM)], 1)
            step += 1
            now = rate * (1 - 0.8 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, v in grad.items():
                m, s = state[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                net.p[k] -= (now * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
    return net


class Scorer:
    """Scores whole texts; remembers a bounded number of words and their projected vectors."""

    def __init__(self, net: Network) -> None:
        self.net, self.index, self.x = net, {}, np.zeros((0, DIM), np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self.index) > CACHE_WORDS:
            self.index, self.x = {}, self.x[:0]
        words = [split_words(t) for t in texts]
        index = self.index
        new = list(dict.fromkeys(w for ws in words for w in ws if w not in index))
        if not len(self.x):
            new.insert(0, "")
        if new:
            for w in new:
                index[w] = len(index)
            parts = [self.net.vectors(self.net.lookup(new[i : i + 20_000])) for i in range(0, len(new), 20_000)]
            self.x = np.concatenate([self.x, *parts])
        out, held, size = np.zeros(len(texts), np.float32), [], 0
        for k, ws in enumerate(words):
            held.append(k)
            size += len(ws)
            if size > 60_000 or k == len(words) - 1:
                docs = [np.fromiter(map(index.__getitem__, words[j]), np.int64, len(words[j])) for j in held]
                for j, ids in zip(held, docs, strict=True):
                    out[j] = -np.inf
                at, real, owner = _windows_of(docs, [windows(len(d)) for d in docs])
                for i in range(0, len(at), 4096):
                    part = slice(i, i + 4096)
                    used, inverse = np.unique(at[part], return_inverse=True)
                    logit = self.net.forward(self.x[used], inverse.reshape(-1, WINDOW), real[part])
                    np.maximum.at(out, np.array(held)[owner[part]], logit)
                held, size = [], 0
        return _sigmoid(out.astype(np.float64))


def fit_toxicity(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Network:
    """The network, fitted on the driver on at most `limit` labelled rows, sent whole."""
    prepare(docs.sparkSession)
    rows = sorted(map(tuple, training_sample(docs, labels, "toxic", limit).select("__id", "y", "text").collect()))  # at most `limit`
    return train([r[2] for r in rows], np.array([r[1] for r in rows], np.float32))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = TRAIN_ROWS) -> DataFrame:
    """Per row of docs: doc_id, held_out (fold 0), score, predicted. Null text counts as empty and has one empty window.

    Every word of a text lies in a window and every window is scored. Labels other than 0 and 1 are left out; of several
    for an id the largest counts. No rows, no scores; other columns play no part.
    """
    send = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, limit))

    def run(batches):
        scorer = Scorer(send.value)
        for b in batches:
            got = scorer.scores(b.column(1).to_pylist()) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
