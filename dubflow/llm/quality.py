"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened for vectorised traversal.

Fitted on the driver on a bounded sample of labelled rows; every document's whole text is scored on the executors.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dubflow.llm.common import prepare

#: Labelled rows that a model is fitted on at most: those whose ids hash lowest.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
NAMES = (
    "log_bytes log_words word_length capitals digits punctuation symbols high_bytes spaces entropy distinct top_word again "
    "log_lines line_words same_lines ended bars capital_words long_words short_words alpha_words marks"
).split()
_CLASSES = np.zeros((256, 7), np.float64)
for _k, _set in enumerate((range(65, 91), range(48, 58), map(ord, ".,;:!?'\"-()"), map(ord, "#$%&*@^~_=+<>|/\\{}[]`"), range(128, 256), (9, 10, 11, 12, 13, 32), range(97, 123))):
    _CLASSES[list(_set), _k] = 1


def statistics(text: str) -> list[float]:
    """The document statistics, in the order of NAMES; an empty text has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, digits, punctuation, symbols, high, spaces, lower = counts @ _CLASSES / len(raw)
    p = counts[counts > 0] / len(raw)
    words = text.split()
    n = max(1, len(words))
    tally = Counter(words)
    lines = [x for x in text.split("\n") if x]
    joined = list(map(len, words))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sum(joined) / n, upper / max(1e-9, upper + lower), digits, punctuation, symbols, high, spaces, float(-(p * np.log2(p)).sum()),
        len(tally) / n, max(tally.values(), default=0) / n, sum(map(eq, words, words[1:])) / n,
        np.log1p(len(lines)), np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), sum(x[-1] in ".!?" for x in lines) / max(1, len(lines)), tally["|"] / n,
        sum(map(str.isupper, words)) / n, sum(x > 15 for x in joined) / n, sum(x < 3 for x in joined) / n, sum(map(str.isalpha, words)) / n, raw.count(b"!!") / n,
    ]


@dataclass
class Trees:
    """All trees in flat arrays: a node's split, children and value; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; all rows walk a tree together, a level a step."""
        out, row = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 5, rate: float = 0.1, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Boosting of logistic loss on binned columns: each level adds up gradients by (node, column, bin) and splits every node.

    Without rows, or with one class, the model is the (smoothed) share of ones.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    empty = Trees(*(np.zeros(0, t) for t in (np.int32, np.float64, np.int32, np.int32, np.float64, np.int32)), depth, base)
    if len(y) < 2 * least or y.min() == y.max():
        return empty
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    flat = binned + np.arange(d) * bins
    f, feature, threshold, left, right, value, roots = np.full(n, base), [], [], [], [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        root = len(value)
        roots.append(root)
        for a, v in ((feature, 0), (threshold, 0.0), (left, root), (right, root), (value, 0.0)):
            a.append(v)
        node, level = np.full(n, root), [root]
        for at_depth in range(depth + 1):
            where = np.full(len(value), -1)
            where[level] = np.arange(len(level))
            slot = where[node]
            rows = np.flatnonzero(slot >= 0)
            sums = [np.bincount(slot[rows], w[rows], len(level)) for w in (g, h)]
            for k, v in enumerate(level):
                value[v] = rate * sums[0][k] / (sums[1][k] + ridge)
            if at_depth == depth:
                break
            cells = (slot[rows, None] * (d * bins) + flat[rows]).ravel()
            gs, hs, ns = (np.bincount(cells, np.repeat(w[rows], d), len(level) * d * bins).reshape(len(level), d, bins).cumsum(2) for w in (g, h, np.ones(n)))
            gt, ht, nt = gs[:, :1, -1:], hs[:, :1, -1:], ns[:, :1, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(ns < least) | (nt - ns < least)] = 0
            best = gain.reshape(len(level), -1).argmax(1)
            split = {}
            for k, v in enumerate(level):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[v], threshold[v] = j, float(cuts[j][b])
                    left[v], right[v] = len(value), len(value) + 1
                    split[v] = (j, b)
                    for child in (len(value), len(value) + 1):
                        for a, w in ((feature, 0), (threshold, 0.0), (left, child), (right, child), (value, 0.0)):
                            a.append(w)
            if not split:
                break
            level = []
            for v, (j, b) in split.items():
                mine = node == v
                node[mine] = np.where(binned[mine, j] <= b, left[v], right[v])
                level += [left[v], right[v]]
        f += np.array(value)[node]
    return Trees(*(np.array(a, t) for a, t in ((feature, np.int32), (threshold, np.float64), (left, np.int32), (right, np.int32), (value, np.float64), (roots, np.int32))), depth, base)


def fold(id_col: Column) -> Column:
    """0 to 4: crc32 of the id as text, mod 5; a null id is in fold 0, so never learned from."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("long").cast("string").cast("binary")), F.lit(5)), F.lit(0))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(text, y) of at most `limit` labelled documents outside fold 0: those whose ids hash lowest."""
    known = labels.where(F.col(label).isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    few = known.orderBy(F.xxhash64("__id"), "__id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("__d"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(few), F.col("__d") == F.col("__id")).select("__id", "text", "y")


def fit_quality(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Trees:
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = np.array([statistics(t) for t in b.column(1).to_pylist()], np.float64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(rows), pa.list_(pa.float64()))], names=["id", "y", "x"])

    rows = sorted(map(tuple, training_sample(docs, labels, "quality", limit).mapInArrow(run, "id long, y int, x array<double>").collect()))  # at most `limit`
    return fit(np.array([r[2] for r in rows], np.float64).reshape(-1, len(NAMES)), np.array([r[1] for r in rows], np.float64))


def scorer(model: Trees):
    """A pandas UDF from text to quality."""
    import pandas as pd

    def score(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t or "") for t in texts], np.float64).reshape(-1, len(NAMES))
        return pd.Series(model.score(x))

    score.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(score, "double")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = TRAIN_ROWS) -> DataFrame:
    """Per row of docs: doc_id, held_out (fold 0), score, predicted. Null text counts as empty; no rows, no scores.

    Labels other than 0 and 1 are left out; of several for an id the largest counts. Only the text enters a score.
    """
    model = scorer(fit_quality(docs, labels, limit))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), model(F.col("text").cast("string")).alias("score"))
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that score at least the threshold; all columns, whatever their names, stay as they are."""
    model = scorer(fit_quality(docs, labels, limit))
    return docs.where(model(F.col("text").cast("string")) >= threshold)


def crc_fold(doc_id: int) -> int:
    """fold() on the driver, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 5
