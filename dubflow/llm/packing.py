"""Best-two-fit packing of tokenised documents into sequences.

The plan is made on the histogram of lengths, which has one entry per possible length whatever the input: a pattern (a
multiset of lengths) is built for one bin - fill greedily, then replace the smallest document by two unpacked ones that
fit the expanded gap more tightly - and repeated as often as its lengths last. Documents then find their place from
their rank among those of equal length, so no task sees more than a bounded share and the packing is the global one.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dubflow.llm.common import lean, materialize, prepare, trim

MAX_TOKENS, END_ID = 4096, 1
#: Distinct words, and parts of words, that a worker remembers; ranks are counted in groups of about so many rows.
CACHE_WORDS, RANK_ROWS = 400_000, 5_000
#: Characters of text that are words in memory at once (but for one longer text).
SPLIT_CHARS = 512 << 10
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: White space as the tokenizer's own patterns have it (str.split() also splits at 1C-1F).
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: The pre-tokenizer's pattern: a fixed value of the tokenizer file.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ODD = re.compile("[\x1c-\x1f]")
#: Signs that are a part of their own at the end of a word of letters.
SIGNS = frozenset(".,;:!?")


class WordTokenizer:
    """Ids of a text as the tokenizer file gives them, word by word: its pre-tokenizer never joins across white space."""

    def __init__(self, path: str) -> None:
        self.remembered = CACHE_WORDS
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece of the pre-tokenizer
        self.closes[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.split = regex.compile(PIECE)
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        return [w for w in SPACE.split(text) if w] if ODD.search(text) else text.split()

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Ids of new words. Latin-1 words are cut as the pre-tokenizer cuts them, and new parts encoded many to a call."""
        plain, cut, rest = [], [], []
        for w in words:
            if not (w.isascii() or max(w) <= "\xff"):
                rest.append(w)
                continue
            if w.isalpha():  # one part
                ps = (w.lower(),)
            elif w[-1] in SIGNS and w[:-1].isalpha():
                ps = (w[:-1].lower(), w[-1])
            elif "<|" in w or ODD.search(w):
                rest.append(w)
                continue
            else:
                ps = self.split.findall(w.lower())
            plain.append(w)
            cut.append(ps)
        for i in range(0, len(rest), 20_000):
            self.known.update(zip(rest[i : i + 20_000], self._each(rest[i : i + 20_000]), strict=True))
        if len(self.parts) > CACHE_WORDS:
            self.parts = {}
        parts = self.parts
        new = list({p for ps in cut for p in ps if p not in parts})
        groups = [new[i : i + 100] for i in range(0, len(new), 100)]
        for i in range(0, len(groups), 100):
            some = groups[i : i + 100]
            for group, e in zip(some, self.tokenizer.encode_batch_fast([" ".join(g) for g in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) == len(group):
                    raw, at = ids.tobytes(), 0
                    for p, end in zip(group, (4 * ends).tolist(), strict=True):
                        parts[p] = raw[at:end]
                        at = end
                else:
                    parts.update(zip(group, self._each(group), strict=True))
        for w, ps in zip(plain, cut, strict=True):
            self.known[w] = parts[ps[0]] if len(ps) == 1 else b"".join([parts[p] for p in ps])

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, some at a time: the words of a whole batch take many times its bytes."""
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= SPLIT_CHARS:
                yield from self._some(some)
                some, size = [], 0
        yield from self._some(some)

    def _some(self, texts: list[str]) -> Iterator[bytes]:
        split = [self.words(t) for t in texts]
        if len(self.known) > self.remembered:
            self.known, self.earlier = {}, self.known
        known, earlier, new = self.known, self.earlier, []
        for w in {w for words in split for w in words if w not in known}:
            if (ids := earlier.get(w)) is not None:
                known[w] = ids
            else:
                new.append(w)
        self._learn(new)
        for words in split:
            yield b"".join([known[w] for w in words])


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str, remembered: int = CACHE_WORDS) -> WordTokenizer:
    """One a worker, kept between tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    _tokenizers[path].remembered = remembered
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", remembered: int = CACHE_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and end_id, cut only where there are over max_tokens."""
    prepare(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        t = tokenizer(path, remembered)
        for b in batches:
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), t.ids(b.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    part = ids[at : at + 4 * max_tokens]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)
                del rows
            trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(lean(run), PIECES_DDL)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns (times, lengths) that use up the counts; no pattern is longer than the capacity."""
    left = np.zeros(capacity + 1, np.int64)
    for k, v in counts.items():
        left[k] = v
    every, patterns = np.arange(capacity + 1), []
    while True:
        free = np.flatnonzero(left)
        if not len(free):
            return patterns
        below = np.maximum.accumulate(np.where(left > 0, every, 0))  # the largest unpacked length up to x, 0: none
        used: Counter = Counter()

        def fitting(x: int) -> int:
            k = int(below[x]) if x > 0 else 0
            while k and left[k] <= used[k]:
                k = int(below[k - 1])
            return k

        items, gap = [], capacity
        while k := fitting(gap):
            items.append(k)
            used[k] += 1
            gap -= k
        while gap and items:
            least = items[-1]
            used[least] -= 1
            room = gap + least
            # every pair of unpacked lengths: to each first one the largest second one that fits
            unpacked = left.copy()
            for k, n in used.items():
                unpacked[k] -= n
            first = np.flatnonzero(unpacked[:room])
            largest = np.maximum.accumulate(np.where(unpacked > 0, every, 0))
            second = largest[room - first]
            alone = (second == first) & (unpacked[first] < 2)
            second[alone] = largest[first[alone] - 1]
            sums = np.where(second > 0, first + second, 0)
            best, pair = least, None
            if len(sums) and sums.max() > least:
                i = int(sums.argmax())
                best, pair = int(sums[i]), (int(first[i]), int(second[i]))
            if pair is None:
                used[least] += 1
                break
            items.pop()
            for k in pair:
                items.append(k)
                used[k] += 1
            items.sort(reverse=True)
            gap = room - best
        times = min(int(left[k]) // n for k, n in used.items() if n)
        for k, n in used.items():
            left[k] -= times * n
        patterns.append((times, items))


def places(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """The plan as sorted arrays: a stretch of ranks of one length lies in consecutive sequences, `per` to each."""
    taken: Counter = Counter()
    rows, offsets, seq = [], [], 0
    for times, items in patterns:
        at, where = 0, {}
        for k in items:
            where.setdefault(k, []).append(at)
            at += k
        for k, offs in where.items():
            rows.append((k, taken[k], len(offs), seq, len(offsets)))
            offsets += offs
            taken[k] += times * len(offs)
        seq += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": (a[:, 0] << 44) | a[:, 1], "rank": a[:, 1], "per": a[:, 2], "seq": a[:, 3], "at": a[:, 4], "offsets": np.array(offsets, np.int64)}


def find_place(p: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.searchsorted(p["key"], (length << 44) | rank, "right") - 1
    r = rank - p["rank"][i]
    return p["seq"][i] + r // p["per"][i], p["offsets"][p["at"][i] + r % p["per"][i]]


def pack(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", remembered: int = CACHE_WORDS) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (gapless from 0 in each sequence).

    Null text counts as empty: a piece of the end id alone. Rows with equal or null ids are documents each. Ties in length
    go by rank, in an order made of id, piece and checksum. No rows: no pieces. Other columns play no part.
    A worker remembers the ids of about `remembered` words, twice at most; fewer take less memory and more time.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, path, max_tokens, end_id, id_col, text_col, remembered), "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # max_tokens rows at most
    total = sum(counts.values())
    send = spark.sparkContext.broadcast(places(plan(counts, max_tokens)))  # grows with the lengths, not with the rows
    groups = max(1, total // RANK_ROWS)
    rows = cut.withColumn("__g", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    sizes = rows.groupBy("length", "__g").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__off", F.coalesce(F.sum("__n").over(Window.partitionBy("length").orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("length").alias("__l"), F.col("__g").alias("__gg"), "__off")
    inside = F.row_number().over(Window.partitionBy("length", "__g").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = rows.withColumn("__i", inside).join(before, (F.col("length") == F.col("__l")) & (F.col("__g") == F.col("__gg")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("__off") + F.col("__i") - 1).cast("long").alias("rank"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                seq, offset = find_place(send.value, b.column(3).to_numpy(), b.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(seq), pa.array(offset)], names=[*PIECES.names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, PIECES_DDL + ", sequence_id long, offset long")
