"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs with at most k edits has one of its k + 1 pieces unchanged. All pieces of a block of items form one
Aho-Corasick automaton; each hit fixes where the item would lie, and Myers' bit-parallel distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dubflow.llm.common import columns, lean, materialize, prepare

#: Edits allowed, as a share of the item's characters; bytes of items that one broadcast may have.
EDIT_SHARE, BLOCK_BYTES = 0.08, 8 << 20
MATCH = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("match_start", pa.int64()), ("match_end", pa.int64())])
MATCH_DDL = "doc_id long, item_id long, distance int, match_start long, match_end long"


def normalise(text: str) -> str:
    """Lower case, runs of white space as one space: what both sides are compared as."""
    return " ".join(text.lower().split())


def split_pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces as even as can be, each with its offset."""
    n = budget + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers_search(masks: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """(least distance, first end) of the pattern anywhere in the text, None if over `most`: Myers 1999, one column a character."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end, get = most + 1, 0, masks.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & full
        down = down << 1 & full
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if score < best:
            best, end = score, j
    return (best, end) if best <= most else None


class Matcher:
    """The items of a block: pieces to find, and their masks."""

    def __init__(self, items: list[tuple[int, str]], share: float = EDIT_SHARE) -> None:
        import ahocorasick

        self.items, where = [], {}
        for item_id, text in items:
            if not (t := normalise(text or "")):
                continue
            k = int(share * len(t))
            for at, piece in split_pieces(t, k):
                where.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, len(t), k, myers_masks(t), myers_masks(t[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def search(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item id, distance, start, end) in the normalised text: the best, then first, place of each item that occurs."""
        if not self.items:
            return
        text = normalise(text)
        starts: dict[int, set] = {}
        for end, (n, places) in self.automaton.iter(text):
            for k, at in places:
                starts.setdefault(k, set()).add(end + 1 - n - at)
        for k, found in sorted(starts.items()):
            item_id, m, most, masks, backward = self.items[k]
            best, until = None, -1
            for s in sorted(found):
                low, high = max(0, s - most), s + m + most
                if best is not None and best[0] == 0:
                    break
                if high <= until:
                    continue
                until = high + most  # hits up to 2 * most further on lie in the same stretch
                got = myers_search(masks, m, text[low : until], most)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], low + got[1])
            if best:
                back = myers_search(backward, m, text[max(0, best[1] - m - best[0]) : best[1]][::-1], best[0])
                yield item_id, best[0], best[1] - (back[1] if back else m), best[1]


def _leaks(docs: DataFrame, benchmark: DataFrame, share: float, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """The columns of find_leaks and text_hash, which with doc_id tells rows apart that share an id."""
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).where("text is not null")
    out = None
    for k in range(blocks):
        part = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]
        send = spark.sparkContext.broadcast(part)

        def run(batches, send=send):
            matcher = Matcher(send.value, share)
            for b in batches:
                rows = [(h, doc, *found) for doc, text, h in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for found in matcher.search(text)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), *MATCH.types], strict=True)], names=["text_hash", *MATCH.names])

        found = texts.mapInArrow(lean(run), "text_hash long, " + MATCH_DDL)
        if blocks > 1:  # a block's items leave memory before the next block's come
            found = materialize(found, "leaks")
            send.unpersist(blocking=True)
        out = found if out is None else out.unionByName(found)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, match_start, match_end) for each document and item with an occurrence in its budget.

    The budget is int(share * characters of the normalised item); offsets are in the normalised text. Items are
    broadcast a block of bounded bytes at a time, each block against all documents, so a benchmark of any size is whole.
    Null or blank texts and items match nothing; equal items match each; a repeated row gives its rows again.
    """
    return _leaks(docs, benchmark, share, id_col, text_col, block_bytes).drop("text_hash")


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """docs without the rows in whose text an item occurs, whatever other rows share their id; all columns stay."""
    leaks = _leaks(docs, benchmark, share, "doc_id", "text", BLOCK_BYTES).select(F.col("doc_id").alias("leak"), "text_hash")
    leaks = materialize(leaks.distinct(), "leaks")
    rows = docs.select(F.struct(*columns(docs)).alias("row"))
    hit = F.col("row.doc_id").cast("long").eqNullSafe(F.col("leak")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("text_hash"))
    return rows.join(leaks, hit, "left_anti").select("row.*")
