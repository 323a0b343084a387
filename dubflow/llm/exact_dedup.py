"""Exact dedup by Grace hash partitioning.

Records are partitioned by content hash until a bucket fits an open-addressing table that compares complete content.
The first level is the shuffle; a bucket that still exceeds its budget is partitioned again, by other bits of the hash,
into spill files in the shared folder, and so on. Before the shuffle, each task collapses its own equal records in the
same kind of table, so a text that makes up a third of the input reaches its bucket once a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dubflow.llm.common import columns, join_classes, materialize, new_path, prepare, utf8

#: Bytes of content a table holds before the bucket is split; files that one level splits a bucket into.
TABLE_BYTES, FAN_OUT, ENTRY_BYTES = 96 << 20, 16, 200
RECORD = pa.schema([("h", pa.int64()), ("sha", pa.binary()), ("max_id", pa.int64()), ("n", pa.int64()), ("content", pa.binary())])
CLASS = pa.schema([("sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
RECORD_DDL, CLASS_DDL = "h long, sha binary, max_id long, n long, content binary", "sha binary, keep_id long, group_size long"


class ContentTable:
    """Open addressing with linear probing; entries are equal only if their complete contents are."""

    def __init__(self) -> None:
        self.mask, self.slots = 1023, [-1] * 1024
        self.rows: list[list] = []  # [h, sha, max_id, n, content]
        self.bytes = 0

    def _slot(self, h: int, content: bytes) -> int:
        i = (h * 0x9E3779B97F4A7C15 >> 20) & self.mask
        while (at := self.slots[i]) >= 0:
            row = self.rows[at]
            if row[0] == h and row[4] == content:
                return i
            i = (i + 1) & self.mask
        return i

    def find(self, h: int, content: bytes) -> list | None:
        at = self.slots[self._slot(h, content)]
        return self.rows[at] if at >= 0 else None

    def add(self, h: int, sha: bytes, max_id: int | None, n: int, content: bytes) -> None:
        i = self._slot(h, content)
        if (at := self.slots[i]) >= 0:
            row = self.rows[at]
            row[3] += n
            if max_id is not None and (row[2] is None or max_id > row[2]):
                row[2] = max_id
            return
        self.slots[i] = len(self.rows)
        self.rows.append([h, sha, max_id, n, content])
        self.bytes += len(content) + ENTRY_BYTES
        if 2 * len(self.rows) > self.mask:
            self.mask, self.slots = 2 * self.mask + 1, [-1] * (2 * self.mask + 2)
            for k, row in enumerate(self.rows):
                self.slots[self._slot(row[0], row[4])] = k


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _in_batches(rows: list, schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    start, size = 0, 0
    for k, row in enumerate(rows):
        size += len(row[-1]) if isinstance(row[-1], bytes) else 64
        if size > most:
            yield _batch(rows[start : k + 1], schema)
            start, size = k + 1, 0
    if start < len(rows):
        yield _batch(rows[start:], schema)


def collapse(batches: Iterable[pa.RecordBatch], budget: int = TABLE_BYTES) -> Iterator[pa.RecordBatch]:
    """A task's records with equal ones merged; the table is emitted and emptied whenever it is full."""
    table = ContentTable()
    for r in _records(batches):
        table.add(*r)
        if table.bytes > budget:
            yield from _in_batches(table.rows, RECORD)
            table = ContentTable()
    yield from _in_batches(table.rows, RECORD)


def grace(batches: Iterable[pa.RecordBatch], scratch: str, budget: int = TABLE_BYTES, level: int = 0) -> Iterator[list]:
    """[sha, largest id, records] of each distinct content of a bucket.

    What is in the table when it fills stays there and goes on absorbing its equals; only contents that are new then go
    to the spill files of the next level.
    """
    from pyarrow import fs as pafs

    table, writers, full = ContentTable(), {}, False
    pending: dict[int, list] = {}
    files, root = pafs.FileSystem.from_uri(scratch) if "://" in scratch or scratch.startswith("file:") else (pafs.LocalFileSystem(), scratch)
    mine = f"{root}/grace-{uuid.uuid4().hex}"

    def spill(k: int) -> None:
        if k not in writers:
            files.create_dir(mine, recursive=True)
            out = files.open_output_stream(f"{mine}/{k}")
            writers[k] = (out, pa.ipc.new_stream(out, RECORD))
        writers[k][1].write_batch(_batch(pending.pop(k), RECORD))

    try:
        held = 0
        for r in _records(batches):
            if not full or table.find(r[0], r[4]):
                table.add(*r)
                full = full or table.bytes > budget
                continue
            k = (r[0] >> (4 + 4 * (level % 14))) & (FAN_OUT - 1)
            pending.setdefault(k, []).append(r)
            held += len(r[4]) + ENTRY_BYTES
            if held > budget // 4:
                for k in list(pending):
                    spill(k)
                held = 0
        for k in list(pending):
            spill(k)
        for out, w in writers.values():
            w.close()
            out.close()
        for row in table.rows:
            yield [row[1], row[2], row[3]]
        table = ContentTable()
        for k in sorted(writers):
            with files.open_input_stream(f"{mine}/{k}") as f, pa.ipc.open_stream(f) as spilled:
                yield from grace(spilled, scratch, budget, level + 1)
            files.delete_file(f"{mine}/{k}")
    finally:
        if writers:
            files.delete_dir(mine)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = TABLE_BYTES) -> DataFrame:
    """One row a distinct text: sha (binary SHA-256), keep_id (largest id), group_size. Null counts as empty."""
    spark = docs.sparkSession
    prepare(spark)
    content = utf8(text_col)
    rows = docs.select(F.xxhash64(content).alias("h"), F.unhex(F.sha2(content, 256)).alias("sha"), F.col(id_col).cast("long").alias("max_id"), F.lit(1).cast("long").alias("n"), content.alias("content"))
    merged = rows.mapInArrow(lambda it: collapse(it, budget), RECORD_DDL)
    scratch = new_path(spark, "grace")

    def bucket(it):
        out = []
        for row in grace(it, scratch, budget):
            out.append(row)
            if len(out) >= 20_000:
                yield _batch(out, CLASS)
                out = []
        if out:
            yield _batch(out, CLASS)

    return merged.repartition("h").mapInArrow(bucket, CLASS_DDL)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = TABLE_BYTES) -> DataFrame:
    """Per row of docs: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null equals the empty text. Of equal texts the row with the largest id stays; a row
    whose id is null stays only if no row of its group has an id. Rows that repeat an id and its text count each in
    group_size and share one fate. An empty table gives no rows. Other columns of docs, whatever their names, play no part.
    """
    found = materialize(classes(docs, id_col, text_col, budget), "classes")
    total = found.agg(F.sum("group_size")).first()[0] or 0
    members = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(utf8(text_col), 256)).alias("sha"))
    out = join_classes(members, found, "sha", "group_size", total, F.col("doc_id"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text a row with a larger id has; all columns, whatever their names, stay.

    Of rows that repeat id and text one stays, the first by its columns' JSON.
    """
    kept = materialize(exact_groups(docs, id_col, text_col).where("kept").groupBy("doc_id", "text_sha256").count(), "kept")
    repeated = not kept.where("count > 1").isEmpty()
    kept = kept.select(F.col("doc_id").alias("keep"), F.unhex("text_sha256").alias("sha"))
    rows = docs.select(F.struct(*columns(docs)).alias("row"), F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(utf8(text_col), 256)).alias("sha_of"))
    out = rows.join(kept, F.col("id").eqNullSafe(F.col("keep")) & (F.col("sha_of") == F.col("sha")), "left_semi")
    if repeated:
        out = out.groupBy("id", "sha_of").agg(F.min_by("row", F.to_json("row")).alias("row"))  # combined before the shuffle
    return out.select("row.*")
