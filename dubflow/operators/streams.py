"""Rows of one media item after the other, in order, through a Python state machine: linear time, a bounded state a task.

Partitions are sorted, not gathered: an item of any length is streamed batch by batch, and a step sees one row and the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BATCH = 10_000


def _typed(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def fold(df: DataFrame, order: list[str], columns: list[str], ddl: str, machine: Callable[[], Callable[[tuple | None], Iterator[tuple]]], key: str = "media_id") -> DataFrame:
    """Rows (key, *what the machine yields) as ddl says. A new machine for each item gets a tuple of `columns` a row, at
    the item's end None, and yields output rows. Rows equal in `order` come in the order of all columns."""
    rows = df.select(key, *dict.fromkeys(order + columns))
    rest = [c for c in rows.columns if c not in (key, *order)]
    rows = rows.repartition(key).sortWithinPartitions(key, *order, *[c for c in rest if rows.schema[c].dataType.typeName() != "map"]).select(key, *columns)
    schema = _typed(ddl)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        now, step, out = (), None, []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                if now != row[:1]:
                    if now:
                        out += [now + x for x in step(None)]
                    now, step = row[:1], machine()
                out += [now + x for x in step(row[1:])]
                if len(out) >= BATCH:
                    yield batch(out)
                    out = []
        if now:
            out += [now + x for x in step(None)]
        if out:
            yield batch(out)

    return rows.mapInArrow(run, ddl)
