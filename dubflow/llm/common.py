"""Shared helpers: Arrow batch bounds, tables in the shared folder, joins on keys that may be hot."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dubflow.sources.shared import new_path, shared_dir  # noqa: F401  the operators take both from here

#: Rows and bytes of one Arrow batch: a few very long texts can't fill a worker's memory.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Bounds the batches that go to Python, for as long as the session lasts: plans read the setting when they run.
    Smaller bounds of the session's own stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, most)


def columns(df: DataFrame) -> list[Column]:
    """All columns, by names that may have dots."""
    return [F.col(f"`{c}`") for c in df.columns]


def trim() -> None:
    """Returns a worker's free memory to the system: workers live on between tasks, and others' count beside them."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if release:
        release(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over batches, with the memory that earlier tasks left given back before and its own after."""

    def bounded(batches):
        gc.collect()
        trim()
        yield from run(batches)
        gc.collect()
        trim()

    return bounded


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the write's shuffle files go when it ends: what follows reads the table
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._shared_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote, once all that is made of them is written too."""
    for table in tables:
        spark = table.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._shared_path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def utf8(name: str) -> Column:
    """The column's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def join_classes(rows: DataFrame, classes: DataFrame, key: str | list[str], size: str, total: int, spread: Column) -> DataFrame:
    """rows left join classes on key (a column or several), where one key may hold a third of the rows.

    `size` of classes is a key's number of rows. Keys with over 1/2000 of all rows - 2000 of them at most, whatever the
    input - go by broadcast, and their rows are dealt by `spread` in the join of the others. A key with several rows in
    classes, all of one size, gives as many.
    """
    keys = [key] if isinstance(key, str) else key
    hot_at = max(200, total // 2000)
    values = [c for c in classes.columns if c not in keys]
    renamed = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)]
    hot = classes.where(F.col(size) >= hot_at).select(*[r.alias(f"__b{i}") for i, r in enumerate(map(F.col, keys))], *[F.col(c).alias(f"__h_{c}") for c in values])
    cold = classes.where(F.col(size) < hot_at).select(*renamed, *[F.col(c).alias(f"__c_{c}") for c in values])
    both = lambda side: [F.col(c) == F.col(f"__{side}{i}") for i, c in enumerate(keys)]
    out = rows.join(F.broadcast(hot), both("b"), "left")
    found = F.col(f"__h_{size}").isNotNull()
    kind = rows.schema[keys[0]].dataType
    dealt = spread.cast("string").cast("binary") if kind.typeName() == "binary" else spread.cast(kind)
    out = out.withColumn("__j", F.when(found, dealt).otherwise(F.col(keys[0])))
    out = out.join(cold, [F.col("__j") == F.col("__k0"), ~found, *both("k")[1:]], "left")
    return out.select(*rows.columns, *[F.when(found, F.col(f"__h_{c}")).otherwise(F.col(f"__c_{c}")).alias(c) for c in values])
