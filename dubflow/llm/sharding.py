"""Reproducible shuffle and sharding by a Feistel permutation of global row numbers, with native expressions only.

A row's number comes from its id, size and checksum alone: rows are counted by these, dealt to buckets by a fixed function,
buckets have offsets, and inside a bucket the counted rows follow each other in order. No partition layout, task order or
retry plays a part. The permutation takes number to place; shard = place mod shards and slot = place div shards, so counts
differ by one at most and either can be computed from the other without a look at the data. The rounds are integer
arithmetic modulo a prime, which any SQL engine can repeat.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIME = 2147483647
#: Multipliers of the bucket and round functions.
FIRST, SECOND = 48271, 69621
ROUNDS = 6
BUCKET_ROWS = 20_000


def round_constant(seed: int, k: int) -> int:
    return (seed * 31 + 7919 * (k + 1)) % PRIME


def mixed(x: Column, seed: int, k: int) -> Column:
    """The round function: no product leaves 63 bits."""
    c = F.lit(round_constant(seed, k))
    u = (x % PRIME * FIRST + c) % PRIME
    return (u * u % PRIME * SECOND + c) % PRIME


def sides(n: int) -> tuple[int, int]:
    """The domain is a x b >= n, as square as it can be."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permute(x: Column, n: int, seed: int) -> Column:
    """One pass of the alternating Feistel network over [0, a*b)."""
    a, b = sides(n)
    left = F.pmod(x, F.lit(a)).cast("long")
    right = ((x - left) / a).cast("long")
    for k in range(ROUNDS):
        if k % 2 == 0:
            left = (left + mixed(right, seed, k)) % a
        else:
            right = (right + mixed(left, seed, k)) % b
    return left + right * a


def place(df: DataFrame, row: str, n: int, seed: int, out: str) -> DataFrame:
    """Adds the place of each row number: the network, then cycle walking until the place is below n.

    One pass misses with probability under 1/sqrt(n). Walking runs inside a higher-order function, for those rows only;
    a cycle leaves [n, a*b) after a*b - n steps at most, which bounds it.
    """
    a, b = sides(n)
    over = a * b - n
    df = df.withColumn(out, permute(F.col(row), n, seed))
    if over:
        for steps in (min(over, 16), over):
            walked = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col(out), lambda acc, _: F.when(acc < n, acc).otherwise(permute(acc, n, seed)))
            df = df.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(walked))
            if steps == over:
                break
    return df


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, size (UTF-8 bytes of the text + 1), text_crc32, law, shard, slot, grown_shard.

    The law is `rows`: the shards' counts differ by one at most, and slots are gapless from 0. Null text counts as empty.
    Rows with equal or null ids are told apart by size and checksum; rows equal in these are interchangeable and are one
    counted row until they get their numbers. An empty table gives no rows. Equal texts are dealt like any others, so no
    group of copies loads one shard or one task.
    """
    from dubflow.llm.common import materialize, utf8

    content = utf8(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content).alias("text_crc32"))
    rows = materialize(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")), "shard-rows")
    n = rows.agg(F.sum("copies")).first()[0] or 0
    out = lambda p: [F.lit("rows").alias("law"), (p % shards).cast("int").alias("shard"), F.floor(p / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")]
    if not n:
        return rows.select("doc_id", "size", "text_crc32", *out(F.col("copies")))
    buckets = max(1, n // BUCKET_ROWS)
    key = F.coalesce(F.col("doc_id"), F.lit(-1))
    spread = F.pmod(F.pmod(key, F.lit(PRIME)) * FIRST % PRIME + F.col("size") % PRIME, F.lit(PRIME)) * SECOND % PRIME + F.col("text_crc32")
    rows = rows.withColumn("__b", (spread % PRIME % buckets).cast("long"))
    counts = rows.groupBy("__b").agg(F.sum("copies").alias("__c"))
    # a row for every BUCKET_ROWS rows of input
    before = counts.withColumn("__off", F.sum("__c").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).select(F.col("__b").alias("__bb"), F.coalesce("__off", F.lit(0)).alias("__off"))
    inside = F.sum("copies").over(Window.partitionBy("__b").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = rows.withColumn("__i", inside).join(before, F.col("__b") == F.col("__bb")).withColumn("__first", (F.col("__off") + F.col("__i") - F.col("copies")).cast("long"))
    numbered = numbered.select("doc_id", "size", "text_crc32", F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("copies") - 1)).alias("__row"))
    return place(numbered, "__row", n, seed, "__p").select("doc_id", "size", "text_crc32", *out(F.col("__p")))
