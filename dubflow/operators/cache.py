"""The translation cache: a table keyed by source language, target language, stripped text and model; and a cache with a
time to live. Rows find their entry by a join on all four columns, so no separator inside a text can make two keys one."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dubflow.functions.text import strip
from dubflow.operators.streams import fold

KEY = ["src", "tgt", "key", "model"]


def export_key(src, tgt, key, model) -> Column:
    """The key as one string, for the flat JSON form; texts with | may collide there."""
    return F.concat_ws("|", src, tgt, key, model)


def keyed(segments: DataFrame) -> DataFrame:
    """segments (src, tgt, text, model, ...) with `key`, and src `auto` as en. Null texts count as empty."""
    return segments.withColumns({"src": F.when(F.col("src") == "auto", "en").otherwise(F.col("src")), "key": strip(F.coalesce("text", F.lit("")))})


def probe(segments: DataFrame, cache: DataFrame) -> DataFrame:
    """segments with key and `translated`: the cache's (KEY, translated) entry, or null. The cache has a key once."""
    known = cache.select(*[F.col(c).alias(f"__{c}") for c in KEY], "translated")
    rows = keyed(segments)
    return rows.join(known, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in KEY], "left").drop(*[f"__{c}" for c in KEY])


def misses(segments: DataFrame, cache: DataFrame) -> DataFrame:
    """The distinct keys that the cache lacks: a text that many segments share is translated once."""
    known = cache.select(*[F.col(c).alias(f"__{c}") for c in KEY])
    return keyed(segments).select(*KEY).distinct().join(known, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in KEY], "left_anti")


def store(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with the fresh entries, which replace those of their key; null translations are not stored."""
    new = fresh.where("translated is not null").select(*KEY, "translated")
    gone = new.select(*[F.col(c).alias(f"__{c}") for c in KEY])
    old = cache.select(*KEY, "translated").join(gone, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in KEY], "left_anti")
    return old.unionByName(new)


def translate(segments: DataFrame, cache: DataFrame, model: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(segments with key, translated, hit, ok; the cache afterwards).

    Hits keep their entry. model adds `translated` to the distinct missing keys, null where it fails; a failed segment keeps
    its text, ok is false, and nothing is stored for it. Rows keep all their columns, so order is theirs to restore.
    """
    fresh = model(misses(segments, cache)).select(*KEY, "translated")
    made = fresh.select(*[F.col(c).alias(f"__{c}") for c in KEY], F.col("translated").alias("made"))
    rows = probe(segments, cache).withColumn("hit", F.col("translated").isNotNull())
    rows = rows.join(made, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in KEY], "left").drop(*[f"__{c}" for c in KEY])
    ok = F.col("hit") | F.col("made").isNotNull()
    return rows.withColumn("ok", ok).withColumn("translated", F.coalesce("translated", "made", "text")).drop("made"), store(cache, fresh)


def ttl_hits(requests: DataFrame, ttl: float = 4 * 3600, most: int = 500) -> DataFrame:
    """Requests (media_id, seq, key, at, ok) in the order of `at` and seq, with `hit`: whether their item's cache had the key.

    An entry lives `ttl` from when it was stored, hits don't prolong it. A miss that the model answers (ok) is stored; with
    `most` live entries the one that was used longest ago goes first. Failures are not stored.
    """

    def machine():
        held: OrderedDict = OrderedDict()  # key to the end of its life, the last used last

        def step(row):
            if row is None:
                return
            seq, key, at, ok = row
            hit = key in held and at < held[key]
            if hit:
                held.move_to_end(key)
            elif ok:
                for k in [k for k, end in held.items() if at >= end]:
                    del held[k]
                while len(held) >= most:
                    held.popitem(last=False)
                held[key] = at + ttl
            yield seq, key, at, ok, hit

        return step

    kinds = [requests.schema[c].dataType.simpleString() for c in ("media_id", "seq", "key", "at")]
    return fold(requests, ["at", "seq"], ["seq", "key", "at", "ok"], "media_id {}, seq {}, key {}, at {}, ok boolean, hit boolean".format(*kinds), machine)
