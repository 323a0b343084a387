"""State kept by media item over an endless stream: voices given to speakers, detections held, translations with a time to live.

A state is a small JSON value; a step takes it, a row and yields rows. The same steps serve batches of any size, so a stream
cut anywhere gives what one batch gives.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[dict, dict], Iterator[tuple]]


def keyed(df: DataFrame, order: list[str], ddl: str, names: list[str], step: Step, key: str = "media_id", idle_ms: int | None = None) -> DataFrame:
    """Rows (key, *what step yields). Rows of one batch come in `order`; the state of an item that is idle for idle_ms goes."""
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout

    def run(keys, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame(columns=[key, *names])
            return
        held = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = [keys + x for row in rows.to_dict("records") for x in step(held, row)]
        state.update((json.dumps(held),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[key, *names])

    return df.groupBy(key).applyInPandasWithState(run, ddl, "held string", "append", timeout)


def assign_voices(voices: list[str]) -> Step:
    """(seq, speaker, voice): as folds.assign_voices, with the item's speakers as the state."""

    def step(held, row):
        known = held.setdefault("known", [])
        if row["speaker"] not in known and len(known) < len(voices):
            known.append(row["speaker"])
        at = known.index(row["speaker"]) if row["speaker"] in known else len(known)
        yield row["seq"], row["speaker"], voices[at % len(voices)]

    return step


def hold_detections(every: int) -> Step:
    """(frame, held): key frames replace what is held, failed ones keep it, empty ones clear it."""

    def step(held, row):
        if row["frame"] % every == 0 and row["status"] != "error":
            held["text"] = None if pd.isna(row["text"]) else row["text"]
        yield row["frame"], held.get("text")

    return step


def ttl_cache(ttl: float = 4 * 3600, most: int = 500) -> Step:
    """(seq, hit): as operators.cache.ttl_hits."""

    def step(held, row):
        live = held.setdefault("live", [])  # [key, end], the last used last
        own = next((x for x in live if x[0] == row["key"]), None)
        hit = own is not None and row["at"] < own[1]
        if hit:
            live.remove(own)
            live.append(own)
        elif row["ok"]:
            live[:] = [x for x in live if row["at"] < x[1] and x[0] != row["key"]]
            del live[: max(0, len(live) - most + 1)]
            live.append([row["key"], row["at"] + ttl])
        yield row["seq"], bool(hit)

    return step


class Progress(StreamingQueryListener):
    """Tells each batch's number, rows and seconds to a function, and how the query ended."""

    def __init__(self, tell: Callable[[str], None]) -> None:
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell(f"started {event.name or event.id}")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell(f"batch {p.batchId}: {p.numInputRows} rows in {p.batchDuration / 1000:.1f} s")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell(f"ended {event.exception or 'well'}")


def run_until(query, cancelled: Callable[[], bool], every: float = 0.5) -> bool:
    """Waits for the query's end; stops it between steps once cancelled() says so. Whether it ran to its end."""
    while not query.awaitTermination(every):
        if cancelled():
            query.stop()
            return False
    return True


def cancellable(spark: SparkSession, group: str, run: Callable[[], object]) -> object:
    """run() under a job group that spark.sparkContext.cancelJobGroup(group) ends."""
    spark.sparkContext.setJobGroup(group, group, interruptOnCancel=True)
    try:
        return run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
