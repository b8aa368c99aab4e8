"""Keyed state on streams: sliding time to live, cooldown, deduplication, rolling windows and incremental embedding.

The batch operators of :mod:`lodestack.operators.windows` are the reference: over the same rows in
the same order the streams give the same rows.  Time is event time; state ends by watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def sticky(events: DataFrame, key: str, ts: str, id_column: str, ttl_seconds: int, late: str = "0 seconds") -> DataFrame:
    """(key, id, session, fresh): whether each event found its key's state expired and so opened a new session.

    Every event renews the state; the state of a key holds its last instant and session number only
    and is dropped once the watermark is past its expiry.
    """
    width = ttl_seconds * 1_000_000

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, session = state.get if state.exists else (None, -1)
        rows = pd.concat(list(batches)).sort_values(["_at", "_id"])
        out = []
        for at, ident in zip(rows["_at"], rows["_id"], strict=True):
            fresh = last is None or at - last > width
            session += fresh
            last = max(at, last) if last is not None else at
            out.append((k[0], ident, session, bool(fresh)))
        state.update((int(last), int(session)))
        state.setTimeoutTimestamp(max(int(last) // 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "id", "session", "fresh"])

    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, id_column)}
    source = events.withWatermark(ts, late).select(F.col(key).alias("_key"), F.col(id_column).alias("_id"), F.unix_micros(ts).alias("_at"), F.col(ts))
    return source.groupBy("_key").applyInPandasWithState(
        step, f"key {kinds[key]}, id {kinds[id_column]}, session long, fresh boolean", "last long, session long", "append", GroupStateTimeout.EventTimeTimeout
    )


def once(events: DataFrame, ts: str, keys: list[str], within: str) -> DataFrame:
    """The first event of each key within a period; later repeats are dropped, their state by watermark."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def rolling(events: DataFrame, ts: str, keys: list[str], size: str, slide: str, late: str) -> DataFrame:
    """Counts and sums of value over sliding windows; rows later than ``late`` are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size, slide), *keys).agg(F.count("*").alias("events"), F.sum("value").alias("total"))


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("events"))


def incremental(stream: DataFrame, stored: Callable[[], DataFrame], key: str, build: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame], None], checkpoint: str):
    """A query that handles only rows whose key is not stored yet, batch by batch (cache misses of an embedding store).

    A batch that is run again after a failure finds its rows stored and adds nothing.
    """

    def handle(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key]).join(stored().select(key), key, "left_anti")
        sink(build(fresh))

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
