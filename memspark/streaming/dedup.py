"""Exact rolling deduplication of a stream with one stored time per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSeen(StatefulProcessor):
    """Keeps when the running hold of a key began; a timer drops it once the watermark is past its end."""

    def __init__(self, ttl_ms: int, ts_col: str, id_col: str):
        self.ttl_ms, self.ts_col, self.id_col = ttl_ms, ts_col, id_col

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first_seen", T.StructType([T.StructField("us", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One key's rows of one micro-batch, whose size the trigger bounds.
        pdf = pd.concat(list(rows), ignore_index=True).sort_values([self.ts_col, self.id_col], kind="stable")
        micros = pdf[self.ts_col].astype("datetime64[us]").astype("int64").to_numpy()
        state = self.first.get() if self.first.exists() else None
        anchor, before = (state[0], state[0]) if state is not None else (None, None)
        repeats = []
        for t in micros:
            repeat = anchor is not None and t < anchor + self.ttl_ms * 1000
            if not repeat:
                anchor = int(t)
            repeats.append(repeat)
        if anchor != before:
            if before is not None:
                self.handle.deleteTimer(before // 1000 + self.ttl_ms + 1)
            self.first.update((anchor,))
            end = anchor // 1000 + self.ttl_ms + 1
            if end > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(end)
        out = pdf[~pd.Series(repeats, index=pdf.index)]
        if len(out):
            yield out.astype({c: object for c in out.columns if pd.api.types.is_string_dtype(out[c])})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def dedup_stream(events: DataFrame, keys: list[str], ts: str, event_id: str, seconds: float = 300, late: str = "5 minutes") -> DataFrame:
    """Events of a stream without repeats. Needs the RocksDB state store (``STATE_PROVIDER``).

    Within a micro-batch events go by time, so the stream keeps what the table operator keeps as long as micro-batches
    come in time order. An event older than the running hold counts as its repeat.
    """
    marked = events.withWatermark(ts, late)
    return marked.groupBy(*keys).transformWithStateInPandas(
        FirstSeen(int(seconds * 1000), ts, event_id), outputStructType=marked.schema, outputMode="Append", timeMode="EventTime"
    )


def dedup_stream_approx(events: DataFrame, keys: list[str], ts: str, window: str = "5 minutes") -> DataFrame:
    """JVM-only variant: drops repeats at least until the watermark passes, the cheap approximation of the exact window."""
    return events.withWatermark(ts, window).dropDuplicatesWithinWatermark(keys)


def with_time_zone(events: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a TIMESTAMP, not a TIMESTAMP_NTZ."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))
