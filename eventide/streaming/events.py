"""Streams of canonical events: counts by time bucket, and the first terminal event of each entity."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.events import is_terminal

#: The state store that keyed state with timers needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def bucket_counts(events: DataFrame, bucket: str = "1 day", late: str = "1 day") -> DataFrame:
    """(bucket_start, event, n): events of each tumbling bucket; what comes later than ``late`` after it is left out."""
    own = events.withColumn("date", F.col("date").cast("timestamp")).withWatermark("date", late)
    found = own.groupBy(F.window("date", bucket), "event").agg(F.count("*").alias("n"))
    return found.select(F.col("window.start").alias("bucket_start"), "event", "n")


class FirstEvent(StatefulProcessor):
    """Of each key, the earliest time seen; given once the watermark has passed it, when no earlier one can come any more.

    State of a key: its earliest time in milliseconds, and whether it was given. It goes ``keep_ms`` after that time.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "ms long, given boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        least = min(r["ms"] for r in rows)
        known = self.first.get() if self.first.exists() else None
        if known is None or (not known[1] and least < known[0]):
            if known is not None:
                self.handle.deleteTimer(known[0])
            self.first.update((least, False))
            self.handle.registerTimer(least)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        ms, given = self.first.get()
        if given:
            self.first.clear()
            return
        self.first.update((ms, True))
        self.handle.registerTimer(ms + self.keep_ms)
        yield Row(patient_id=key[0], ms=ms)


def first_terminal(events: DataFrame, pattern: str, late: str = "1 day", keep_days: int = 3650) -> DataFrame:
    """(patient_id, terminal_date) of a stream of events: each entity's first terminal event, once and for all, to the millisecond.

    It is given when the watermark (``late`` behind the latest event) has passed it; events that come later than that are
    left out. An entity's state goes ``keep_days`` of event time after its terminal event: one that comes later still
    counts as a first one again. The session needs ``STATE_STORE``.
    """
    own = events.where(is_terminal(pattern)).select("patient_id", F.col("date").cast("timestamp").alias("date")).withWatermark("date", late)
    timed = own.select("patient_id", "date", F.unix_millis("date").alias("ms"))
    found = timed.groupBy("patient_id").transformWithState(FirstEvent(keep_days * 86_400_000), "patient_id string, ms long", "append", "eventTime")
    return found.select("patient_id", F.timestamp_millis("ms").cast("timestamp_ntz").alias("terminal_date"))
