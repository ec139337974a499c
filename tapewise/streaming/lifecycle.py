"""Signal states in a stream: active, then resolved or expired.

A signal's state lives until its expiry in event time, when a timer clears it;
what is held is bounded by the horizon, not by the number of signals ever seen.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

EXPIRY_MINUTES = 240
SCHEMA = "signal_id long, status string, at timestamp"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class SignalStates(StatefulProcessor):
    """Rows of one signal: ``kind`` signal (its ``ts`` is the window's end) or
    outcome (of ``horizon`` minutes). Emits a row for each change of state."""

    def __init__(self, expiry_minutes: int = EXPIRY_MINUTES):
        self.expiry = expiry_minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # when it expires and when it was resolved (ms), and the state told last
        fields = [StructField("expires", LongType()), StructField("resolved", LongType()), StructField("status", StringType())]
        self.state = handle.getValueState("state", StructType(fields))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (signal,) = key
        expires, resolved, status = self.state.get() if self.state.exists() else (None, None, None)
        for row in rows:
            ms = int(row["us"]) // 1000
            if row["kind"] == "signal" and expires is None:  # a repeated row changes nothing
                expires = ms + self.expiry * 60_000
            elif row["kind"] == "outcome" and (row["horizon"] or 0) >= self.expiry:
                resolved = ms if resolved is None else min(resolved, ms)
        if expires is not None and status is None:
            status = "active"
            yield self._row(signal, status, expires - self.expiry * 60_000)
        if status == "active" and resolved is not None:
            status = "resolved"
            yield self._row(signal, status, resolved)
        due = expires if expires is not None else resolved  # an outcome before its signal waits no longer than its own time
        if due is not None:
            for held in list(self.handle.listTimers()):
                if held != due:
                    self.handle.deleteTimer(held)
            self.handle.registerTimer(due)
            self.state.update((expires, resolved, status))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (signal,) = key
        if self.state.exists():
            expires, _, status = self.state.get()
            self.state.clear()
            if status == "active":
                yield self._row(signal, "expired", expires)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(signal: int, status: str, ms: int) -> Row:
        return Row(signal_id=signal, status=status, at=dt.datetime.fromtimestamp(ms / 1000, tz=dt.UTC).replace(tzinfo=None))


def signal_states(rows: DataFrame, delay: str = "10 minutes", expiry_minutes: int = EXPIRY_MINUTES) -> DataFrame:
    """Changes of state (signal_id, status, at) of a stream of ``rows``
    (signal_id, kind, horizon, ts), in any order within ``delay``.

    A signal is active from its row on; an outcome of the last horizon resolves
    it; at its expiry in event time it is expired if nothing resolved it. Rows
    without an id or a time take no part; repeated rows change nothing; other
    kinds and shorter horizons leave the state alone. Needs the RocksDB state
    store (``STATE_STORE``)."""
    known = rows.where("signal_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    typed = known.select(F.col("signal_id").cast("long").alias("signal_id"), "kind", F.col("horizon").cast("int").alias("horizon"), F.unix_micros("ts").alias("us"), "ts")
    return typed.groupBy("signal_id").transformWithState(SignalStates(expiry_minutes), SCHEMA, "append", "eventTime")


def latest_status(changes: DataFrame) -> DataFrame:
    """(signal_id, status): the last state of each signal in a table of changes."""
    rank = F.when(F.col("status") == "active", 0).otherwise(1)
    return changes.groupBy("signal_id").agg(F.max_by("status", rank).alias("status"))
