"""Alerts and windows with event-time timers: what a stream holds back until its time has come.

State is kept by ``transformWithState`` in the RocksDB state store (``use_rocksdb``), so it may outgrow memory, and a query
that starts again from its checkpoint goes on as if it had not stopped.  A group's state goes with its last timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.shared import shipped

_ALERT = "group_id string, version long, at timestamp, delayed boolean"
_COUNT = "key string, begins timestamp, n long, usual double, complete boolean"


def use_rocksdb(spark: SparkSession) -> None:
    """Timers need this state store; to be called before a query starts."""
    shipped(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Cooldown(StatefulProcessor):
    """An update goes out at once if none went out within the cooldown, else the newest one does when it ends."""

    def __init__(self, cooldown_ms: int):
        self.cooldown = cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "version long, at long")
        self.held = handle.getValueState("held", "version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        updates = pd.concat(list(rows))[["version", "at"]].sort_values(["at", "version"])  # one group's updates of a batch
        out = []
        for version, at in updates.itertuples(index=False):
            ms = int(pd.Timestamp(at).value // 1_000_000)
            last = self.last.get()
            if last is not None and version <= last[0]:
                continue
            if last is not None and ms < last[1] + self.cooldown:
                held = self.held.get()
                if held is None or held[0] < version:
                    self.held.update((int(version),))
                continue
            if self.held.get() is not None:  # a later update stands for it
                self.held.clear()
            self._sent(int(version), ms)
            out.append((key[0], int(version), pd.Timestamp(ms, unit="ms"), False))
        yield pd.DataFrame(out, columns=["group_id", "version", "at", "delayed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms, held = expiredTimerInfo.getExpiryTimeInMs(), self.held.get()
        last = self.last.get()
        if last is not None and ms < last[1] + self.cooldown:  # another one went out since this timer was set
            return
        if held is None:
            self.last.clear()
            return
        self.held.clear()
        self._sent(held[0], ms)
        yield pd.DataFrame([(key[0], held[0], pd.Timestamp(ms, unit="ms"), True)], columns=["group_id", "version", "at", "delayed"])

    def _sent(self, version: int, ms: int) -> None:
        self.last.update((version, ms))
        self.handle.registerTimer(ms + self.cooldown)

    def close(self) -> None:
        pass


def cooled_down(updates: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """group_id, version, at, delayed: the notifications of a stream of alert updates (group_id, version, at): at most one
    a group in ``minutes``.  What comes in between waits, the newest version stands for the others, and goes out when the
    time is over, whether or not another update comes.  A version that went out, or an older one, doesn't go out again
    while the cooldown lasts.  Null groups are left out."""
    rows = updates.where("group_id is not null").select(F.col("group_id").cast("string").alias("group_id"), F.col("version").cast("long").alias("version"), F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    return rows.groupBy("group_id").transformWithStateInPandas(statefulProcessor=_Cooldown(minutes * 60_000), outputStructType=_ALERT, outputMode="Append", timeMode="EventTime")


class _Windows(StatefulProcessor):
    """Counts of a key by windows; a window is told when it is over, with the usual count of the same time of day."""

    def __init__(self, window_ms: int, days: int, least: float):
        self.window, self.days, self.least = window_ms, days, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "begins long", "n long")
        self.past = handle.getMapState("past", "begins long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            begins = pd.to_datetime(frame["at"]).astype("int64") // {"ns": 1_000_000, "us": 1000, "ms": 1}[pd.to_datetime(frame["at"]).dt.unit] // self.window * self.window
            for begin, n in begins.value_counts().items():
                begin = int(begin)
                if self.open.containsKey((begin,)):
                    n += self.open.getValue((begin,))[0]
                else:
                    self.handle.registerTimer(begin + self.window)
                self.open.updateValue((begin,), (int(n),))
        yield pd.DataFrame(columns=["key", "begins", "n", "usual", "complete"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        begin, day = expiredTimerInfo.getExpiryTimeInMs() - self.window, 86_400_000
        n = self.open.getValue((begin,))[0]
        self.open.removeKey((begin,))
        before = [self.past.getValue((b,))[0] for b in (begin - day * k for k in range(1, self.days + 1)) if self.past.containsKey((b,))]
        usual = float(pd.Series(before).median()) if before else None
        self.past.updateValue((begin,), (n,))
        for (old,) in [k for k in self.past.keys() if k[0] < begin - day * self.days]:
            self.past.removeKey((old,))
        yield pd.DataFrame([(key[0], pd.Timestamp(begin, unit="ms"), n, usual, usual is None or n >= self.least * usual)], columns=["key", "begins", "n", "usual", "complete"])

    def close(self) -> None:
        pass


def window_counts(events: DataFrame, hours: int = 3, days: int = 14, least: float = 0.5, late: str = "1 hour") -> DataFrame:
    """key, begins, n, usual, complete: the windows of ``hours`` of each key in a stream (key, at), once they are over.
    usual is the median of the same window on the ``days`` days before, as far as they are known; a window with less than
    ``least`` of it is not complete: collection has a gap, and what is missing there is no fall.  Windows without events
    are not told; events later than ``late`` are lost; null keys are left out."""
    rows = events.where("key is not null").select(F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=_Windows(hours * 3_600_000, days, least), outputStructType=_COUNT, outputMode="Append", timeMode="EventTime")
