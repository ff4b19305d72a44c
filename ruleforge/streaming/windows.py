"""Freshness per time window on a running stream, windows without rows included (T2 with G9).

A windowed count has a row for each window that has rows. That a window has
none is known once the watermark has passed its end, and no row will ever say
so: an event-time timer does. Counts are made by Spark's own windowed
aggregation; a second stateful operator reads one row a finished window and
key, keeps the end of the last window it has told, and sets a timer for the
end of the next. Whichever comes first, a later window or the timer, gives the
windows between. The state is two numbers a key.

The watermark moves with the rows of the whole stream: while no key has any,
nothing is told. A source that can fall silent altogether needs a heartbeat
row now and then, which ``counted`` leaves out of the counts.
"""

from __future__ import annotations

from typing import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from ..functions.columns import name_col

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GAP_ROWS = 10_000  # empty windows handed on at a time


def _filler(width_ms: int):
    """The processor's class; defined here so that it travels with the task by value."""

    class EmptyWindows(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.told = handle.getValueState("told", StructType([StructField("until", LongType()), StructField("timer", LongType())]))

        def rows(self, key, starts, records) -> pd.DataFrame:
            return pd.DataFrame({"key": [key[0]] * len(starts), "window_start": pd.to_datetime(pd.Series(starts, dtype="int64"), unit="ms"),
                                 "records": pd.Series(records, dtype="int64")})

        def gap(self, key, start: int, end: int) -> Iterator[pd.DataFrame]:
            """Windows without rows from ``start`` to ``end``."""
            while start < end:
                stop = min(end, start + GAP_ROWS * width_ms)
                starts = range(start, stop, width_ms)
                yield self.rows(key, list(starts), [0] * len(starts))
                start = stop

        def wait(self, until: int, timer: int | None) -> None:
            """All is told up to ``until``; the next window is due one width later."""
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(until + width_ms)
            self.told.update((until, until + width_ms))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            found = pd.concat(rows).sort_values("start_ms")
            until, timer = self.told.get() if self.told.exists() else (None, None)
            for start, n in zip(found["start_ms"].tolist(), found["records"].tolist()):
                if until is not None:
                    yield from self.gap(key, until, start)
                yield self.rows(key, [start], [n])
                until = start + width_ms
            self.wait(until, timer)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            until, timer = self.told.get()
            due = expiredTimerInfo.getExpiryTimeInMs()
            if due != timer:
                return                                       # set before a later window came
            # every window that the watermark has passed by now
            passed = max(due, timerValues.getCurrentWatermarkInMs() // width_ms * width_ms)
            yield from self.gap(key, until, passed)
            self.wait(passed, None)

        def close(self) -> None:
            pass

    return EmptyWindows()


def windows_stream(stream: DataFrame, column: str, window_minutes: int, min_records_per_window: int, watermark: str,
                   key: str | None = None, counted: Column | None = None) -> DataFrame:
    """Every tumbling window of a running stream, once: ``key, window_start, window_end, records, fresh``.

    A window is given when the watermark has passed its end, empty ones too,
    from a key's first window on. ``key`` is a column whose values have windows
    of their own (one sequence of windows without it); ``counted`` tells the
    rows to count, the others only move the time. Needs the RocksDB state
    store, which is set here for the session.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ntz = dict(stream.dtypes)[column] == "timestamp_ntz"
    width_ms = int(window_minutes) * 60_000
    at = name_col(column).cast("timestamp")
    label = name_col(key).cast("string") if key else F.lit("")
    counts = (stream.select(at.alias("at"), F.coalesce(label, F.lit("")).alias("key"),
                            (F.lit(1) if counted is None else F.when(counted, 1)).alias("one"))
              .withWatermark("at", watermark)
              .groupBy(F.window("at", f"{int(window_minutes)} minutes").alias("w"), "key").agg(F.count("one").alias("records"))
              .select("key", F.unix_millis("w.start").alias("start_ms"), "records", F.window_time("w").alias("at")))
    schema = StructType([StructField("key", StringType()), StructField("window_start", TimestampType()), StructField("records", LongType())])
    filled = counts.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_filler(width_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    back = (lambda c: c.cast("timestamp_ntz")) if ntz else (lambda c: c)
    return filled.select("key", back(F.col("window_start")).alias("window_start"),
                         back(F.col("window_start") + F.expr(f"INTERVAL {int(window_minutes)} MINUTES")).alias("window_end"),
                         "records", (F.col("records") >= int(min_records_per_window)).alias("fresh"))
