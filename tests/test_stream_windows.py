"""Windows without rows on a running stream."""

import datetime as dt

from pyspark.sql import functions as F

from ruleforge.streaming.checks import file_stream, run_to_parquet
from ruleforge.streaming.windows import windows_stream

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "ts timestamp_ntz, k string, real boolean"


def add(spark, folder, *rows):
    spark.createDataFrame([(DAY + dt.timedelta(minutes=m), k, real) for m, k, real in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def drained(spark, tmp_path, **kw):
    stream = file_stream(spark, str(tmp_path / "in"), "*.parquet", SCHEMA, files_per_batch=1)
    got = run_to_parquet(windows_stream(stream, "ts", 60, 2, watermark="10 minutes", **kw), str(tmp_path / "out"))
    return sorted((r["key"], (r["window_start"] - DAY) / dt.timedelta(hours=1), r["records"], r["fresh"]) for r in got.collect())


def test_gaps_are_told_by_rows_and_by_timers(spark, tmp_path):
    folder = str(tmp_path / "in")
    add(spark, folder, (5, "a", True), (50, "a", True), (10, "b", True))
    add(spark, folder, (4 * 60 + 1, "a", True))                       # a's hours 1-3 are empty; b is silent from hour 1 on
    add(spark, folder, (6 * 60 + 30, "a", True), (6 * 60 + 31, "a", True))
    first = drained(spark, tmp_path, key="k")
    # the watermark stands at 6:20: all up to hour 5 is told, of the silent key too
    assert first == [("a", 0, 2, True), ("a", 1, 0, False), ("a", 2, 0, False), ("a", 3, 0, False), ("a", 4, 1, False), ("a", 5, 0, False),
                     ("b", 0, 1, False), *[("b", h, 0, False) for h in range(1, 6)]]
    add(spark, folder, (9 * 60 + 30, "b", True), (9 * 60 + 59, "x", False))   # goes on from kept state
    second = drained(spark, tmp_path, key="k")
    assert [x for x in second if x not in first] == [("a", 6, 2, True), ("a", 7, 0, False), ("a", 8, 0, False), ("b", 6, 0, False), ("b", 7, 0, False), ("b", 8, 0, False)]
    assert len(second) == len(set(second))


def test_heartbeats_move_the_time_and_do_not_count(spark, tmp_path):
    folder = str(tmp_path / "in")
    add(spark, folder, (5, None, True), (6, None, True))
    add(spark, folder, (3 * 60 + 30, None, False))
    assert drained(spark, tmp_path, counted=F.col("real")) == [("", 0, 2, True), ("", 1, 0, False), ("", 2, 0, False)]
