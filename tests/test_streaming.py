"""Streaming forms equal the batch forms on the same rows."""

import pytest

from ruleforge.plans.apply import apply_checks, summarize
from ruleforge.plans.suite import REGISTRY
from ruleforge.plans.suite import fixtures as fx
from ruleforge.session import scratch_dir
from ruleforge.streaming.checks import apply_checks_per_batch, apply_checks_stream, file_stream, run_to_parquet

from conftest import SF_SMALL


def test_row_checks_stream_equals_batch(spark):
    from ruleforge.plans.suite.streams import STREAM_RULES
    stream_rows = sorted(REGISTRY["stream_row_checks"].fn(spark, SF_SMALL).collect())
    batch = summarize(apply_checks(fx.events_dirty(spark, SF_SMALL), STREAM_RULES), ["event_id"])
    assert stream_rows == sorted(batch.collect())


def test_stateful_checks_are_refused_on_streams(spark):
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    stream = file_stream(spark, SF_SMALL, "events.parquet", schema)
    rule = {"criticality": "error", "check": {"function": "is_unique", "arguments": {"columns": ["event_id"]}}}
    with pytest.raises(ValueError):
        apply_checks_stream(stream, [rule])
    with pytest.raises(ValueError):  # a batch alone doesn't decide it
        apply_checks_per_batch([rule], lambda df, epoch: None)


def test_dataset_checks_per_batch(spark):
    schema = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").schema
    stream = file_stream(spark, SF_SMALL, "lineitem.parquet", schema)
    out = scratch_dir(spark, "t-foreach")
    rule = {"name": "u", "criticality": "error",
            "check": {"function": "is_unique", "arguments": {"columns": ["l_orderkey", "l_linenumber"]}}}

    def sink(df, epoch):
        summarize(df, ["l_orderkey", "l_linenumber"]).write.mode("append").parquet(out + "/data")

    q = (stream.writeStream.foreachBatch(apply_checks_per_batch([rule], sink, batches_are_tables=True))
         .option("checkpointLocation", out + "/_ck").trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(out + "/data")
    batch = summarize(apply_checks(spark.read.parquet(f"{SF_SMALL}/lineitem.parquet"), [rule]),
                      ["l_orderkey", "l_linenumber"])
    assert sorted(got.collect()) == sorted(batch.collect())


def test_bounded_run_gives_every_window_over_several_batches(spark, tmp_path):
    import datetime as dt

    from ruleforge.streaming.checks import file_stream, run_windows, window_counts_stream
    day = dt.datetime(2024, 1, 1)
    for k in range(3):  # each file holds rows of the windows before, too
        rows = [(day + dt.timedelta(minutes=30 * m),) for m in range(2 * k + 2)]
        spark.createDataFrame(rows, "ts timestamp_ntz").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = file_stream(spark, str(tmp_path / "in"), "*.parquet", "ts timestamp_ntz", files_per_batch=1)
    got = run_windows(window_counts_stream(stream, "ts", 60, 3, watermark="1 day"), str(tmp_path / "out"))
    assert sorted((r["window_start"].hour, r["records"], r["fresh"]) for r in got.collect()) == [
        (0, 6, True), (1, 4, True), (2, 2, False)]
