"""Checks on Structured Streaming inputs.

* Row-level checks (and ``foreign_key`` against a static reference, a
  stream-static LEFT join) are plain projections of the stream:
  ``apply_checks_stream`` returns a streaming DataFrame.
* Windowed freshness uses event-time windows with a watermark, so state stays
  bounded by its delay. A running stream emits a window once the watermark
  passes its end (append mode); a bounded run gives all windows.
* Uniqueness and aggregate checks over the whole stream keep running values
  (``streaming/running.py``). ``apply_checks_per_batch`` judges each
  micro-batch as a table of its own, which has to be asked for.
"""

from __future__ import annotations

from typing import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.apply import apply_checks
from ..plans.rules import select_rules
from ..functions.row_checks import ROW_CHECKS

STREAM_SAFE_DATASET_CHECKS = {"foreign_key"}


def apply_checks_stream(stream: DataFrame, rules: Iterable[dict], refs: dict[str, DataFrame] | None = None,
                        run_config_name: str | None = None) -> DataFrame:
    """Rules that need no state, applied to every streamed row."""
    rules = list(rules)
    for r in select_rules(rules, run_config_name):
        fn = r["function"]
        if fn not in ROW_CHECKS and fn not in STREAM_SAFE_DATASET_CHECKS and fn != "pii_detection":
            raise ValueError(f"{fn} needs a whole dataset: use RunningChecks for streams")
    return apply_checks(stream, rules, refs, run_config_name)


def window_counts_stream(stream: DataFrame, column: str, window_minutes: int, min_records_per_window: int,
                         watermark: str) -> DataFrame:
    """Records per tumbling window.

    ``watermark`` is how late a row may come; later ones are not counted. In
    append mode a window is emitted once the watermark has passed its end;
    ``run_windows`` gives every window of a bounded run.
    """
    ntz = dict(stream.dtypes).get(column) == "timestamp_ntz"
    if ntz:  # event time must be a TIMESTAMP; zone-less values are read as UTC (session zone)
        stream = stream.withColumn(column, F.col(column).cast("timestamp"))
    back = (lambda c: c.cast("timestamp_ntz")) if ntz else (lambda c: c)
    return (stream.withWatermark(column, watermark)
            .groupBy(F.window(F.col(column), f"{int(window_minutes)} minutes").alias("w"))
            .agg(F.count(F.lit(1)).alias("records"))
            .select(back(F.col("w.start")).alias("window_start"), back(F.col("w.end")).alias("window_end"),
                    F.col("records").cast("bigint").alias("records"),
                    (F.col("records") >= int(min_records_per_window)).alias("fresh")))


def apply_checks_per_batch(rules: Iterable[dict], sink: Callable[[DataFrame, int], None],
                           refs: dict[str, DataFrame] | None = None, batches_are_tables: bool = False
                           ) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: all checks on each micro-batch.

    A dataset-level check then knows its batch only: a key that two batches
    share passes uniqueness. Such rules are refused unless
    ``batches_are_tables`` says that every batch is a whole table (one file,
    one day); ``RunningChecks`` judges the whole stream.
    """
    rules = list(rules)
    alone = [r["function"] for r in select_rules(rules)
             if r["function"] not in ROW_CHECKS and r["function"] not in STREAM_SAFE_DATASET_CHECKS and r["function"] != "pii_detection"]
    if alone and not batches_are_tables:
        raise ValueError(f"{', '.join(sorted(set(alone)))}: a batch alone doesn't decide this; use RunningChecks, or say batches_are_tables")

    def run(batch: DataFrame, epoch_id: int) -> None:
        sink(apply_checks(batch, rules, refs), epoch_id)
    return run


def file_stream(spark: SparkSession, folder: str, file_name: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A file source over the files of a folder with one name or pattern; all new files make a batch unless limited."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_name)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_windows(counts: DataFrame, out_dir: str) -> DataFrame:
    """Every window of the available input, the newest included: the last count that the run gave for each.

    Each batch's changed windows are a folder of their own, overwritten when the batch is run again.
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/data/epoch={epoch}")

    q = (counts.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", out_dir + "/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    changes = counts.sparkSession.read.parquet(out_dir + "/data")
    last = changes.groupBy("window_start", "window_end").agg(F.max_by(F.struct("records", "fresh"), "epoch").alias("last"))
    return last.select("window_start", "window_end", "last.records", "last.fresh")


def run_to_parquet(stream: DataFrame, out_dir: str, output_mode: str = "append") -> DataFrame:
    """Drain the available input once (``availableNow``) into parquet; return it as a batch frame."""
    q = (stream.writeStream.format("parquet").outputMode(output_mode)
         .option("checkpointLocation", out_dir + "/_checkpoint")
         .trigger(availableNow=True).start(out_dir + "/data"))
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return stream.sparkSession.read.parquet(out_dir + "/data")
