"""Distinct counts that add up over runs (A4): stored HyperLogLog sketches.

A profile of a table knows the distinct values of the rows it read. Tables
that grow by parts are profiled part by part, and counts of parts can't be
added: a value in two parts would count twice. So each run stores one sketch a
column (a few KB, whatever the number of rows), and sketches of any runs merge
into the sketch of all their rows. No row is read again.

One aggregation makes the sketches of all columns, with partial aggregation
before the shuffle; merging reads the stored rows only.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import name_col
from .options import ProfileOptions
from .prepare import SIMPLE, masked, prepare

PRECISION = 14  # log2 of a sketch's slots
SCHEMA = "run string, table_name string, column_name string, rows bigint, nulls bigint, sketch binary"


def relative_error(precision: int = PRECISION) -> float:
    """Standard error of an estimate, as a share of the count."""
    return 1.04 / math.sqrt(2 ** precision)


def column_sketches(df: DataFrame, table_name: str, run: str, options: ProfileOptions | None = None,
                    columns: Sequence[str] | None = None, precision: int = PRECISION) -> DataFrame:
    """One row a column: rows, rows without a value, and a sketch of the values.

    Values are prepared as for a profile (trimmed, masked); the texts of values
    are sketched, so that runs merge where a column's type was widened between
    them.
    """
    prep = prepare(df, options or ProfileOptions(), columns)
    fields = [f for f in prep.schema.fields if isinstance(f.dataType, SIMPLE)]
    values = {f.name: masked(name_col(f.name), f.dataType, options or ProfileOptions()).cast("string") for f in fields}
    stats = prep.agg(F.count(F.lit(1)).alias("n"), *[
        e for i, f in enumerate(fields) for e in (F.count(values[f.name]).alias(f"c{i}"),
                                                  F.hll_sketch_agg(values[f.name], precision).alias(f"s{i}"))])
    rows = [F.struct(F.lit(run).alias("run"), F.lit(table_name).alias("table_name"), F.lit(f.name).alias("column_name"), F.col("n").alias("rows"),
                     (F.col("n") - F.col(f"c{i}")).alias("nulls"), F.col(f"s{i}").alias("sketch")) for i, f in enumerate(fields)]
    if not rows:
        return df.sparkSession.createDataFrame([], SCHEMA)
    return stats.select(F.inline(F.array(*rows)))


def store_sketches(sketches: DataFrame, path: str) -> None:
    """Add a run's sketches to a store; a run written again takes its old rows' place."""
    (sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table_name", "run").parquet(path))


def stored_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def merged_distinct(sketches: DataFrame) -> DataFrame:
    """Per table and column over all given runs: ``runs, rows, nulls, distinct_estimate`` and its standard error."""
    merged = sketches.groupBy("table_name", "column_name").agg(
        F.count_distinct("run").alias("runs"), F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"),
        F.hll_union_agg("sketch", True).alias("sketch"))
    estimate: Column = F.hll_sketch_estimate("sketch")
    # a sketch merged of different precisions has the least of them; the error stated is that of this module's own
    return merged.select("table_name", "column_name", "runs", "rows", "nulls", estimate.alias("distinct_estimate"),
                         F.lit(relative_error()).alias("relative_error"))
