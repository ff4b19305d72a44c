"""Column profiles (A1-A9, with the P8 outlier band) in a fixed number of jobs.

Job 1: one wide aggregate over the prepared frame: row count, null and empty
counts, masked min / max / mean / stddev, ``approx_count_distinct`` for
every column. Its single result row (one value per column, bounded by the
schema width, not by the data) is read on the driver to plan job 2.

Job 2: conditional min / max inside mean ± k·sd for the outlier columns
(another single-row aggregate), and exact distinct values only for columns
whose estimate is at most ``2·max_in_count + 10`` (so a value list can never
grow with the data): an unpivot to ``(column, value)`` and one
``groupBy(column, value).count()`` with map-side partial aggregation.

No ``countDistinct`` per column (several of them in one aggregate make Spark
expand every row once per column), no ``OVER ()`` window, no collect of rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import name_col
from .options import ProfileOptions
from .prepare import SIMPLE, is_numeric, is_string, masked, prepare

PROFILE_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("empty_count", T.LongType()),
    T.StructField("approx_distinct", T.LongType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("stddev", T.DoubleType()),
    T.StructField("min_kept", T.DoubleType()),
    T.StructField("max_kept", T.DoubleType()),
    T.StructField("outliers_removed", T.BooleanType()),
    # the kept bounds of whole-number and decimal columns in their own type, as text: doubles round them
    T.StructField("min_text", T.StringType()),
    T.StructField("max_text", T.StringType()),
])


STATS_CHUNK = 128  # columns per statistics aggregate


def _exact(dt: T.DataType) -> bool:
    """Numbers with an exact text of their own: whole numbers and decimals."""
    return is_numeric(dt) and not isinstance(dt, (T.FloatType, T.DoubleType))


def _screen_limit(options: ProfileOptions) -> int:
    return 2 * int(options.max_in_count) + 10


def column_stats(prep: DataFrame, options: ProfileOptions, table_name: str | None = None) -> DataFrame:
    """Jobs 1 and 2a: one row of statistics per column (no value lists)."""
    spark: SparkSession = prep.sparkSession
    fields = prep.schema.fields
    row: dict = {}
    # very wide tables: one aggregate per chunk of columns keeps each aggregate small enough for
    # code generation; parquet reads only the chunk's columns, so the chunks add no IO
    for lo in range(0, max(len(fields), 1), STATS_CHUNK):
        exprs = [F.count(F.lit(1)).alias("n")]
        for i, f in enumerate(fields[lo:lo + STATS_CHUNK], start=lo):
            c = name_col(f.name)
            m = masked(c, f.dataType, options)
            exprs.append(F.count_if(c.isNull()).alias(f"nul{i}"))
            if is_string(f.dataType):
                exprs.append(F.count_if(c == F.lit("")).alias(f"emp{i}"))
            if isinstance(f.dataType, SIMPLE):
                exprs.append(F.approx_count_distinct(m).alias(f"acd{i}"))
            if is_numeric(f.dataType):
                md = m.cast("double")
                # "+ 0.0" turns a -0.0 bound into 0.0 (both compare equal; report one spelling)
                exprs += [(F.min(md) + F.lit(0.0)).alias(f"min{i}"), (F.max(md) + F.lit(0.0)).alias(f"max{i}"),
                          F.avg(md).alias(f"avg{i}"), F.stddev_samp(md).alias(f"sd{i}")]
                if _exact(f.dataType):
                    exprs += [F.min(m).cast("string").alias(f"tmin{i}"), F.max(m).cast("string").alias(f"tmax{i}")]
        row.update(prep.agg(*exprs).collect()[0].asDict())  # one row: bounded by the chunk width

    outlier_set = set(options.outlier_columns or [])
    band = {}
    if options.remove_outliers:
        cond_exprs = []
        for i, f in enumerate(fields):
            if not is_numeric(f.dataType) or (outlier_set and f.name not in outlier_set):
                continue
            mean, sd = row.get(f"avg{i}"), row.get(f"sd{i}")
            if mean is None or not sd:  # D5: null / zero deviation → nothing removed
                continue
            lo, hi = mean - options.num_sigmas * sd, mean + options.num_sigmas * sd
            band[i] = (lo, hi)
            if row[f"min{i}"] >= lo and row[f"max{i}"] <= hi:
                # nothing lies outside the band: the kept bounds are the raw ones, no second pass
                row[f"kmin{i}"], row[f"kmax{i}"] = row[f"min{i}"], row[f"max{i}"]
                row[f"ktmin{i}"], row[f"ktmax{i}"] = row.get(f"tmin{i}"), row.get(f"tmax{i}")
                continue
            m = masked(name_col(f.name), f.dataType, options)
            md = m.cast("double")
            inside = (md >= F.lit(lo)) & (md <= F.lit(hi))
            kept = F.when(inside, md)
            cond_exprs += [(F.min(kept) + F.lit(0.0)).alias(f"kmin{i}"), (F.max(kept) + F.lit(0.0)).alias(f"kmax{i}")]
            if _exact(f.dataType):
                own = F.when(inside, m)
                cond_exprs += [F.min(own).cast("string").alias(f"ktmin{i}"), F.max(own).cast("string").alias(f"ktmax{i}")]
        if cond_exprs:
            row.update(prep.agg(*cond_exprs).collect()[0].asDict())

    rows = []
    for i, f in enumerate(fields):
        num = is_numeric(f.dataType)
        removed = i in band
        rows.append((table_name, f.name, f.dataType.simpleString(), row["n"], row[f"nul{i}"],
                     row.get(f"emp{i}") if is_string(f.dataType) else None,
                     row.get(f"acd{i}"),
                     row.get(f"min{i}") if num else None, row.get(f"max{i}") if num else None,
                     row.get(f"avg{i}") if num else None, row.get(f"sd{i}") if num else None,
                     (row.get(f"kmin{i}") if removed else row.get(f"min{i}")) if num else None,
                     (row.get(f"kmax{i}") if removed else row.get(f"max{i}")) if num else None,
                     removed,
                     row.get(f"ktmin{i}" if removed else f"tmin{i}"), row.get(f"ktmax{i}" if removed else f"tmax{i}")))
    # the statistics of a handful of columns, not data rows
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


def value_counts(prep: DataFrame, columns: Sequence[str], options: ProfileOptions) -> DataFrame:
    """(column_name, value, count) over masked, non-null values of the given columns."""
    types = {f.name: f.dataType for f in prep.schema.fields}
    if not columns:
        return prep.sparkSession.createDataFrame([], "column_name string, value string, count bigint")
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"),
                               masked(name_col(c), types[c], options).cast("string").alias("value"))
                      for c in columns])
    return (prep.select(F.inline(pairs))
            .where(F.col("value").isNotNull())
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count")))


def profile(df: DataFrame, options: ProfileOptions | None = None, columns: Sequence[str] | None = None,
            table_name: str | None = None) -> DataFrame:
    """One row per profiled column.

    Adds to ``column_stats``: ``distinct_count`` (exact, for screened columns
    or with ``exact_distinct``; else NULL, and ``approx_distinct`` has the
    estimate), ``distinct_exact``, ``values`` (sorted distinct values as text,
    screened columns only) and ``values_note``, which tells why a column has
    no list (NULL where it has one).
    """
    options = options or ProfileOptions()
    prep = prepare(df, options, columns)
    stats = column_stats(prep, options, table_name)
    limit = _screen_limit(options)
    est = {r["column_name"]: r["approx_distinct"] for r in stats.select("column_name", "approx_distinct").collect()}
    listed = [c for c, n in est.items() if n is not None and n <= limit]  # small by the estimate
    screened = [c for c, n in est.items() if n is not None and (options.exact_distinct or n <= limit)]
    counts = value_counts(prep, screened, options)
    # one aggregate: exact distinct count for every screened column, value list only for the columns
    # small by the estimate (their lists are bounded), kept only when the exact count is within the bound
    in_list = F.col("column_name").isin(listed) if listed else F.lit(False)
    per_col = counts.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("exact_distinct"),
        F.array_sort(F.collect_list(F.when(in_list, F.col("value")))).alias("all_values"))
    per_col = per_col.select("column_name", "exact_distinct",
                             F.when(F.col("exact_distinct") <= F.lit(limit), F.col("all_values")).alias("values"))
    out = stats.join(per_col, "column_name", "left")
    cols = [*[c for c in PROFILE_SCHEMA.fieldNames()],
            F.coalesce(F.col("exact_distinct"),
                       F.when(F.col("column_name").isin(screened) if screened else F.lit(False), F.lit(0))
                       ).cast("bigint").alias("distinct_count"),
            (F.col("column_name").isin(screened) if screened else F.lit(False)).alias("distinct_exact"),
            # a listed column without any non-NULL value has an empty list
            F.when(F.col("values").isNull() & (F.col("column_name").isin(listed) if listed else F.lit(False)),
                   F.array().cast("array<string>")).otherwise(F.col("values")).alias("values")]
    cols.append(F.when(F.col("approx_distinct").isNull(), F.lit("values of this type are not listed"))
                .when(~in_list | (F.col("exact_distinct") > limit), F.lit(f"more than {limit} different values")).alias("values_note"))
    if options.include_histograms:
        out = out.join(histograms(prep, stats, counts, listed, options), "column_name", "left")
        cols.append(F.col("histogram"))
    return out.select(*cols)


def histograms(prep: DataFrame, stats: DataFrame, counts: DataFrame, listed: Sequence[str],
               options: ProfileOptions) -> DataFrame:
    """A9 inside the profile: ``histogram map<string,bigint>`` per column.

    Columns with a value list (few values) get their value frequencies, taken
    from the value counts already computed. Other numeric columns get
    ``histogram_bins`` equal-width buckets over their [min, max] (bucket start
    as the key), from one unpivot + ``groupBy`` over all of them.
    """
    spark = prep.sparkSession
    categorical = (counts.where(F.col("column_name").isin(list(listed)) if listed else F.lit(False))
                   .groupBy("column_name")
                   .agg(F.map_from_entries(F.collect_list(F.struct("value", "count"))).alias("histogram")))
    bounds = {r["column_name"]: (r["min"], r["max"]) for r in
              stats.where(F.col("min").isNotNull()).select("column_name", "min", "max").collect()}
    numeric = [c for c in bounds if c not in set(listed)]
    if not numeric:
        return categorical
    types = {f.name: f.dataType for f in prep.schema.fields}
    bins = int(options.histogram_bins)
    cells = []
    for c in numeric:
        lo, hi = bounds[c]
        width = (hi - lo) / bins if hi > lo else 1.0
        v = masked(name_col(c), types[c], options).cast("double")
        b = F.least(F.greatest(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(0)), F.lit(bins - 1))
        cells.append(F.struct(F.lit(c).alias("column_name"),
                              F.when(v.isNotNull(), F.lit(lo) + b * F.lit(width)).alias("bucket_start")))
    per_bucket = (prep.select(F.inline(F.array(*cells))).where(F.col("bucket_start").isNotNull())
                  .groupBy("column_name", "bucket_start").agg(F.count(F.lit(1)).alias("count")))
    numeric_h = per_bucket.groupBy("column_name").agg(F.map_from_entries(F.collect_list(
        F.struct(F.col("bucket_start").cast("string"), F.col("count")))).alias("histogram"))
    return categorical.unionByName(numeric_h)


def histogram_categorical(df: DataFrame, columns: Sequence[str], options: ProfileOptions | None = None,
                          prepared: bool = False) -> DataFrame:
    """A9, categorical: value frequencies per column."""
    options = options or ProfileOptions()
    prep = df if prepared else prepare(df, options)
    return value_counts(prep, columns, options)


def histogram_numeric(df: DataFrame, column: str, bins: int, lo, hi,
                      options: ProfileOptions | None = None) -> DataFrame:
    """A9, numeric: counts per equal-width bucket over [lo, hi] (bucket 1..bins, clamped).

    ``lo``/``hi`` are numbers or Columns (e.g. scalar subqueries of min / max,
    so the bounds are computed by Spark, not read back to the driver).
    """
    options = options or ProfileOptions()
    f = df.schema[column]
    v = masked(F.col(column), f.dataType, options).cast("double")
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    width = F.when(hi_c > lo_c, (hi_c - lo_c) / F.lit(bins)).otherwise(F.lit(1.0))
    bucket = F.least(F.greatest(F.floor((v - lo_c) / width) + 1, F.lit(1)), F.lit(bins)).cast("int")
    return (df.where(v.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
            .select(F.lit(column).alias("column_name"), "bucket",
                    (lo_c + (F.col("bucket") - 1) * width).alias("lower"),
                    (lo_c + F.col("bucket") * width).alias("upper"), "count"))
