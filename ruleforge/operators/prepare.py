"""Profile preparation (P1-P7): column subset, type filter, sample, trim, limit, value masks.

Order (D9): columns / types → sample → trim → limit. Length and value bounds
mask *values* (they become NULL for min/max/distinct), they do not drop rows;
null and empty counts use the unmasked values.
"""

from __future__ import annotations

import random
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import name_col
from .options import ProfileOptions
from .topk import top_k

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
SIMPLE = NUMERIC + (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def select_columns(df: DataFrame, columns: Sequence[str] | None = None,
                   profile_types: Sequence[str] | None = None) -> DataFrame:
    """P1 + P2: keep the named columns, then only the given Spark type names."""
    if columns:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"columns not in the table: {missing}")
        df = df.select(*[name_col(c) for c in columns])
    if profile_types:
        wanted = {t.lower() for t in profile_types}
        keep = [f.name for f in df.schema.fields
                if f.dataType.simpleString().lower() in wanted or f.dataType.typeName().lower() in wanted]
        df = df.select(*[name_col(c) for c in keep])
    return df


def sample_threshold(fraction: float) -> str:
    """Eight lower-case hex digits: rows whose hash prefix sorts below are kept."""
    return format(min(int(fraction * 2 ** 32), 2 ** 32 - 1), "08x")


def key_text(key: Sequence[str]) -> Column:
    parts = [name_col(k).cast("string") for k in key]
    return parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)


def hash_sample(df: DataFrame, fraction: float, seed: int | None, key: Sequence[str] = ()) -> DataFrame:
    """P3 (D7): repeatable, partition-independent sample.

    With a key: ``substr(md5(key || ':' || seed), 1, 8) < hex(fraction·2^32)``
    (DuckDB computes the same rows). Without a key every row is drawn by itself
    (``DataFrame.sample``), so equal rows stay or go independently and any
    column type will do. A fraction of 1 keeps everything, 0 nothing (D8).
    """
    if fraction is None or fraction >= 1:
        return df
    if fraction <= 0:
        return df.where(F.lit(False))
    if seed is None:
        seed = random.randrange(1, 2 ** 31)
    if key:
        h = F.substring(F.md5(F.concat(key_text(key), F.lit(f":{seed}"))), 1, 8)
        return df.where(h < F.lit(sample_threshold(fraction)))
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def trim_strings(df: DataFrame) -> DataFrame:
    """P5: trim both ends of every string column."""
    return df.select(*[F.trim(name_col(f.name)).alias(f.name) if is_string(f.dataType) else name_col(f.name)
                       for f in df.schema.fields])


def limit_rows(df: DataFrame, limit: int | None, key: Sequence[str] = (), seed: int | None = None) -> DataFrame:
    """At most ``limit`` rows (0 / None = no limit, D8).

    With a key the rows are the first ``limit`` in key order, exactly and the
    same on every run; ``top_k`` ranks in two levels, so no single task
    receives partitions × limit rows. Without a key they are the first rows
    read (the option's meaning): a plain limit, where each task stops after
    ``limit`` rows and the final task reads about ``limit`` rows, so a huge
    table is not read in full for a small profile. ``prepare`` checkpoints the
    result, so every job of one run sees the same rows.
    """
    if not limit:
        return df
    if key:
        return top_k(df, [(k, False) for k in key], int(limit))
    return df.limit(int(limit))


def prepare(df: DataFrame, options: ProfileOptions, columns: Sequence[str] | None = None) -> DataFrame:
    key = list(options.sample_key)
    keep = select_columns(df, columns, options.profile_types)
    if key:
        keep_cols = keep.columns
        df2 = df.select(*[name_col(c) for c in dict.fromkeys(keep_cols + [k for k in key if k not in keep_cols])])
    else:
        df2 = keep
    out = hash_sample(df2, options.sample_fraction, options.sample_seed, key)
    if options.trim_strings:
        out = trim_strings(out)
    if options.limit:
        # a few rows: written to the shared checkpoint folder, so every profile job reads them
        # (not the table again) and a lost executor cannot change which rows were chosen
        from ..session import ensure_checkpoint_dir
        ensure_checkpoint_dir(df.sparkSession)
        out = limit_rows(out, options.limit, key, options.sample_seed).select(*[name_col(c) for c in keep.columns])
        return out.checkpoint(eager=True)
    return out.select(*[name_col(c) for c in keep.columns])


def masked(col: Column, dt: T.DataType, options: ProfileOptions) -> Column:
    """P6/P7 (and D6): the value used for bounds/distinct, NULL when excluded."""
    cond = None
    if is_string(dt):
        n = F.char_length(col)
        if options.min_length is not None:
            cond = n >= options.min_length
        if options.max_length is not None:
            c2 = n <= options.max_length
            cond = c2 if cond is None else cond & c2
    elif is_numeric(dt):
        if options.min_value is not None:
            cond = col >= F.lit(options.min_value)
        if options.max_value is not None:
            c2 = col <= F.lit(options.max_value)
            cond = c2 if cond is None else cond & c2
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            c3 = ~F.isnan(col)
            cond = c3 if cond is None else cond & c3
    return col if cond is None else F.when(cond, col)
