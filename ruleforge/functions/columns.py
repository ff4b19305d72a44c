"""Turning rule arguments into Spark Columns.

Rule arguments arrive as Python values (from code, YAML or a rules table).
A string names a column or is a SQL expression; numbers, dates and
timestamps are literals; a Column is used as is.
"""

from __future__ import annotations

import datetime as _dt
import re
from typing import Any, Iterable
from zoneinfo import ZoneInfo

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def to_col(value: Any) -> Column:
    """Column for a 'column name or SQL expression' argument."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.expr(value)
    raise TypeError(f"expected a column name, SQL expression or Column, got {type(value).__name__}")


def to_value(value: Any) -> Column:
    """Column for a 'limit as number, date, timestamp, column name or SQL expression' argument."""
    if isinstance(value, Column):
        return value
    if isinstance(value, bool):
        return F.lit(value)
    if isinstance(value, (int, float)):
        return F.lit(value)
    if isinstance(value, _dt.datetime):
        return timestamp_lit(value)
    if isinstance(value, _dt.date):
        return F.lit(value.isoformat()).cast("date")
    if isinstance(value, str):
        text = value.strip()
        if _looks_like_timestamp(text):
            # no identifier looks like a date: '2024-01-31' is a date, not 2024 - 1 - 31
            return F.lit(text).cast("date") if len(text) == 10 else timestamp_lit(text.replace("T", " "))
        return F.expr(value)
    if value is None:
        return F.lit(None)
    raise TypeError(f"unsupported limit value {value!r}")


def timestamp_lit(value: Any) -> Column:
    """A zone-less timestamp literal (test data is ``timestamp_ntz``)."""
    if isinstance(value, Column):
        return value
    if isinstance(value, _dt.datetime):
        if value.tzinfo is not None:  # the same moment on the session's clock
            zone = SparkSession.active().conf.get("spark.sql.session.timeZone")
            value = value.astimezone(ZoneInfo(zone)).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    return F.lit(str(value)).cast("timestamp_ntz")


def current_ts(value: Any = None) -> Column:
    """Current timestamp argument: explicit value, Column, or ``current_timestamp()``."""
    if value is None:
        return F.current_timestamp().cast("timestamp_ntz")
    if isinstance(value, str) and not _looks_like_timestamp(value):
        return F.expr(value)
    return timestamp_lit(value)


def current_date(value: Any = None) -> Column:
    if value is None:
        return F.current_date()
    if isinstance(value, Column):
        return value
    if isinstance(value, (_dt.date, _dt.datetime)):
        return F.lit(value.isoformat()[:10]).cast("date")
    if isinstance(value, str) and _looks_like_timestamp(value):
        return F.lit(value[:10]).cast("date")
    return F.expr(str(value))


_TS_TEXT = re.compile(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$")


def _looks_like_timestamp(text: str) -> bool:
    return bool(_TS_TEXT.match(text.strip()))


def name_col(name: str) -> Column:
    """The column with exactly this name (dots and backticks in names are not paths)."""
    return F.col("`" + name.replace("`", "``") + "`")


def column_label(value: Any) -> str:
    """A short readable label for a column argument, used in check names."""
    if isinstance(value, str):
        return re.sub(r"[^0-9A-Za-z]+", "_", value).strip("_") or "expr"
    if isinstance(value, (list, tuple)):
        return "_".join(column_label(v) for v in value)
    return "column"


def as_list(value: Any) -> list:
    if value is None:
        return []
    if isinstance(value, (list, tuple)):
        return list(value)
    return [value]


def all_of(cols: Iterable[Column]) -> Column:
    out = None
    for c in cols:
        out = c if out is None else (out & c)
    return F.lit(True) if out is None else out


def any_of(cols: Iterable[Column]) -> Column:
    out = None
    for c in cols:
        out = c if out is None else (out | c)
    return F.lit(False) if out is None else out
