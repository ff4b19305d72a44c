"""Rule identity (R6-R8, R11): canonical payload, SHA-256 id, argument text.

All as Column expressions over a rules DataFrame, so ids of any number of
rules are computed by executors. JSON-valued arguments go through Python's
JSON in Arrow batches (see ``_canonical_texts``).
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.rules import BOOL_ARGS, INT_ARGS, LIST_ARGS, TRUE_WORDS

JSON_LOOKING = r"^(\{.*\}|\[.*\])$"
# Whitespace as Python's str.isspace() sees it (Unicode White_Space plus U+001C-U+001F)
WS = r"(?U)[\s\x1c-\x1f]"


def py_strip(text: Column) -> Column:
    """``str.strip()``: every leading and trailing whitespace character, not only spaces."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")


def canonical_filter(filter_col: Column) -> Column:
    """Whitespace runs collapsed to one space, ends trimmed; NULL → ''."""
    return F.coalesce(py_strip(F.regexp_replace(filter_col, rf"{WS}+", " ")), F.lit(""))


def _canonical(text: str | None, ascii_only: bool) -> str | None:
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only)
    except (TypeError, ValueError, RecursionError):
        return None


def _canonical_texts(ascii_only: bool):
    """Arrays of texts → arrays of canonical JSON, NULL for what isn't JSON.

    Spark's JSON functions give a number another spelling (``1.0`` becomes
    ``1``) and refuse an object that names a key twice, so rules that differ
    would share an id; this is the one Python step of rule identity, over rows
    of rules, not of data. Numbers keep whether they are whole and their
    value's shortest spelling (``1.50`` is ``1.5``, ``-0.0`` stays), keys are
    sorted, and of equal keys the last counts.
    """
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors may not have this package

    @F.pandas_udf("array<string>")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(lambda row: None if row is None else [_canonical(t, ascii_only) for t in row])

    return convert


def _json_looking(text: Column) -> Column:
    return F.when(text.rlike(JSON_LOOKING), text)


def canonical_json_texts(texts: Column, ascii_only: bool = False) -> Column:
    """Each text of an array as compact JSON with sorted keys where it looks like JSON and parses, else as it is."""
    done = _canonical_texts(ascii_only)(F.transform(texts, _json_looking))
    return F.transform(F.arrays_zip(texts.alias("text"), done.alias("json")), lambda e: F.coalesce(e["json"], e["text"]))


def canonical_arguments(arguments: Column) -> Column:
    """Values trimmed (NULL → ''), JSON-looking values re-serialised, keys sorted."""
    texts = F.transform(F.map_values(arguments), lambda v: py_strip(F.coalesce(v, F.lit(""))))
    entries = F.arrays_zip(F.map_keys(arguments).alias("key"), canonical_json_texts(texts).alias("value"))
    return F.map_from_entries(F.array_sort(entries))


def check_payload(table_name: Column, function: Column, arguments: Column, for_each_column: Column,
                  filter_col: Column) -> Column:
    """Compact JSON, sorted keys, of the rule's identity fields."""
    fec = F.when(F.size(for_each_column) > 0, F.array_sort(for_each_column.cast("array<string>")))
    args = F.coalesce(canonical_arguments(arguments), F.create_map().cast("map<string,string>"))
    obj = F.struct(
        F.struct(args.alias("arguments"), fec.alias("for_each_column"), function.alias("function")).alias("check"),
        canonical_filter(filter_col).alias("filter"),
        F.lower(F.coalesce(table_name, F.lit(""))).alias("table_name"))
    return F.to_json(obj, {"ignoreNullFields": "false"})


def check_id(payload: Column) -> Column:
    """SHA-256 hex of the payload text (UTF-8)."""
    return F.sha2(payload, 256)


def _typed_text(key: Column, t: Column, parsed: Column) -> Column:
    """The stored string of one typed argument, from its stripped text and its canonical JSON (NULL: none)."""
    as_bool = F.when(F.lower(t).isin(*sorted(TRUE_WORDS)), F.lit("true")).otherwise(F.lit("false"))
    as_int = F.coalesce(t.try_cast("bigint").cast("string"), t)
    comma = F.to_json(F.filter(F.transform(F.split(t, ","), py_strip), lambda x: x != F.lit("")))
    as_list = F.when(t.startswith("["), F.coalesce(parsed, comma)).otherwise(comma)
    other = F.when(parsed.isNotNull(), parsed).when(F.coalesce(t, F.lit("")) == F.lit(""), F.lit("null")).otherwise(t)
    return (F.when(key.isin(*sorted(BOOL_ARGS)), as_bool)
            .when(key.isin(*sorted(INT_ARGS)), as_int)
            .when(key.isin(*sorted(LIST_ARGS)), as_list)
            .otherwise(other))


def argument_text(key: Column, raw: Column) -> Column:
    """R11 then R8 on text: the stored string of one typed argument.

    boolean keys → ``true``/``false``; integer keys → the integer when the text
    is one; list keys → a JSON list (from JSON text, else a comma list);
    other JSON-looking text → compact sorted JSON; blank → ``null``.
    """
    t = py_strip(raw)
    return _typed_text(key, t, _canonical_texts(True)(F.array(_json_looking(t)))[0])


def typed_arguments(arguments: Column) -> Column:
    """Every value of an arguments map through ``argument_text``."""
    texts = F.transform(F.map_values(arguments), py_strip)
    parsed = _canonical_texts(True)(F.transform(texts, _json_looking))
    entries = F.arrays_zip(F.map_keys(arguments).alias("key"), texts.alias("text"), parsed.alias("json"))
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(
        e["key"].alias("key"), _typed_text(e["key"], e["text"], e["json"]).alias("value"))))
