"""Queries for profile preparation (P), profile aggregates (A) and rule generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators.generate import generate_rules, to_stored_rows, with_identity
from ...operators.options import FORM_PRESET, ProfileOptions
from ...operators.prepare import hash_sample, masked, prepare, trim_strings
from ...operators.profile import histogram_categorical, histogram_numeric, profile
from . import fixtures as fx
from .registry import query, table

# ---------------------------------------------------------------- fixtures
EV_DUCK = fx.duck(fx.EVENTS_DIRTY, "events")
# Fixed schema of the dirty events frame, in column order: (name, kind).
EV_COLUMNS = [("event_id", "num"), ("ts", "ts"), ("user_id", "num"), ("event_type", "str"), ("value", "num"),
              ("props", "str"), ("etype_null", "str"), ("etype_empty", "str"), ("date_text", "str"),
              ("ts_text", "str"), ("ip_text", "str")]
NUMERIC_COLS = [c for c, k in EV_COLUMNS if k == "num"]
STRING_COLS = [c for c, k in EV_COLUMNS if k == "str"]
FULL = ProfileOptions(sample_fraction=1.0, limit=None)  # whole table, default thresholds


def ev_profile(spark, sf, options: ProfileOptions = FULL):
    return profile(fx.events_dirty(spark, sf), options, table_name="events")


def _val(c: str, kind: str) -> str:
    return f"trim({c})" if kind == "str" else c


def per_column(select_for, columns=EV_COLUMNS, source=EV_DUCK) -> str:
    """UNION ALL of one aggregate row per column, over the trimmed dirty events."""
    parts = [f"SELECT '{c}' AS column_name, {select_for(c, k)} FROM ({source}) e" for c, k in columns]
    return " UNION ALL ".join(parts)


# ----------------------------------------------------------------- P1 - P8
@query("prep_columns", "P1", "SELECT user_id, value, trim(event_type) AS event_type FROM events")
def prep_columns(spark, sf):
    return prepare(table(spark, sf, "events"), FULL, columns=["user_id", "value", "event_type"])


@query("prep_types", "P2", "SELECT event_id, user_id, value FROM events")
def prep_types(spark, sf):
    return prepare(table(spark, sf, "events"), FULL.with_(profile_types=["bigint", "double"]))


SAMPLE_DUCK = ("SELECT o_orderkey, o_totalprice FROM orders WHERE "
               "substr(md5(concat(CAST(o_orderkey AS VARCHAR), ':42')), 1, 8) < '4ccccccc'")


@query("prep_sample", "P3", SAMPLE_DUCK)
def prep_sample(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return hash_sample(orders, 0.3, 42, ["o_orderkey"])


@query("prep_limit", "P4", SAMPLE_DUCK + " ORDER BY o_orderkey LIMIT 1000")
def prep_limit(spark, sf):
    # the limit is the feature: at most 1000 sampled rows, chosen by key order
    opts = ProfileOptions(sample_fraction=0.3, sample_seed=42, limit=1000, sample_key=("o_orderkey",))
    return prepare(table(spark, sf, "orders"), opts, columns=["o_orderkey", "o_totalprice"])


@query("prep_sample_keyless", "P3", "SELECT true AS share_kept, true AS rows_of_table, true AS no_row_twice")
def prep_sample_keyless(spark, sf):
    # rows drawn one by one have no result that SQL could give: what must hold of every draw
    orders = table(spark, sf, "orders")
    drawn = prepare(orders, FULL.with_(sample_fraction=0.3, sample_seed=42), columns=["o_orderkey", "o_totalprice"])
    found = drawn.groupBy("o_orderkey", "o_totalprice").agg(F.count(F.lit(1)).alias("times"))
    share = F.count_if(F.col("times").isNotNull())
    n = F.count(F.lit(1))
    return (orders.select("o_orderkey", "o_totalprice").join(found, ["o_orderkey", "o_totalprice"], "full_outer")
            .join(orders.select("o_orderkey", F.lit(True).alias("known")), "o_orderkey", "left")
            .agg((F.abs(share - 0.3 * n) <= 6 * F.sqrt(0.21 * n)).alias("share_kept"),
                 F.bool_and(F.coalesce("known", F.lit(False))).alias("rows_of_table"),
                 F.coalesce(F.max("times") == 1, F.lit(True)).alias("no_row_twice")))


@query("prep_default_whole_table", "P3,P4,A1", "SELECT c AS column_name, count(*) AS row_count FROM orders, (VALUES ('o_orderkey'), ('o_orderstatus'), "
       "('o_totalprice')) v(c) GROUP BY c")
def prep_default_whole_table(spark, sf):
    # options as they come: no sample, no limit
    return (profile(table(spark, sf, "orders"), columns=["o_orderkey", "o_orderstatus", "o_totalprice"])
            .select("column_name", "row_count"))


@query("prep_trim", "P5", "SELECT conv_id, turn, trim(role_padded) AS role_padded FROM ("
       + fx.duck(fx.CONVERSATIONS_PADDED, "conversations") + ") c")
def prep_trim(spark, sf):
    return trim_strings(fx.conversations_padded(spark, sf).select("conv_id", "turn", "role_padded"))


@query("prep_length", "P6", "SELECT conv_id, turn, CASE WHEN length(trim(role_padded)) BETWEEN 5 AND 9 "
       "THEN trim(role_padded) END AS role_kept FROM (" + fx.duck(fx.CONVERSATIONS_PADDED, "conversations") + ") c")
def prep_length(spark, sf):
    opts = FULL.with_(min_length=5, max_length=9)
    df = trim_strings(fx.conversations_padded(spark, sf).select("conv_id", "turn", "role_padded"))
    return df.select("conv_id", "turn", masked(F.col("role_padded"), df.schema["role_padded"].dataType, opts)
                     .alias("role_kept"))


@query("prep_value_bounds", "P7",
       "SELECT event_id, CASE WHEN value >= 1 AND value <= 400 THEN value END AS value_kept FROM events")
def prep_value_bounds(spark, sf):
    opts = FULL.with_(min_value=1, max_value=400)
    df = table(spark, sf, "events")
    return df.select("event_id", masked(F.col("value"), df.schema["value"].dataType, opts).alias("value_kept"))


def _band_sql(c: str) -> str:
    return (f"SELECT '{c}' AS column_name, min(CASE WHEN {c} BETWEEN m - 3 * s AND m + 3 * s THEN {c} END) AS min_kept, "
            f"max(CASE WHEN {c} BETWEEN m - 3 * s AND m + 3 * s THEN {c} END) AS max_kept "
            f"FROM events, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM events) st")


BAND_DUCK = " UNION ALL ".join(_band_sql(c) for c in NUMERIC_COLS)


@query("prep_outliers", "P8", "SELECT column_name, CAST(min_kept AS DOUBLE) + 0.0 AS min_kept, "
       "CAST(max_kept AS DOUBLE) + 0.0 AS max_kept FROM (" + BAND_DUCK + ") b")
def prep_outliers(spark, sf):
    p = ev_profile(spark, sf)
    return p.where(F.col("data_type").isin("bigint", "double")).select("column_name", "min_kept", "max_kept")


# ----------------------------------------------------------------- A1 - A9
@query("agg_row_count", "A1", per_column(lambda c, k: "count(*) AS row_count"))
def agg_row_count(spark, sf):
    return ev_profile(spark, sf).select("column_name", "row_count")


@query("agg_nulls", "A2", per_column(lambda c, k: f"count_if({c} IS NULL) AS null_count, "
                                                  f"round(count_if({c} IS NULL) / count(*), 6) AS null_ratio"))
def agg_nulls(spark, sf):
    return ev_profile(spark, sf).select("column_name", "null_count",
                                        F.round(F.col("null_count") / F.col("row_count"), 6).alias("null_ratio"))


@query("agg_empties", "A3", per_column(lambda c, k: f"count_if(trim({c}) = '') AS empty_count",
                                       [(c, "str") for c in STRING_COLS]))
def agg_empties(spark, sf):
    return ev_profile(spark, sf).where(F.col("data_type") == "string").select("column_name", "empty_count")


@query("agg_distinct", "A4", per_column(lambda c, k: f"count(DISTINCT {_val(c, k)}) AS distinct_count"))
def agg_distinct(spark, sf):
    return ev_profile(spark, sf, FULL.with_(exact_distinct=True)).select("column_name", "distinct_count")


@query("agg_distinct_merged", "A4", per_column(lambda c, k: f"count(*) AS rows, count(DISTINCT {_val(c, k)}) AS distinct_count, CAST(3 AS BIGINT) "
                                               "AS runs, true AS within_error"))
def agg_distinct_merged(spark, sf):
    # three runs over parts of the table, each part's sketches stored; a value in several parts counts once
    from ...operators import sketches
    from ...session import scratch_dir
    events, path = fx.events_dirty(spark, sf), scratch_dir(spark, "sketches")
    for k in range(3):
        part = events.where(F.col("event_id") % 3 == k)
        sketches.store_sketches(sketches.column_sketches(part, "events", f"part{k}", FULL), path)
    merged = sketches.merged_distinct(sketches.stored_sketches(spark, path))
    exact = ev_profile(spark, sf, FULL.with_(exact_distinct=True)).select("column_name", "distinct_count")
    # four standard errors, and no less than one value
    within = F.abs(F.col("distinct_estimate") - F.col("distinct_count")) <= F.greatest(F.lit(1.0), 4 * F.col("relative_error") * F.col("distinct_count"))
    return merged.join(exact, "column_name").select("column_name", "rows", "distinct_count", "runs", within.alias("within_error"))


def _text(c: str, k: str) -> str:
    return f"trim({c})" if k == "str" else f"CAST({c} AS VARCHAR)"


@query("agg_value_list", "A5", "SELECT * FROM (" + per_column(
    lambda c, k: f"CASE WHEN count(DISTINCT {_text(c, k)}) <= 30 THEN string_agg(DISTINCT {_text(c, k)}, '|' "
                 f"ORDER BY {_text(c, k)}) END AS value_list",
    [(c, k) for c, k in EV_COLUMNS if k in ("str", "num")]) + ") v WHERE value_list IS NOT NULL")
def agg_value_list(spark, sf):
    # value lists exist only for screened columns: at most 2 * max_in_count + 10 distinct values
    return (ev_profile(spark, sf).where(F.col("values").isNotNull())
            .select("column_name", F.array_join("values", "|").alias("value_list")))


@query("agg_min_max", "A6", per_column(lambda c, k: f"CAST(min({c}) AS DOUBLE) + 0.0 AS min, CAST(max({c}) AS DOUBLE) + 0.0 AS max",
                                       [(c, "num") for c in NUMERIC_COLS]))
def agg_min_max(spark, sf):
    return ev_profile(spark, sf).where(F.col("data_type").isin("bigint", "double")).select("column_name", "min", "max")


@query("agg_round_bounds", "A7", "SELECT column_name, CAST(floor(min_kept) AS BIGINT) AS lower_bound, "
       "CAST(ceil(max_kept) AS BIGINT) AS upper_bound FROM (" + BAND_DUCK + ") b")
def agg_round_bounds(spark, sf):
    return (ev_profile(spark, sf).where(F.col("data_type").isin("bigint", "double"))
            .select("column_name", F.floor("min_kept").cast("bigint").alias("lower_bound"),
                    F.ceil("max_kept").cast("bigint").alias("upper_bound")))


@query("agg_moments", "A8", per_column(lambda c, k: f"round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev",
                                       [(c, "num") for c in NUMERIC_COLS]))
def agg_moments(spark, sf):
    return (ev_profile(spark, sf).where(F.col("data_type").isin("bigint", "double"))
            .select("column_name", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev")))


@query("agg_hist_categorical", "A9",
       "SELECT 'event_type' AS column_name, event_type AS value, count(*) AS count FROM events GROUP BY event_type "
       "UNION ALL SELECT 'etype_empty', etype_empty, count(*) FROM (" + EV_DUCK + ") e GROUP BY etype_empty")
def agg_hist_categorical(spark, sf):
    return histogram_categorical(fx.events_dirty(spark, sf), ["event_type", "etype_empty"], FULL)


@query("agg_hist_numeric", "A9",
       "WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events) "
       "SELECT 'value' AS column_name, CAST(least(greatest(floor((value - lo) / ((hi - lo) / 10)) + 1, 1), 10) AS INTEGER)"
       " AS bucket, count(*) AS count FROM events, b GROUP BY 2")
def agg_hist_numeric(spark, sf):
    ev = table(spark, sf, "events")
    lo = ev.select(F.min("value")).scalar()
    hi = ev.select(F.max("value")).scalar()
    return histogram_numeric(ev, "value", 10, lo, hi).select("column_name", "bucket", "count")


# ----------------------------------------------------------------- R1 - R10
def _stats_sql() -> str:
    """Per-column statistics of the dirty events frame, as the generator reads them."""
    def sel(c, k):
        v = _val(c, k)
        empty = f"count_if({v} = '')" if k == "str" else "NULL"
        vals = f"string_agg(DISTINCT {_text(c, k)}, '|' ORDER BY {_text(c, k)})" if k in ("str", "num") else "NULL"
        return (f"'{k}' AS kind, count(*) AS n, count_if({c} IS NULL) AS nulls, {empty} AS empties, "
                f"count(DISTINCT {v}) AS nd, {vals} AS vals")
    return per_column(sel)


def _quoted_list() -> str:
    return ("(SELECT string_agg(CASE WHEN kind = 'num' THEN x ELSE "
            "'''' || replace(replace(x, '\\', '\\\\'), '''', '''''') || '''' END, ', ' ORDER BY x) "
            "FROM (SELECT unnest(string_split(vals, '|')) AS x))")


def _raw_bounds_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, min({c}) AS min_kept, max({c}) AS max_kept FROM events"
                              for c in NUMERIC_COLS)


def rules_duck(max_null=0.01, max_empty=0.01, max_in=10, ratio=0.05, outliers=True) -> str:
    """The generated rules of the dirty events frame, computed in SQL for the given thresholds."""
    return (
        "WITH s AS (" + _stats_sql() + "), b AS (" + (BAND_DUCK if outliers else _raw_bounds_sql()) + "), r AS ("
        "SELECT column_name || '_is_not_null' AS name, '`' || column_name || '` IS NOT NULL' AS expression, "
        f"'not_null' AS kind FROM s WHERE nulls / n <= {max_null} AND NOT (kind = 'str' AND empties / n <= {max_empty}) "
        "UNION ALL SELECT column_name || '_is_not_null_or_empty', '`' || column_name || '` IS NOT NULL AND trim(`' || "
        "column_name || '`) <> ''''', 'not_null_or_empty' FROM s "
        f"WHERE kind = 'str' AND nulls / n <= {max_null} AND empties / n <= {max_empty} "
        "UNION ALL SELECT column_name || '_is_in', CASE WHEN kind = 'str' THEN 'trim(`' || column_name || '`)' "
        "ELSE '`' || column_name || '`' END || ' IN (' || " + _quoted_list() + " || ')', 'is_in' "
        f"FROM s WHERE kind IN ('str', 'num') AND nd <= {max_in} AND nd / n < {ratio} "
        "UNION ALL SELECT column_name || '_min_max', '`' || column_name || '` >= ' || "
        "CAST(CAST(floor(min_kept) AS BIGINT) AS VARCHAR) || ' AND `' || column_name || '` <= ' || "
        "CAST(CAST(ceil(max_kept) AS BIGINT) AS VARCHAR), 'min_max' FROM b) ")


RULES_DUCK = rules_duck()


def _rules(spark, sf):
    return generate_rules(ev_profile(spark, sf), FULL)


def _rules_of(suffix: str):
    def fn(spark, sf):
        return (_rules(spark, sf).where(F.col("name").endswith(suffix))
                .select("name", F.col("arguments")["expression"].alias("expression")))
    return fn


for _name, _op, _kind, _suffix in [("rule_not_null", "R1", "not_null", "_is_not_null"),
                                   ("rule_not_null_or_empty", "R2", "not_null_or_empty", "_is_not_null_or_empty"),
                                   ("rule_is_in", "R3", "is_in", "_is_in"),
                                   ("rule_min_max", "R4", "min_max", "_min_max")]:
    query(_name, _op, RULES_DUCK + f"SELECT name, expression FROM r WHERE kind = '{_kind}'")(_rules_of(_suffix))


# Columns whose bounds a double can't hold: large whole numbers, and decimals with their scale.
BOUNDS = ["CAST(9223372036854000000 AS bigint) + o_orderkey AS big", "CAST(o_totalprice AS decimal(20,2)) AS price"]


def bounds_frame(orders):
    """The columns of BOUNDS; where a key takes ``big`` out of bigint's range, as decimals, whose bounds have the same text."""
    fits = orders.selectExpr(f"coalesce(max(o_orderkey) <= {2 ** 63 - 1 - 9223372036854000000}, true)").first()[0]
    return orders.selectExpr(*BOUNDS) if fits else orders.selectExpr(BOUNDS[0].replace("bigint", "decimal(20,0)", 1), *BOUNDS[1:])


def _bounds_rule(column: str):
    def fn(spark, sf):
        opts = FULL.with_(remove_outliers=False, round=False)
        frame = bounds_frame(table(spark, sf, "orders")).select(column)
        return (generate_rules(profile(frame, opts, table_name="orders"), opts).where(F.col("name").endswith("_min_max"))
                .select("name", F.col("arguments")["expression"].alias("expression")))
    return fn


for _name, _column in [("rule_min_max_bigint", "big"), ("rule_min_max_decimal", "price")]:
    query(_name, "R4,A6", f"SELECT '{_column}_min_max' AS name, '`{_column}` >= ' || CAST(min({_column}) AS VARCHAR) || ' AND `{_column}` <= ' || "
          f"CAST(max({_column}) AS VARCHAR) AS expression FROM ({fx.duck(BOUNDS, 'orders')}) o")(_bounds_rule(_column))


@query("rule_is_in_padded", "R3,P5",
       "SELECT 'role_padded_is_in' AS name, 'trim(`role_padded`) IN (' || string_agg(DISTINCT '''' || trim(role_padded) || '''', ', ' ORDER BY "
       "'''' || trim(role_padded) || '''') || ')' AS expression, CAST(0 AS BIGINT) AS failing FROM (" + fx.duck(fx.CONVERSATIONS_PADDED, "conversations") + ") c")
def rule_is_in_padded(spark, sf):
    # learned from padded values, and held by the padded rows they were learned from
    from ..apply import apply_checks
    from ..rules import rules_from_documents
    padded = fx.conversations_padded(spark, sf).select("role_padded")
    rules = generate_rules(profile(padded, FULL, table_name="conversations"), FULL).where(F.col("name").endswith("_is_in"))
    failing = apply_checks(padded, rules_from_documents(rules)).agg(F.count_if(F.coalesce("_errors", "_warnings").isNotNull()).alias("failing")).scalar()
    return rules.select("name", F.col("arguments")["expression"].alias("expression"), failing.alias("failing"))


@query("rule_shape", "R5", RULES_DUCK + "SELECT 'events' AS table_name, name, 'warn' AS criticality, "
       "'default' AS run_config_name, 'sql_expression' AS function, expression FROM r")
def rule_shape(spark, sf):
    return _rules(spark, sf).select("table_name", "name", "criticality", "run_config_name", "function",
                                    F.col("arguments")["expression"].alias("expression"))


PAYLOAD_DUCK = ("'{\"check\":{\"arguments\":{\"expression\":' || to_json(expression) || '},\"for_each_column\":null,"
                "\"function\":\"sql_expression\"},\"filter\":\"\",\"table_name\":\"events\"}'")


@query("rule_payload", "R6", RULES_DUCK + f"SELECT name, {PAYLOAD_DUCK} AS check_id_payload FROM r")
def rule_payload(spark, sf):
    return with_identity(_rules(spark, sf)).select("name", "check_id_payload")


@query("rule_check_id", "R7", RULES_DUCK + f"SELECT name, sha256({PAYLOAD_DUCK}) AS check_id FROM r")
def rule_check_id(spark, sf):
    return with_identity(_rules(spark, sf)).select("name", "check_id")


# Argument texts that hold numbers, derived from events: each kind of spelling a JSON number may have.
NUMBER_TEXTS = [
    "event_id", "CASE event_id % 6 "
    "WHEN 0 THEN concat('[', CAST(user_id AS string), '.0, 1.50]') WHEN 1 THEN concat('[', CAST(user_id AS string), ', 1.5]') "
    "WHEN 2 THEN concat('{\"b\": -0.0, \"a\": ', CAST(event_id AS string), '}') "
    "WHEN 3 THEN concat('{\"a\": 1, \"a\": ', CAST(user_id AS string), '}') "
    "WHEN 4 THEN concat('[', CAST(event_id AS string), '00000000000000000001, 1e2]') "
    "ELSE concat('[', CAST(user_id AS string), ', 1.') END AS arg_text"]
NUMBERS_DUCK = (
    "WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '[' || user_id || '.0,1.5]' WHEN 1 THEN '[' || user_id || ',1.5]' "
    "WHEN 2 THEN '{\"a\":' || event_id || ',\"b\":-0.0}' WHEN 3 THEN '{\"a\":' || user_id || '}' "
    "WHEN 4 THEN '[' || ltrim(event_id || '00000000000000000001', '0') || ',100.0]' ELSE '[' || user_id || ', 1.' END AS v FROM events "
    "), p AS (SELECT event_id, '{\"check\":{\"arguments\":{\"allowed\":' || to_json(v) || "
    "'},\"for_each_column\":null,\"function\":\"is_in_list\"},\"filter\":\"\",\"table_name\":\"events\"}' AS check_id_payload FROM t) "
    "SELECT event_id, check_id_payload, sha256(check_id_payload) AS check_id FROM p")


@query("rule_payload_numbers", "R6,R7", NUMBERS_DUCK)
def rule_payload_numbers(spark, sf):
    texts = table(spark, sf, "events").selectExpr(*NUMBER_TEXTS)
    rules = texts.select("event_id", F.lit("events").alias("table_name"), F.lit("is_in_list").alias("function"),
                         F.create_map(F.lit("allowed"), F.col("arg_text")).alias("arguments"), F.lit(None).cast("string").alias("filter"))
    return with_identity(rules).select("event_id", "check_id_payload", "check_id")


# The options and settings recorded with each stored rule (R8 text forms).
META = {"profile_options": {"sample_fraction": 1.0, "limit": None, "remove_outliers": True,
                            "outlier_columns": [], "num_sigmas": 3, "trim_strings": True},
        "generator_settings": {"mode": "table", "criticality": "warn", "include_table_name": True}}
META_TEXT = [("profile_options", "limit", "null"), ("profile_options", "num_sigmas", "3"),
             ("profile_options", "outlier_columns", "[]"), ("profile_options", "remove_outliers", "true"),
             ("profile_options", "sample_fraction", "1.0"), ("profile_options", "trim_strings", "true"),
             ("generator_settings", "criticality", "warn"), ("generator_settings", "include_table_name", "true"),
             ("generator_settings", "mode", "table")]


@query("rule_stringify", "R8", RULES_DUCK + "SELECT name, section, key, value FROM r, (VALUES "
       + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in META_TEXT) + ") m(section, key, value)")
def rule_stringify(spark, sf):
    rows = to_stored_rows(_rules(spark, sf), "tester", "2024-01-01T00:00:00Z", generator_meta=META)
    return (rows.select("name", F.explode("generator_meta").alias("g"))
            .select("name", F.col("g.section").alias("section"), F.explode("g.payload").alias("key", "value")))


R9_TABLES = ["region", "nation", "supplier", "orders", "part"]


def _generate_for(spark, sf, names, options):
    from ..rulegen import generate_all
    return generate_all(spark, names, options, reader=lambda n: table(spark, sf, n))


@query("rule_empty_tables", "R9",
       "SELECT t AS table_name FROM (VALUES " + ", ".join(f"('{t}')" for t in R9_TABLES) + ") v(t) WHERE NOT EXISTS "
       "(SELECT 1 FROM information_schema.columns c WHERE c.table_name = v.t AND c.data_type = 'DOUBLE')")
def rule_empty_tables(spark, sf):
    opts = FULL.with_(profile_types=["double"])
    return _generate_for(spark, sf, R9_TABLES, opts).summary.where("status = 'no checks'").select("table_name")


# Fixed schema facts: the double columns of the R9/R10 tables.
R10_DOUBLES = [("supplier", "s_acctbal"), ("orders", "o_totalprice"), ("part", "p_retailprice")]
R10_DUCK = (
    "WITH st AS (" + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n, count_if({c} IS NULL) AS nulls, count(DISTINCT {c}) AS nd, "
        f"count({c}) AS nn FROM {t}" for t, c in R10_DOUBLES)
    + "), c AS (SELECT table_name, sum(CAST(nulls / n <= 0.01 AS INTEGER) + CAST(nd <= 10 AND nd / n < 0.05 AS INTEGER)"
    " + CAST(nn > 0 AS INTEGER)) AS checks FROM st GROUP BY table_name) "
    "SELECT t.table_name, CAST(coalesce(c.checks, 0) AS BIGINT) AS checks, "
    "CASE WHEN coalesce(c.checks, 0) = 0 THEN 'no checks' ELSE 'ok' END AS status FROM (VALUES "
    + ", ".join(f"('{t}')" for t in R9_TABLES) + ") t(table_name) LEFT JOIN c ON t.table_name = c.table_name")


@query("rule_summary", "R10", R10_DUCK)
def rule_summary(spark, sf):
    opts = FULL.with_(profile_types=["double"])
    return _generate_for(spark, sf, R9_TABLES, opts).summary.select("table_name", "checks", "status")


@query("rule_form_preset", "R1-R4,D10", rules_duck(0.05, 0.02, 20, 0.01, outliers=False)
       + "SELECT name, expression FROM r")
def rule_form_preset(spark, sf):
    # the second named preset (the configuration form's defaults), on the whole table
    opts = FORM_PRESET.with_(sample_fraction=1.0, limit=None)
    return (generate_rules(profile(fx.events_dirty(spark, sf), opts, table_name="events"), opts)
            .select("name", F.col("arguments")["expression"].alias("expression")))
