"""Queries for the streaming forms (T1-T3), and for custom rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators.generate import generate_rules
from ...operators.identity import argument_text, typed_arguments
from ...operators.profile import profile
from ...plans.apply import summarize
from ...session import scratch_dir
from ...streaming.checks import apply_checks_stream, file_stream, run_to_parquet, run_windows, window_counts_stream
from . import fixtures as fx
from .dataset_level import FK_SQL, LI_KEYS
from .profiling import FULL, BAND_DUCK
from .registry import query, table
from .row_level import EV_DUCK, IPV4_DUCK, oracle, rule


def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return file_stream(spark, sf, f"{name}.parquet", schema)


STREAM_RULES = [rule("is_not_null_and_is_in_list", "etype_listed", column="etype_null",
                     allowed=["click", "purchase", "view"]),
                rule("is_valid_ipv4_address", "ip_valid", column="ip_text"),
                rule("is_not_in_future", "ts_not_future", "warn", column="ts", offset=86400,
                     curr_timestamp=fx.NOW_FUTURE)]


@query("stream_row_checks", "T1",
       "SELECT event_id, NULLIF(concat_ws(',', CASE WHEN etype_null IS NULL OR etype_null NOT IN ('click', 'purchase', "
       f"'view') THEN 'etype_listed' END, CASE WHEN ip_text IS NOT NULL AND NOT {IPV4_DUCK} THEN 'ip_valid' END), '') "
       f"AS error_checks, CASE WHEN ts > TIMESTAMP '{fx.NOW_FUTURE}' + INTERVAL 86400 SECOND THEN 'ts_not_future' END "
       f"AS warning_checks FROM ({EV_DUCK}) e")
def stream_row_checks(spark, sf):
    stream = _stream(spark, sf, "events").selectExpr(*fx.EVENTS_DIRTY)
    checked = summarize(apply_checks_stream(stream, STREAM_RULES), ["event_id"])
    return run_to_parquet(checked, scratch_dir(spark, "stream-rows"))


@query("stream_fresh_windows", "T2",
       "SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS window_start, time_bucket(INTERVAL 60 MINUTE, ts) + "
       "INTERVAL 60 MINUTE AS window_end, count(*) AS records, count(*) >= 10 AS fresh FROM events GROUP BY 1")
def stream_fresh_windows(spark, sf):
    counts = window_counts_stream(_stream(spark, sf, "events"), "ts", 60, 10, watermark="1 day")
    return run_windows(counts, scratch_dir(spark, "stream-windows"))


@query("stream_foreign_key", "T3",
       oracle(FK_SQL, LI_KEYS, "l_suppkey IS NOT NULL AND NOT found", "supplier_in_credit"))
def stream_foreign_key(spark, sf):
    stream = _stream(spark, sf, "lineitem")
    rules = [rule("foreign_key", "supplier_in_credit", columns=["l_suppkey"], ref_columns=["s_suppkey"],
                  ref_df_name="suppliers")]
    checked = apply_checks_stream(stream, rules, refs={"suppliers": fx.suppliers_in_credit(spark, sf)})
    out = summarize(checked, LI_KEYS).drop("warning_checks")
    return run_to_parquet(out, scratch_dir(spark, "stream-fk"))


FILE_ROWS = 250_000  # events of a file that a streaming task reads, and of a state partition, at most on average


def _dealt_events(spark, sf, file_rows=FILE_ROWS):
    """Events dealt to four batches of files by a hash of the event: groups go on from batch to batch. Also, the number of files."""
    folder = scratch_dir(spark, "stream-dealt")
    events = table(spark, sf, "events")
    files = 4 * max(1, -(-events.count() // (4 * file_rows)))
    events.repartition(files, "event_id").write.option("maxRecordsPerFile", 2 * file_rows).parquet(folder)
    return file_stream(spark, folder, "*.parquet", events.schema, files_per_batch=files // 4), files


def _running(spark, sf, rules, file_rows=FILE_ROWS):
    from ...streaming.running import RunningChecks
    events, files = _dealt_events(spark, sf, file_rows)
    # a file to a task, and state partitions that grow with the files: neither holds more groups where there are more events
    conf = {"spark.sql.files.openCostInBytes": spark.conf.get("spark.sql.files.maxPartitionBytes"),
            "spark.sql.shuffle.partitions": str(max(files, int(spark.conf.get("spark.sql.shuffle.partitions"))))}
    checks = RunningChecks(spark, rules, scratch_dir(spark, "stream-running"), conf=conf).drain(events)
    return summarize(checks.annotate(), ["event_id"])


@query("stream_unique", "T1,G1",
       "SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts)) > 1 THEN "
       "'user_type_hour_unique' END AS error_checks, CASE WHEN count(*) OVER (PARTITION BY event_id) > 1 THEN 'event_id_unique' END "
       "AS warning_checks FROM events")
def stream_unique(spark, sf):
    return _running(spark, sf, [rule("is_unique", "user_type_hour_unique", columns=["user_id", "event_type", "date_trunc('hour', ts)"]),
                                rule("is_unique", "event_id_unique", "warn", columns=["event_id"])])


@query("stream_aggr_equal", "T1,G2-G5",
       "SELECT event_id, NULLIF(concat_ws(',', CASE WHEN n <> 2 AND event_type <> 'error' THEN 'two_per_user_type_day' END, "
       "CASE WHEN hi > 45000 THEN 'user_value_cap' END), '') AS error_checks, "
       "NULLIF(concat_ws(',', CASE WHEN lo < 1 THEN 'type_floor' END, CASE WHEN first = ts THEN 'user_first_event' END), '') AS warning_checks "
       "FROM (SELECT *, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id, event_type, date_trunc('day', ts)) AS n, "
       "max(CAST(value * 100 AS BIGINT)) OVER (PARTITION BY user_id) AS hi, min(value) OVER (PARTITION BY event_type, user_id) AS lo, "
       "min(ts) OVER (PARTITION BY user_id) AS first FROM events) e")
def stream_aggr_equal(spark, sf):
    return _running(spark, sf, [
        rule("is_aggr_equal", "two_per_user_type_day", aggr_type="count", group_by=["user_id", "event_type", "date_trunc('day', ts)"],
             limit=2, filter="event_type <> 'error'"),
        rule("is_aggr_not_greater_than", "user_value_cap", column="CAST(value * 100 AS BIGINT)", aggr_type="max", group_by=["user_id"], limit=45000),
        rule("is_aggr_not_less_than", "type_floor", "warn", column="value", aggr_type="min", group_by=["event_type", "user_id"], limit=1),
        rule("is_aggr_not_equal", "user_first_event", "warn", column="ts", aggr_type="min", group_by=["user_id"], limit="ts")])


@query("stream_empty_windows", "T2,G9",
       "WITH c AS (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) AS w, count(*) AS n FROM events GROUP BY ALL), "
       "k AS (SELECT event_type, min(w) AS first, (SELECT max(w) FROM c) AS last FROM c GROUP BY 1), "
       "g AS (SELECT event_type, unnest(generate_series(first, last, INTERVAL 30 MINUTE)) AS w FROM k) "
       "SELECT g.event_type AS key, g.w AS window_start, g.w + INTERVAL 30 MINUTE AS window_end, CAST(coalesce(c.n, 0) AS BIGINT) AS records, "
       "coalesce(c.n, 0) >= 2 AS fresh FROM g LEFT JOIN c ON g.event_type = c.event_type AND g.w = c.w")
def stream_empty_windows(spark, sf):
    # four files, then a heartbeat from long after the last event: the timers tell the windows that no row fills
    from ...streaming.windows import windows_stream
    events = table(spark, sf, "events").select("ts", "event_type", F.lit(True).alias("real"))
    folder, out = scratch_dir(spark, "stream-beats"), scratch_dir(spark, "stream-empty")
    last = events.agg(F.max("ts").alias("last"))

    def drain():
        stream = file_stream(spark, folder, "*.parquet", events.schema, files_per_batch=1)
        return run_to_parquet(windows_stream(stream, "ts", 30, 2, watermark="60 days", key="event_type", counted=F.col("real")), out)

    events.repartition(4).write.mode("append").parquet(folder)
    drain()
    beat = last.select((F.col("last") + F.expr("INTERVAL 90 DAYS")).alias("ts"), F.lit("heartbeat").alias("event_type"), F.lit(False).alias("real"))
    beat.coalesce(1).write.mode("append").parquet(folder)
    return drain().where((F.col("key") != "heartbeat") & (F.col("window_start") <= last.scalar()))


# --------------------------------------------------------------- custom rules
# Argument texts as a rule form would send them, derived row by row from events:
# each event yields one (key, text) pair whose key and text depend on its fields.
ARG_TEXTS = [
    "event_id",
    "CASE event_id % 6 WHEN 0 THEN 'negate' WHEN 1 THEN 'days' WHEN 2 THEN 'group_by' WHEN 3 THEN 'columns' "
    "WHEN 4 THEN 'props' ELSE 'expression' END AS arg_key",
    "CASE event_id % 6 "
    "WHEN 0 THEN CASE event_id % 4 WHEN 0 THEN ' Yes' WHEN 1 THEN 'on ' WHEN 2 THEN 'no' ELSE event_type END "
    "WHEN 1 THEN CASE WHEN event_id % 4 = 0 THEN concat(' ', CAST(user_id AS string), ' ') ELSE concat('d', CAST(user_id AS string)) END "
    "WHEN 2 THEN concat(event_type, ', user_id, ,') "
    "WHEN 3 THEN concat('[\"', event_type, '\", \"ts\"]') "
    "WHEN 4 THEN props "
    "ELSE CASE WHEN event_type = 'error' THEN '  ' ELSE concat('value > ', CAST(user_id AS string)) END END AS arg_text",
]

TYPED_DUCK = (
    "SELECT event_id, arg_key, CASE "
    "WHEN arg_key = 'negate' THEN CASE WHEN lower(trim(arg_text)) IN ('1', 'on', 't', 'true', 'y', 'yes') "
    "THEN 'true' ELSE 'false' END "
    "WHEN arg_key = 'days' THEN coalesce(CAST(TRY_CAST(trim(arg_text) AS BIGINT) AS VARCHAR), trim(arg_text)) "
    "WHEN arg_key IN ('group_by', 'columns') THEN CASE WHEN starts_with(trim(arg_text), '[') "
    "THEN CAST(json(trim(arg_text)) AS VARCHAR) ELSE CAST(to_json(list_filter(list_transform("
    "string_split(trim(arg_text), ','), lambda x: trim(x)), lambda x: x <> '')) AS VARCHAR) END "
    "WHEN trim(arg_text) LIKE '{%}' THEN CAST(json(trim(arg_text)) AS VARCHAR) "
    "WHEN trim(arg_text) = '' THEN 'null' ELSE trim(arg_text) END AS arg_value FROM ("
    + fx.duck(ARG_TEXTS, "events") + ") a")


@query("rule_typed_args", "R11,R8", TYPED_DUCK)
def rule_typed_args(spark, sf):
    args = table(spark, sf, "events").selectExpr(*ARG_TEXTS)
    return args.select("event_id", "arg_key", argument_text(F.col("arg_key"), F.col("arg_text")).alias("arg_value"))


CUSTOM_DUCK = (
    "WITH s AS (SELECT DISTINCT event_type FROM events) "
    "SELECT 'events' AS table_name, 'type_' || event_type || '_value_cap' AS name, 'error' AS criticality, "
    "'sql_expression' AS function, 'value <= 400' AS expression, "
    "'event_type = ''' || event_type || '''' AS filter FROM s WHERE event_type <> 'error' "
    "UNION ALL SELECT 'events', column_name || '_min_max', 'warn', 'sql_expression', "
    "'`' || column_name || '` >= ' || CAST(CAST(floor(min_kept) AS BIGINT) AS VARCHAR) || ' AND `' || column_name || "
    "'` <= ' || CAST(CAST(ceil(max_kept) AS BIGINT) AS VARCHAR), NULL FROM (" + BAND_DUCK + ") b "
    "WHERE column_name = 'value'")


def custom_rules(spark, sf):
    """One authored rule per event type (blank filters and names dropped), unioned with generated ones."""
    types = table(spark, sf, "events").select("event_type").distinct()
    authored = types.select(
        F.lit("events").alias("table_name"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("type_"), F.col("event_type"), F.lit("_value_cap")))
        .alias("name"),
        F.lit("error").alias("criticality"), F.lit("default").alias("run_config_name"),
        F.lit("sql_expression").alias("function"),
        typed_arguments(F.create_map(F.lit("expression"), F.lit(" value <= 400 "))).alias("arguments"),
        F.concat(F.lit("event_type = '"), F.col("event_type"), F.lit("'")).alias("filter"))
    valid = authored.where(F.col("table_name").isNotNull() & F.col("name").isNotNull() & F.col("function").isNotNull()) \
        .withColumn("filter", F.when(F.trim("filter") != "", F.col("filter")))
    generated = generate_rules(profile(table(spark, sf, "events").select("value"), FULL, table_name="events"), FULL)
    return valid.unionByName(generated.where(F.col("name").endswith("_min_max")))


@query("rule_custom_union", "R12", CUSTOM_DUCK)
def rule_custom_union(spark, sf):
    return custom_rules(spark, sf).select("table_name", "name", "criticality", "function",
                                          F.col("arguments")["expression"].alias("expression"), "filter")


@query("stream_dataset_per_batch", "T1-T3,G1",
       oracle("SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem", LI_KEYS,
              "n > 1", "order_line_unique"))
def stream_dataset_per_batch(spark, sf):
    # dataset-level checks on a stream run per micro-batch (foreachBatch); one file = one batch here
    from ...streaming.checks import apply_checks_per_batch
    out = scratch_dir(spark, "stream-batch")
    rules = [rule("is_unique", "order_line_unique", columns=["l_orderkey", "l_linenumber"])]

    def sink(df, epoch_id):
        summarize(df, LI_KEYS).drop("warning_checks").write.mode("append").parquet(out + "/data")

    q = (_stream(spark, sf, "lineitem").writeStream.foreachBatch(apply_checks_per_batch(rules, sink, batches_are_tables=True))
         .option("checkpointLocation", out + "/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out + "/data")
