"""Queries for sources and discovery (S1-S8), preview (V1-V4) and sinks (K1-K4)."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators.generate import generate_rules, to_stored_rows
from ...plans.preview import export_preview, preview
from ...session import ensure_checkpoint_dir, scratch_dir
from ...sinks.rule_files import write_rule_files
from ...sinks.rules_table import append_rules
from ...sources.discovery import (discover_catalog, discover_schema, distinct_sorted, exclude_glob,
                                  exclude_prefix, latest_update_flows)
from ...sources.rule_documents import read_rule_documents
from .. import rulegen
from . import fixtures as fx
from .profiling import FULL, PAYLOAD_DUCK, RULES_DUCK, ev_profile
from .registry import query, table

ALL_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
              "benchmark labels conversations").split()
DIM_TABLES = ["region", "nation", "customer", "supplier", "part"]


def _tag(sf: str) -> str:
    # by the whole path: two folders of one name are two catalogs
    return "rf_" + hashlib.sha256(sf.rstrip("/").encode()).hexdigest()[:12]


def register_tables(spark: SparkSession, sf: str) -> str:
    """The given parquet files as catalog tables of two schemas (``<tag>_dim``, ``<tag>_fact``)."""
    tag = _tag(sf)
    base = ensure_checkpoint_dir(spark).rstrip("/")
    for kind in ("dim", "fact"):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {tag}_{kind} LOCATION '{base}/{tag}_{kind}.db'")
    for t in ALL_TABLES:
        kind = "dim" if t in DIM_TABLES else "fact"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {tag}_{kind}.{t} USING parquet "
                  f"LOCATION '{sf.rstrip('/')}/{t}.parquet'")
    return tag


def _named(df, *more):
    parts = F.split("table_name", r"\.")
    return df.select(F.regexp_extract(F.element_at(parts, 2), r"_(dim|fact)$", 1).alias("schema_kind"),
                     F.element_at(parts, -1).alias("table"), *more)


def _catalog(spark, sf):
    tag = register_tables(spark, sf)
    # the session catalog may hold schemas of other jobs: keep the two registered here
    return discover_catalog(spark, "spark_catalog").where(F.split("table_name", r"\.")[1].startswith(tag + "_"))


# names held in a given table: the table that each event's flow would write
FLOWS = ["concat('main.', event_type, '.', event_type, '_', CAST(user_id % 1000 AS string)) AS table_name"]
FLOWS_DUCK = f"WITH f AS ({fx.duck(FLOWS, 'events')}) "


def _flows(spark, sf):
    return table(spark, sf, "events").selectExpr(*FLOWS)


def _per_name(names):
    return names.groupBy("table_name").agg(F.count(F.lit(1)).alias("records"))


@query("src_table_scan", "S1", "SELECT count(*) AS row_count, CAST(sum(o_totalprice) AS DECIMAL(18,2)) AS total "
       "FROM orders")
def src_table_scan(spark, sf):
    tag = register_tables(spark, sf)
    return spark.table(f"spark_catalog.{tag}_fact.orders").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("o_totalprice").cast("decimal(18,2)").alias("total"))


def _counted(spark, names):
    """Rows of every discovered table (the given ones: fourteen names)."""
    found = [r["table_name"] for r in names.distinct().collect()]
    counts = [spark.table(n).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
              for n in found]
    return _named(reduce(DataFrame.unionByName, counts), "row_count")


COUNTS_DUCK = " UNION ALL ".join(
    f"SELECT '{'dim' if t in DIM_TABLES else 'fact'}' AS schema_kind, '{t}' AS \"table\", count(*) AS row_count FROM {t}"
    for t in ALL_TABLES)


@query("src_discover_catalog", "S2", COUNTS_DUCK)
def src_discover_catalog(spark, sf):
    return _counted(spark, _catalog(spark, sf))


@query("src_discover_schema", "S3", f"SELECT * FROM ({COUNTS_DUCK}) n WHERE schema_kind = 'fact'")
def src_discover_schema(spark, sf):
    tag = register_tables(spark, sf)
    return _counted(spark, discover_schema(spark, f"spark_catalog.{tag}_fact"))


@query("src_latest_update_flows", "S4",
       "WITH log AS (" + fx.duck(fx.EVENT_LOG, "events") + "), l AS (SELECT pipeline, arg_max(update_id, ts) AS u "
       "FROM log GROUP BY pipeline) SELECT DISTINCT log.pipeline, log.flow_name FROM log JOIN l "
       "ON log.pipeline = l.pipeline AND log.update_id = l.u WHERE log.flow_name IS NOT NULL")
def src_latest_update_flows(spark, sf):
    return latest_update_flows(fx.event_log(spark, sf), ["p0", "p1", "p2", "p3", "p4"])


@query("src_exclude_glob", "S5", FLOWS_DUCK + "SELECT table_name, count(*) AS records FROM f "
       "WHERE NOT regexp_full_match(split_part(table_name, '.', 3), 'click_.*7') GROUP BY table_name")
def src_exclude_glob(spark, sf):
    return _per_name(exclude_glob(_flows(spark, sf), ".click_*7"))


@query("src_exclude_prefix", "S6", FLOWS_DUCK + "SELECT table_name, count(*) AS records FROM f "
       "WHERE NOT regexp_matches(split_part(split_part(table_name, '.', 3), '_', 1), '^(cl|pu)') GROUP BY table_name")
def src_exclude_prefix(spark, sf):
    return _per_name(exclude_prefix(_flows(spark, sf), "^(CL|pu)"))


@query("src_distinct_sorted", "S7", FLOWS_DUCK + "SELECT DISTINCT table_name FROM f")
def src_distinct_sorted(spark, sf):
    return distinct_sorted(_flows(spark, sf))


def _event_rules(spark, sf):
    return generate_rules(ev_profile(spark, sf), FULL)


@query("src_rule_documents", "S8", RULES_DUCK + "SELECT 'events' AS table_name, name, expression FROM r")
def src_rule_documents(spark, sf):
    out = scratch_dir(spark, "rule-files")
    write_rule_files(_event_rules(spark, sf), out)
    docs = read_rule_documents(spark, out)
    return docs.select("table_name", "name", F.col("arguments")["expression"].alias("expression"))


# ------------------------------------------------------------------ preview
@query("view_project", "V1", "SELECT l_orderkey, l_quantity FROM lineitem")
def view_project(spark, sf):
    return preview(table(spark, sf, "lineitem"), "l_orderkey, l_quantity", limit=None)


@query("view_where", "V2", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def view_where(spark, sf):
    return preview(table(spark, sf, "lineitem"), ["l_orderkey", "l_quantity"], where="l_quantity > 45", limit=None)


@query("view_order", "V3", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def view_order(spark, sf):
    return preview(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice"], order_by="o_totalprice DESC, o_orderkey",
                   limit=None)


TOPK_DUCK = ("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus <> 'P' "
             "ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 1000")


@query("view_topk", "V4", TOPK_DUCK)
def view_topk(spark, sf):
    # the limit is the feature: a top-k report
    return preview(table(spark, sf, "orders"), "o_orderkey,o_orderstatus,o_totalprice,o_orderdate",
                   where="o_orderstatus <> 'P'", order_by=["o_totalprice desc", "o_orderkey Asc"], limit=1000)


# ------------------------------------------------------------------ sinks
@query("sink_rules_table", "K1", RULES_DUCK + f"SELECT name, sha256({PAYLOAD_DUCK}) AS check_id, "
       "CAST(2 AS BIGINT) AS copies FROM r")
def sink_rules_table(spark, sf):
    fqn = f"rf_rules_{uuid.uuid4().hex[:10]}.generated_checks"
    loc = scratch_dir(spark, "rules-table")
    rows = to_stored_rows(_event_rules(spark, sf), "tester", "2024-01-01T00:00:00Z")
    append_rules(spark, rows, fqn, loc)
    append_rules(spark, rows, fqn, loc)  # appends do not de-duplicate
    return spark.table(fqn).groupBy("name", "check_id").agg(F.count(F.lit(1)).alias("copies"))


@query("sink_rule_files", "K2", RULES_DUCK + "SELECT 'events' AS \"table\", name FROM r")
def sink_rule_files(spark, sf):
    out = scratch_dir(spark, "rule-files")
    write_rule_files(_event_rules(spark, sf), out)
    lines = spark.read.text(out)  # the partition folder gives the table
    return (lines.where(F.col("value").rlike(r"^  name: "))
            .select("table", F.get_json_object(F.concat(F.lit('{"v":'), F.regexp_replace("value", "^  name: ", ""),
                                                        F.lit("}")), "$.v").alias("name")))


@query("sink_both_roundtrip", "K3", RULES_DUCK + f"SELECT name, sha256({PAYLOAD_DUCK}) AS check_id FROM r")
def sink_both_roundtrip(spark, sf):
    out = scratch_dir(spark, "both")
    fqn = f"rf_rules_{uuid.uuid4().hex[:10]}.generated_checks"
    settings = rulegen.RulegenSettings(output_format="both", output_yaml=out + "/yaml", output_table=fqn,
                                       table_location=out + "/table")
    readers = {"events": lambda: fx.events_dirty(spark, sf)}
    rulegen.run(spark, ["events"], FULL, settings, reader=lambda t: readers[t]())
    return spark.table(fqn).select("name", "check_id")


@query("sink_rule_files_two_runs", "K2", RULES_DUCK + "SELECT t AS \"table\", name FROM r, (VALUES ('events'), ('events_again')) v(t)")
def sink_rule_files_two_runs(spark, sf):
    # the second run writes another table's rules and, again, the first one's
    out = scratch_dir(spark, "rule-files")
    rules = _event_rules(spark, sf)
    write_rule_files(rules, out)
    write_rule_files(rules.withColumn("table_name", F.lit("events_again")).unionByName(rules), out)
    return read_rule_documents(spark, out).select(F.col("table_name").alias("table"), "name")


@query("sink_both_two_runs", "K3,K1", RULES_DUCK + "SELECT t AS table_name, name, CAST(1 AS BIGINT) AS copies, 'table' AS mode, t AS name_param "
       "FROM r, (VALUES ('events'), ('events_again')) v(t)")
def sink_both_two_runs(spark, sf):
    # two runs into one folder: the second stores its own rules only
    out = scratch_dir(spark, "both-twice")
    fqn = f"rf_rules_{uuid.uuid4().hex[:10]}.generated_checks"
    settings = rulegen.RulegenSettings(output_format="both", output_yaml=out + "/yaml", output_table=fqn, table_location=out + "/table")
    for name in ("events", "events_again"):
        rulegen.run(spark, [name], FULL, settings, reader=lambda t: fx.events_dirty(spark, sf))
    stored = F.filter("generator_meta", lambda m: m["section"] == "generator_settings")[0]["payload"]
    return (spark.table(fqn).groupBy("table_name", "name", stored["mode"].alias("mode"), stored["name_param"].alias("name_param"))
            .agg(F.count(F.lit(1)).alias("copies")))


PREVIEW_COLS = "o_orderkey,o_orderstatus,o_totalprice,o_orderdate"
PREVIEW_SCHEMA = "o_orderkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz"


def _export(spark, sf, fmt):
    pv = preview(table(spark, sf, "orders"), PREVIEW_COLS, where="o_orderstatus <> 'P'",
                 order_by="o_totalprice desc, o_orderkey")
    out = export_preview(pv, scratch_dir(spark, f"preview-{fmt}"), fmt)
    reader = spark.read.schema(PREVIEW_SCHEMA).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return reader.json(out) if fmt == "jsonl" else reader.option("header", True).csv(out)


EXPORT_DUCK = f"SELECT {PREVIEW_COLS} FROM orders WHERE o_orderstatus <> 'P'"  # every matching row


@query("sink_preview_jsonl", "K4", EXPORT_DUCK)
def sink_preview_jsonl(spark, sf):
    return _export(spark, sf, "jsonl")


@query("sink_preview_csv", "K4", EXPORT_DUCK)
def sink_preview_csv(spark, sf):
    return _export(spark, sf, "csv")
