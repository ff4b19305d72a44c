"""Dirty columns derived from the given tables (the tables themselves hold no
nulls, empties or broken text). Each derivation is one SQL select list that
both Spark and DuckDB accept, so the Spark frame and the oracle read the
same rows. Where the spellings differ, two texts are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import table

# Fixed clock values used by the time-based checks.
NOW_FUTURE = "2024-01-20 00:00:00"
NOW_FRESH = "2024-01-31 00:00:00"
TODAY_AGE = "2001-08-02"

EVENTS_DIRTY = [
    "event_id", "ts", "user_id", "event_type", "value", "props",
    "nullif(event_type, 'error') AS etype_null",
    "CASE WHEN event_type = 'click' THEN '' ELSE event_type END AS etype_empty",
    "concat('2024-', lpad(CAST(event_id % 14 AS string), 2, '0'), '-01') AS date_text",
    "concat('2024-', lpad(CAST(event_id % 14 AS string), 2, '0'), '-01 10:00:00') AS ts_text",
    "concat('10.', CAST(user_id % 256 AS string), '.', CAST(event_id % 300 AS string), '.1') AS ip_text",
]

CONVERSATIONS_PADDED = [
    "conv_id", "turn", "role", "text",
    "CASE WHEN turn % 3 = 0 THEN concat('  ', role, ' ') WHEN turn % 3 = 1 THEN '  ' ELSE role END AS role_padded",
]

EMBEDDINGS_DIRTY_SPARK = [
    "vec_id", "label",
    "CASE WHEN label = 0 THEN NULL WHEN label = 1 THEN slice(embedding, 1, 0) ELSE embedding END AS emb",
]
EMBEDDINGS_DIRTY_DUCK = [
    "vec_id", "label",
    "CASE WHEN label = 0 THEN NULL WHEN label = 1 THEN embedding[1:0] ELSE embedding END AS emb",
]

SUPPLIERS_IN_CREDIT = "s_acctbal > 0"

CUSTOMERS_ALTERED = [
    "CASE WHEN c_custkey % 50 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS c_custkey",
    "c_name", "c_nationkey",
    "CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal",
    "c_mktsegment",
]
CUSTOMERS_ALTERED_WHERE = "c_custkey % 10 <> 0 OR c_custkey % 50 = 0"

EVENT_LOG = [
    "concat('p', CAST(user_id % 5 AS string)) AS pipeline",
    "date_trunc('day', ts) AS update_id",
    "ts",
    "event_type AS flow_name",
]


def duck(select_list: list[str], source: str, where: str | None = None) -> str:
    """The DuckDB text of a derived frame, for use as a CTE body."""
    text = f"SELECT {', '.join(select_list)} FROM {source}"
    return text + (f" WHERE {where}" if where else "")


def events_dirty(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*EVENTS_DIRTY)


def conversations_padded(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").selectExpr(*CONVERSATIONS_PADDED)


def embeddings_dirty(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").selectExpr(*EMBEDDINGS_DIRTY_SPARK)


def suppliers_in_credit(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").where(SUPPLIERS_IN_CREDIT)


def customers_altered(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where(CUSTOMERS_ALTERED_WHERE).selectExpr(*CUSTOMERS_ALTERED)


def lineitem_orders(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    od = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return li.join(od, li.l_orderkey == od.o_orderkey, "inner").drop("o_orderkey")


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*EVENT_LOG)
