"""Queries for the dataset-level checks G1-G9 and the rule modifiers M1-M7."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators.dataset_checks import compare_report, freshness_windows
from ...plans.apply import apply_checks, summarize
from . import fixtures as fx
from .registry import query, table
from .row_level import EV_DUCK, checked, oracle, rule

LI_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("chk_unique", "G1",
       oracle("SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem", LI_KEYS,
              "n > 1", "order_line_unique"))
def chk_unique(spark, sf):
    return checked(table(spark, sf, "lineitem"),
                   [rule("is_unique", "order_line_unique", columns=["l_orderkey", "l_linenumber"])], LI_KEYS)


@query("chk_unique_nulls_distinct", "G1",
       oracle(f"SELECT *, count(*) OVER (PARTITION BY etype_null, user_id) AS n FROM ({EV_DUCK}) e", ["event_id"],
              "etype_null IS NOT NULL AND user_id IS NOT NULL AND n > 1", "type_user_unique"))
def chk_unique_nulls_distinct(spark, sf):
    return checked(fx.events_dirty(spark, sf),
                   [rule("is_unique", "type_user_unique", columns=["etype_null", "user_id"])], ["event_id"])


@query("chk_unique_nulls_equal", "G1",
       oracle(f"SELECT *, count(*) OVER (PARTITION BY etype_null, user_id) AS n FROM ({EV_DUCK}) e", ["event_id"],
              "n > 1", "type_user_unique"))
def chk_unique_nulls_equal(spark, sf):
    return checked(fx.events_dirty(spark, sf),
                   [rule("is_unique", "type_user_unique", columns=["etype_null", "user_id"], nulls_distinct=False)],
                   ["event_id"])


@query("chk_aggr_not_greater", "G2",
       oracle("SELECT *, count(o_orderkey) OVER (PARTITION BY o_custkey) AS n FROM orders", ["o_orderkey"],
              "n > 15", "orders_per_customer_max"))
def chk_aggr_not_greater(spark, sf):
    return checked(table(spark, sf, "orders"),
                   [rule("is_aggr_not_greater_than", "orders_per_customer_max", column="o_orderkey",
                         aggr_type="count", group_by=["o_custkey"], limit=15)], ["o_orderkey"])


@query("chk_aggr_not_less", "G3",
       oracle("SELECT *, avg(value) OVER (PARTITION BY user_id) AS a FROM events", ["event_id"],
              "a < 45", "user_avg_value_min"))
def chk_aggr_not_less(spark, sf):
    return checked(table(spark, sf, "events"),
                   [rule("is_aggr_not_less_than", "user_avg_value_min", column="value", aggr_type="avg",
                         group_by=["user_id"], limit=45)], ["event_id"])


@query("chk_aggr_equal", "G4",
       oracle("SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem", LI_KEYS,
              "n <> 4", "four_lines_per_order"))
def chk_aggr_equal(spark, sf):
    return checked(table(spark, sf, "lineitem"),
                   [rule("is_aggr_equal", "four_lines_per_order", aggr_type="count", group_by=["l_orderkey"],
                         limit=4)], LI_KEYS)


@query("chk_aggr_not_equal", "G5",
       oracle("SELECT *, min(o_orderdate) OVER (PARTITION BY o_orderstatus) AS m FROM orders", ["o_orderkey"],
              "m = o_orderdate", "not_first_order_of_status"))
def chk_aggr_not_equal(spark, sf):
    # the limit is a column of the row: fails on the rows holding their group's earliest date
    return checked(table(spark, sf, "orders"),
                   [rule("is_aggr_not_equal", "not_first_order_of_status", column="o_orderdate", aggr_type="min",
                         group_by=["o_orderstatus"], limit="o_orderdate")], ["o_orderkey"])


@query("chk_aggr_total", "G2",
       oracle("SELECT *, (SELECT sum(value) FROM events WHERE event_type = 'purchase') AS s FROM events", ["event_id"],
              "event_type = 'purchase' AND s > 1000", "purchase_total_cap"))
def chk_aggr_total(spark, sf):
    # no group_by: one scalar aggregate over the filtered rows (M1 on a dataset check)
    return checked(table(spark, sf, "events"),
                   [rule("is_aggr_not_greater_than", "purchase_total_cap", column="value", aggr_type="sum",
                         limit=1000, filter="event_type = 'purchase'")], ["event_id"])


FK_SQL = ("SELECT l.*, EXISTS (SELECT 1 FROM supplier s WHERE s.s_acctbal > 0 AND s.s_suppkey = l.l_suppkey) AS found "
          "FROM lineitem l")


@query("chk_foreign_key", "G6", oracle(FK_SQL, LI_KEYS, "l_suppkey IS NOT NULL AND NOT found", "supplier_in_credit"))
def chk_foreign_key(spark, sf):
    return checked(table(spark, sf, "lineitem"),
                   [rule("foreign_key", "supplier_in_credit", columns=["l_suppkey"], ref_columns=["s_suppkey"],
                         ref_df_name="suppliers")], LI_KEYS, refs={"suppliers": fx.suppliers_in_credit(spark, sf)})


@query("chk_foreign_key_negate", "G6",
       oracle(FK_SQL, LI_KEYS, "l_suppkey IS NOT NULL AND found", "supplier_not_in_credit"))
def chk_foreign_key_negate(spark, sf):
    return checked(table(spark, sf, "lineitem"),
                   [rule("foreign_key", "supplier_not_in_credit", columns=["l_suppkey"], ref_columns=["s_suppkey"],
                         ref_df_name="suppliers", negate=True)], LI_KEYS,
                   refs={"suppliers": fx.suppliers_in_credit(spark, sf)})


SQL_QUERY_TEXT = ("SELECT o.o_orderkey, c.c_acctbal < 0 OR o.o_totalprice > c.c_acctbal * 100 AS risky "
                  "FROM {{ input_view }} o JOIN {{customers}} c ON o.o_custkey = c.c_custkey")


@query("chk_sql_query", "G7",
       oracle("SELECT o.*, c.c_acctbal < 0 OR o.o_totalprice > c.c_acctbal * 100 AS risky "
              "FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey", ["o_orderkey"], "risky",
              "risky_customer_order"))
def chk_sql_query(spark, sf):
    return checked(table(spark, sf, "orders"),
                   [rule("sql_query", "risky_customer_order", query=SQL_QUERY_TEXT, merge_columns=["o_orderkey"],
                         condition_column="risky", input_placeholder="input_view")], ["o_orderkey"],
                   refs={"customers": table(spark, sf, "customer")})


ALT_DUCK = fx.duck(fx.CUSTOMERS_ALTERED, "customer", fx.CUSTOMERS_ALTERED_WHERE)
CMP_BASE = (f"WITH alt AS ({ALT_DUCK}), j AS (SELECT c.*, a.c_custkey AS a_key, "
            "concat_ws(',', CASE WHEN c.c_acctbal IS DISTINCT FROM a.c_acctbal THEN 'c_acctbal' END, "
            "CASE WHEN c.c_mktsegment IS DISTINCT FROM a.c_mktsegment THEN 'c_mktsegment' END, "
            "CASE WHEN c.c_name IS DISTINCT FROM a.c_name THEN 'c_name' END, "
            "CASE WHEN c.c_nationkey IS DISTINCT FROM a.c_nationkey THEN 'c_nationkey' END) AS diff "
            "FROM customer c LEFT JOIN alt a ON c.c_custkey IS NOT DISTINCT FROM a.c_custkey) ")
CMP_SELECT = ("SELECT c_custkey, c_name, CASE WHEN a_key IS NULL THEN 'extra' WHEN diff <> '' THEN 'changed' "
              "ELSE 'matched' END AS compare_status, CASE WHEN a_key IS NOT NULL AND diff <> '' THEN diff END "
              "AS changed_columns FROM j")


def _compare(spark, sf, missing: bool):
    cust = table(spark, sf, "customer")
    rep = compare_report(cust, fx.customers_altered(spark, sf), ["c_custkey"], ["c_custkey"],
                         check_missing_records=missing, status_col="compare_status",
                         changed_col="changed_columns")
    return rep.select("c_custkey", "c_name", "compare_status", "changed_columns")


@query("chk_compare", "G8", CMP_BASE + CMP_SELECT)
def chk_compare(spark, sf):
    return _compare(spark, sf, False)


@query("chk_compare_missing", "G8",
       CMP_BASE + CMP_SELECT + " UNION ALL SELECT a.c_custkey, CAST(NULL AS VARCHAR), 'missing', CAST(NULL AS VARCHAR) "
       "FROM alt a WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey IS NOT DISTINCT FROM a.c_custkey)")
def chk_compare_missing(spark, sf):
    return _compare(spark, sf, True)


@query("chk_compare_rule", "G8",
       CMP_BASE + "SELECT c_custkey, CASE WHEN a_key IS NULL OR diff <> '' THEN 'customers_match' END AS error_checks "
       "FROM j")
def chk_compare_rule(spark, sf):
    # the same comparison through the rule engine (check_missing_records off: input rows only)
    return checked(table(spark, sf, "customer"),
                   [rule("compare_datasets", "customers_match", columns=["c_custkey"], ref_columns=["c_custkey"],
                         ref_df_name="altered")], ["c_custkey"], refs={"altered": fx.customers_altered(spark, sf)})


@query("chk_compare_missing_rule", "G8",
       CMP_BASE + "SELECT c_custkey, CASE WHEN a_key IS NULL OR diff <> '' THEN 'customers_match' END AS error_checks FROM j "
       "UNION ALL SELECT a.c_custkey, 'customers_match' FROM alt a WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = a.c_custkey)")
def chk_compare_missing_rule(spark, sf):
    # through the rule engine, with the reference's missing records appended; the other rule doesn't judge those
    return checked(table(spark, sf, "customer"),
                   [rule("compare_datasets", "customers_match", columns=["c_custkey"], ref_columns=["c_custkey"], ref_df_name="altered",
                         check_missing_records=True), rule("is_not_null", "named", column="c_name")],
                   ["c_custkey"], refs={"altered": fx.customers_altered(spark, sf)})


@query("chk_fresh_per_window", "G9",
       oracle("SELECT *, count(*) OVER (PARTITION BY time_bucket(INTERVAL 60 MINUTE, ts)) AS n FROM events",
              ["event_id"], "n < 10", "hourly_arrivals"))
def chk_fresh_per_window(spark, sf):
    return checked(table(spark, sf, "events"),
                   [rule("is_data_fresh_per_time_window", "hourly_arrivals", column="ts", window_minutes=60,
                         min_records_per_window=10)], ["event_id"])


@query("chk_fresh_lookback", "G9",
       oracle("SELECT *, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 2880 MINUTE "
              "AND ts <= TIMESTAMP '2024-01-31 00:00:00') "
              "OVER (PARTITION BY time_bucket(INTERVAL 120 MINUTE, ts)) AS n FROM events", ["event_id"],
              "ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 2880 MINUTE "
              "AND ts <= TIMESTAMP '2024-01-31 00:00:00' AND n < 20", "two_hour_arrivals"))
def chk_fresh_lookback(spark, sf):
    return checked(table(spark, sf, "events"),
                   [rule("is_data_fresh_per_time_window", "two_hour_arrivals", column="ts", window_minutes=120,
                         min_records_per_window=20, lookback_windows=24, curr_timestamp=fx.NOW_FRESH)],
                   ["event_id"])


@query("chk_fresh_windows_report", "G9",
       "WITH c AS (SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS window_start, count(*) AS records FROM events "
       "GROUP BY 1), g AS (SELECT unnest(generate_series((SELECT min(window_start) FROM c), "
       "(SELECT max(window_start) FROM c), INTERVAL 60 MINUTE)) AS window_start) "
       "SELECT g.window_start, g.window_start + INTERVAL 60 MINUTE AS window_end, "
       "CAST(coalesce(c.records, 0) AS BIGINT) AS records, coalesce(c.records, 0) >= 10 AS fresh "
       "FROM g LEFT JOIN c ON g.window_start = c.window_start")
def chk_fresh_windows_report(spark, sf):
    return freshness_windows(table(spark, sf, "events"), "ts", 60, 10)


# ------------------------------------------------------------------ modifiers


@query("mod_filter", "M1",
       oracle("SELECT * FROM orders", ["o_orderkey"],
              "o_orderstatus = 'F' AND (o_totalprice < 50000 OR o_totalprice > 400000)", "finished_price_in_range"))
def mod_filter(spark, sf):
    return checked(table(spark, sf, "orders"),
                   [rule("is_in_range", "finished_price_in_range", column="o_totalprice", min_limit=50000,
                         max_limit=400000, filter="o_orderstatus = 'F'")], ["o_orderkey"])


@query("mod_criticality", "M2",
       "SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'price_cap' END AS error_checks, "
       "CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status_known' END AS warning_checks FROM orders")
def mod_criticality(spark, sf):
    rules = [rule("is_not_greater_than", "price_cap", "error", column="o_totalprice", limit=400000),
             rule("is_in_list", "status_known", "warning", column="o_orderstatus", allowed=["F", "O"])]
    return checked(table(spark, sf, "orders"), rules, ["o_orderkey"], warnings=True)


@query("mod_for_each", "M3",
       f"SELECT event_id, NULLIF(concat_ws(',', CASE WHEN etype_empty IS NULL OR etype_empty = '' "
       f"THEN 'present_etype_empty' END, CASE WHEN etype_null IS NULL OR etype_null = '' THEN 'present_etype_null' END),"
       f" '') AS error_checks FROM ({EV_DUCK}) e")
def mod_for_each(spark, sf):
    r = {"name": "present", "criticality": "error",
         "check": {"function": "is_not_null_and_not_empty", "for_each_column": ["etype_null", "etype_empty"],
                   "arguments": {}}}
    return checked(fx.events_dirty(spark, sf), [r], ["event_id"])


@query("mod_run_config_active", "M4,M5",
       oracle("SELECT * FROM part", ["p_partkey"], "p_size > 40", "nightly_size"))
def mod_run_config_active(spark, sf):
    rules = [dict(rule("is_not_greater_than", "nightly_size", column="p_size", limit=40), run_config_name="nightly"),
             dict(rule("is_not_greater_than", "nightly_price", column="p_retailprice", limit=0),
                  run_config_name="nightly", active=False),
             dict(rule("is_not_greater_than", "default_size", column="p_size", limit=1), run_config_name="default")]
    return summarize(apply_checks(table(spark, sf, "part"), rules, run_config_name="nightly"),
                     ["p_partkey"]).drop("warning_checks")


@query("mod_negate_msg", "M6,M7",
       "SELECT p_partkey, NULLIF(concat_ws(',', CASE WHEN p_size > 45 THEN 'big_part' END, "
       "CASE WHEN regexp_matches(p_brand, '^Brand#[1-5]$') THEN 'high_brand' END), '') AS error_checks, "
       "CASE WHEN p_size > 45 THEN 'part is big: owner=qa' END AS detail FROM part")
def mod_negate_msg(spark, sf):
    # negate flips a check; name/msg come from the arguments when the rule has no name
    rules = [rule("regex_match", "high_brand", column="p_brand", regex="^Brand#[1-5]$", negate=True),
             {"criticality": "error", "user_metadata": {"owner": "qa"},
              "check": {"function": "sql_expression",
                        "arguments": {"expression": "p_size > 45", "negate": True, "msg": "part is big",
                                      "name": "big_part"}}}]
    out = apply_checks(table(spark, sf, "part"), rules)
    item = F.get(F.filter(F.col("_errors"), lambda x: x["function"] == "sql_expression"), 0)
    names = F.array_join(F.array_sort(F.transform("_errors", lambda x: x["name"])), ",")
    return out.select("p_partkey", names.alias("error_checks"),
                      F.concat(item["message"], F.lit(": owner="), item["user_metadata"]["owner"]).alias("detail"))
