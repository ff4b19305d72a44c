"""Benchmark of the headline queries.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected); the time is the best of ``$BENCH_REPEAT`` runs (default 3)
after one unmeasured warm-up pass over all queries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def _sf_of(path: str) -> float | str:
    m = re.search(r"sf([0-9.]+)", path)
    return float(m.group(1)) if m else path


def headline(spark, sf):
    """name → callable returning a DataFrame (run with the noop sink)."""
    from pyspark.sql import functions as F

    from ruleforge import apply_checks
    from ruleforge.operators.dataset_checks import compare_report
    from ruleforge.operators.options import ProfileOptions
    from ruleforge.operators.profile import profile
    from ruleforge.plans.suite import REGISTRY
    from ruleforge.plans.suite import fixtures as fx
    from ruleforge.plans.suite.registry import table

    def li():
        return table(spark, sf, "lineitem")

    def rules20():
        r = []
        add = lambda fn, name, crit="error", **a: r.append(
            {"name": name, "criticality": crit, "check": {"function": fn, "arguments": a}})
        for c in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]:
            add("is_not_null", f"{c}_nn", column=c)
        add("is_in_range", "qty", column="l_quantity", min_limit=1, max_limit=50)
        add("is_in_range", "disc", column="l_discount", min_limit=0, max_limit=0.1)
        add("is_not_greater_than", "tax", column="l_tax", limit=0.08)
        add("is_not_less_than", "price", column="l_extendedprice", limit=1000)
        add("is_in_list", "flag", column="l_returnflag", allowed=["A", "N", "R"])
        add("is_not_null_and_is_in_list", "status", column="l_linestatus", allowed=["O", "F"])
        add("is_not_empty", "flag_ne", column="l_returnflag")
        add("regex_match", "flag_rx", column="l_returnflag", regex="^[ANR]$")
        add("sql_expression", "net", expression="l_extendedprice * (1 - l_discount) >= l_quantity")
        add("sql_expression", "line_pos", expression="l_linenumber > 0")
        add("is_valid_date", "ship_date", column="l_shipdate")
        add("is_not_in_future", "ship_not_future", "warn", column="l_shipdate", offset=0,
            curr_timestamp="2001-06-01 00:00:00")
        add("is_older_than_n_days", "ship_age", "warn", column="l_shipdate", days=30, curr_date="2001-11-30")
        add("is_not_in_range", "qty_not_1", "warn", column="l_quantity", min_limit=0, max_limit=1)
        add("is_data_fresh", "ship_fresh", "warn", column="l_shipdate", max_age_minutes=525600,
            base_timestamp="2001-11-30 00:00:00")
        return r

    full = ProfileOptions(sample_fraction=1.0, limit=None)
    qs = {
        "flagship_end_to_end": lambda: REGISTRY["apply_rules_end_to_end"].fn(spark, sf),
        "profile_lineitem_full": lambda: profile(li(), full, table_name="lineitem"),
        "profile_lineitem_default": lambda: profile(li(), ProfileOptions(sample_seed=7), table_name="lineitem"),
        "rules20_lineitem": lambda: apply_checks(li(), rules20()),
        "unique_lineitem_key": lambda: REGISTRY["chk_unique"].fn(spark, sf),
        "foreign_key_lineitem_orders": lambda: apply_checks(li(), [
            {"criticality": "error", "check": {"function": "foreign_key", "arguments": {
                "columns": ["l_orderkey"], "ref_columns": ["o_orderkey"], "ref_df_name": "orders"}}}],
            refs={"orders": table(spark, sf, "orders")}),
        "compare_orders": lambda: compare_report(
            table(spark, sf, "orders"),
            table(spark, sf, "orders").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0,
                                                                         F.col("o_totalprice") + 1)
                                                  .otherwise(F.col("o_totalprice")))
            .where(F.col("o_orderkey") % 10 != 1), ["o_orderkey"], ["o_orderkey"]),
        "compare_orders_missing": lambda: compare_report(
            table(spark, sf, "orders").where(F.col("o_orderkey") % 13 != 0), table(spark, sf, "orders"),
            ["o_orderkey"], ["o_orderkey"], check_missing_records=True),
        "fresh_window_events": lambda: REGISTRY["chk_fresh_per_window"].fn(spark, sf),
        "aggr_group_lineitem": lambda: REGISTRY["chk_aggr_equal"].fn(spark, sf),
        "pii_documents": lambda: REGISTRY["chk_pii"].fn(spark, sf),
        "dirty_events_profile": lambda: profile(fx.events_dirty(spark, sf), full, table_name="events"),
        # a third of lineitem's rows on one hot key: uniqueness, grouped aggregate and foreign key over it
        "hot_key_dataset_checks": lambda: apply_checks(
            li().withColumn("hk", F.when(F.col("l_partkey") % 3 == 0, F.lit(-1)).otherwise(F.col("l_orderkey"))),
            [{"criticality": "error", "check": {"function": "is_unique", "arguments": {"columns": ["hk", "l_linenumber"]}}},
             {"criticality": "warn", "check": {"function": "is_aggr_not_greater_than", "arguments": {
                 "column": "l_quantity", "aggr_type": "sum", "group_by": ["hk"], "limit": 500}}},
             {"criticality": "error", "check": {"function": "foreign_key", "arguments": {
                 "columns": ["hk"], "ref_columns": ["o_orderkey"], "ref_df_name": "orders"}}}],
            refs={"orders": table(spark, sf, "orders")}),
    }
    return qs


def main():
    from ruleforge.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": "16g"})
    qs = headline(spark, sf)
    # one unmeasured pass over every query first (JIT, code generation, file listing caches), so that
    # a query's time does not depend on its place in the list
    for fn in qs.values():
        fn().write.format("noop").mode("overwrite").save()
    times = {}
    for name, fn in qs.items():
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            fn().write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
                      "sf": _sf_of(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
