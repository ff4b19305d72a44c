"""Bounds beyond a double, padded values, appended rows, stored rules of several tables, late windows, large top-n."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ruleforge import apply_checks
from ruleforge.operators.generate import generate_rules, to_stored_rows
from ruleforge.operators.options import ProfileOptions
from ruleforge.operators.profile import profile
from ruleforge.plans.apply import summarize
from ruleforge.plans.rules import rules_dataframe, rules_from_documents

OPTS = ProfileOptions(remove_outliers=False, distinct_ratio=1.0)


def failing(df, rules):
    return apply_checks(df, rules).where("_errors IS NOT NULL OR _warnings IS NOT NULL").count()


@pytest.mark.parametrize("rounded", [True, False])
def test_bounds_of_large_integers_and_decimals_hold_their_own_rows(spark, rounded):
    opts = OPTS.with_(round=rounded)
    df = spark.range(50).select((F.lit(9223372036854775000) + F.col("id")).alias("big"),
                                (F.col("id").cast("decimal(20,2)") / 4 - 3).cast("decimal(20,2)").alias("price"))
    rules = rules_from_documents(generate_rules(profile(df, opts, table_name="t"), opts))
    texts = {r["name"]: r["check"]["arguments"]["expression"] for r in rules}
    assert texts["big_min_max"] == "`big` >= 9223372036854775000 AND `big` <= 9223372036854775049"
    assert texts["price_min_max"] == ("`price` >= -3 AND `price` <= 10" if rounded else "`price` >= -3.00 AND `price` <= 9.25")
    assert failing(df, rules) == 0
    beyond = spark.createDataFrame([(9223372036854775050, Decimal("10.25"))], df.schema)
    assert failing(beyond, rules) == 1


def test_value_lists_hold_the_padded_values_they_were_learned_from(spark):
    df = spark.range(100).select(F.when(F.col("id") % 2 == 0, "  a ").otherwise("b").alias("s"))
    rules = rules_from_documents(generate_rules(profile(df, OPTS, table_name="t"), OPTS))
    assert any(r["name"] == "s_is_in" for r in rules)
    assert failing(df, rules) == 0


def test_appended_rows_are_judged_by_their_comparison_alone(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    ref = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c")], "k int, v string")
    known = spark.createDataFrame([(1,), (2,)], "id int")
    rules = [{"name": "v_nn", "check": {"function": "is_not_null", "arguments": {"column": "v"}}},
             {"name": "cmp", "check": {"function": "compare_datasets", "arguments": {
                 "columns": ["k"], "ref_columns": ["k"], "ref_df_name": "r", "check_missing_records": True}}},
             {"name": "fk", "check": {"function": "foreign_key", "arguments": {
                 "columns": ["k"], "ref_columns": ["id"], "ref_df_name": "ids"}}}]
    for order in (rules, rules[::-1]):
        got = {r["k"]: r["error_checks"] for r in
               summarize(apply_checks(df, order, {"r": ref, "ids": known}), ["k"]).collect()}
        assert got == {1: None, 2: "cmp", 3: "cmp"}


def test_columns_that_hold_maps_are_not_compared(spark):
    df = spark.sql("SELECT 1 AS k, named_struct('m', map('a', 1)) AS s, 2 AS v")
    rule = {"name": "cmp", "check": {"function": "compare_datasets", "arguments": {
        "columns": ["k"], "ref_columns": ["k"], "ref_df_name": "r"}}}
    assert apply_checks(df, [rule], {"r": df}).where("_errors IS NULL").count() == 1


def test_stored_rules_of_several_tables_need_a_name(spark):
    def rules(column):
        return [{"name": f"{column}_nn", "check": {"function": "is_not_null", "arguments": {"column": column}}},
                {"name": "key", "check": {"function": "is_unique", "arguments": {}, "for_each_column": [[column, "n"]]}}]
    docs = rules_dataframe(spark, rules("a"), "t").unionByName(rules_dataframe(spark, rules("b"), "u"))
    stored = to_stored_rows(docs, "me", "2024-01-01T00:00:00Z")
    df = spark.createDataFrame([(1, 1), (1, 1), (None, 2)], "a int, n int")
    got = summarize(apply_checks(df, stored, table_name="t"), ["a"]).collect()
    assert sorted((r["a"] or 0, r["error_checks"]) for r in got) == [(0, "a_nn"), (1, "key_a_n"), (1, "key_a_n")]
    with pytest.raises(ValueError, match="table_name"):
        apply_checks(df, stored)


def test_windows_after_the_clock_are_not_judged(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 31, 0, 30),), (dt.datetime(2024, 2, 3),)], "ts timestamp_ntz")
    rule = {"name": "w", "check": {"function": "is_data_fresh_per_time_window", "arguments": {
        "column": "ts", "window_minutes": 60, "min_records_per_window": 5, "lookback_windows": 24,
        "curr_timestamp": "2024-01-31 01:00:00"}}}
    bad = apply_checks(df, [rule]).where("_errors IS NOT NULL").collect()
    assert [r["ts"] for r in bad] == [dt.datetime(2024, 1, 31, 0, 30)]


def test_moments_with_a_zone_are_compared_on_the_session_clock(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10, 30),)], "ts timestamp_ntz")
    noon = dt.datetime(2024, 1, 1, 12, 0, tzinfo=dt.timezone(dt.timedelta(hours=2)))  # 10:00 UTC
    assert failing(df, [{"check": {"function": "is_not_greater_than", "arguments": {"column": "ts", "limit": noon}}}]) == 1


def test_only_failing_groups_are_joined_back(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("g"), "id")
    rule = {"name": "n", "check": {"function": "is_aggr_not_greater_than", "arguments": {
        "column": "id", "limit": 10, "group_by": ["g"]}}}
    plan = apply_checks(df, [rule])._jdf.queryExecution().optimizedPlan().toString()
    assert "> 10" in "\n".join(line for line in plan.split("\n") if "Filter" in line)
    assert failing(df, [rule]) == 0


def test_top_n_beyond_the_group_limit_is_exact(spark):
    from ruleforge.operators.topk import top_k
    df = spark.range(0, 5000, 1, 20).select(((F.col("id") * 7919) % 5003).alias("v"))
    for n in (3, 1000, 1500):
        assert [r["v"] for r in top_k(df, [("v", True)], n).collect()] == [r["v"] for r in df.orderBy(F.desc("v")).limit(n).collect()]


@pytest.mark.parametrize("n", [300, 5000])
def test_top_n_is_limited_in_groups_for_every_n(spark, n):
    from ruleforge.operators.topk import top_k
    df = spark.range(0, 30000, numPartitions=40).select("id", ((F.col("id") * 7919) % 10007).alias("v"))
    got = top_k(df, [("v", True), ("id", False)], n)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in df.orderBy(F.desc("v"), "id").limit(n).collect()]


def test_a_text_is_no_list_of_values(spark):
    from ruleforge.functions.row_checks import is_in_list, is_not_null_and_is_in_list
    for check in (is_in_list, is_not_null_and_is_in_list):
        with pytest.raises(TypeError):
            check("c", "abc")
        with pytest.raises(ValueError):
            check("c", [])


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from ruleforge.session import ensure_checkpoint_dir

    def session(master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d, set=lambda k, v: None), sparkContext=context)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            ensure_checkpoint_dir(session(master))
    assert ensure_checkpoint_dir(session("local[2]")) and ensure_checkpoint_dir(session("local"))


def test_discovery_has_one_plan_node_for_all_schemas(spark):
    from ruleforge.plans.suite.io import register_tables
    from ruleforge.sources.discovery import discover_catalog
    tag = register_tables(spark, "/root/testdata/sf0.001")
    names = discover_catalog(spark, "spark_catalog")
    found = {r[0] for r in names.collect()}
    assert {f"spark_catalog.{tag}_dim.nation", f"spark_catalog.{tag}_fact.events"} <= found
    assert "Union" not in names._jdf.queryExecution().optimizedPlan().toString()
