"""Several dataset checks with one join-back, and comparison of tables by fingerprints."""

import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ruleforge.operators.dataset_checks import compare_report
from ruleforge.plans.apply import apply_checks


def rule(function, name, criticality="error", filter=None, **arguments):
    return {"name": name, "criticality": criticality, "filter": filter, "check": {"function": function, "arguments": arguments}}


RULES = [rule("is_unique", "a_unique", columns=["a"]),
         rule("is_unique", "ab_unique", "warn", columns=["a", "b"], nulls_distinct=False, filter="v > 2"),
         rule("is_aggr_not_greater_than", "b_sum", column="v", aggr_type="sum", group_by=["b"], limit=40),
         rule("is_aggr_not_less_than", "b_min", "warn", column="v", aggr_type="min", group_by=["b"], limit=1),
         rule("is_aggr_not_equal", "not_largest", "warn", column="v", aggr_type="max", group_by=["a"], limit="v"),
         rule("is_aggr_not_greater_than", "total", "warn", column="v", aggr_type="sum", limit=10),
         rule("foreign_key", "a_known", columns=["a"], ref_columns=["k"], ref_df_name="known"),
         rule("sql_query", "q", query="SELECT c, max(v) > 8 AS bad FROM {{ input_view }} GROUP BY c", merge_columns=["c"], condition_column="bad"),
         rule("is_data_fresh_per_time_window", "w", "warn", column="ts", window_minutes=60, min_records_per_window=3),
         rule("compare_datasets", "cmp", columns=["id"], ref_columns=["id"], ref_df_name="other"),
         rule("is_not_null", "v_given", column="v")]


def frames(spark, n=120):
    rng = random.Random(n)
    some = lambda *xs: rng.choice([None, *xs])
    rows = [(i, some("x", "y", "z"), some(*range(40)), some("p", "q"), some(*range(10)), f"2024-01-01 {rng.randrange(24):02d}:10:00", "pad" * 5) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, b string, a int, c string, v int, t string, pad string").withColumn("ts", F.col("t").cast("timestamp"))
    other = df.where("id % 5 <> 0").withColumn("v", F.when(F.col("id") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return df, {"known": spark.createDataFrame([(k,) for k in range(0, 40, 2)], "k int"), "other": other.unionByName(other.limit(1).withColumn("id", F.lit(9999).cast("long")))}


def plain(df):
    return sorted(((r["id"] or -1, sorted((i["name"], i["message"]) for i in r["_errors"] or []), sorted((i["name"], i["message"]) for i in r["_warnings"] or []))
                   for r in df.collect()), key=repr)


@pytest.mark.parametrize("row_key", [None, "id"])
@pytest.mark.parametrize("missing", [False, True])
def test_one_join_back_gives_the_same_rows(spark, row_key, missing):
    df, refs = frames(spark)
    rules = RULES + [rule("compare_datasets", "with_missing", "warn", columns=["id"], ref_columns=["id"], ref_df_name="other", check_missing_records=True)] * missing
    once = apply_checks(df, rules, refs, join_back="once", row_key=row_key)
    each = apply_checks(df, rules, refs)
    assert once.columns == each.columns and plain(once) == plain(each)
    assert plain(apply_checks(df, RULES[-1:], refs, join_back="once")) == plain(apply_checks(df, RULES[-1:], refs))


def test_rows_that_are_alike_stay_apart(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(2, 2)], "id int, v int")
    rules = [rule("is_unique", "u", columns=["id"]), rule("is_aggr_equal", "e", aggr_type="count", group_by=["v"], limit=3)]
    got = apply_checks(df, rules, join_back="once")
    assert plain(got) == plain(apply_checks(df, rules)) and got.count() == 4


def wide_exchanges(df):
    """Exchanges of the plan that carry the input's payload column."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = df._jdf.queryExecution().executedPlan()
    found, todo = 0, [out]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        if "Exchange" in node.nodeName() and "pad" in node.output().toString():
            found += 1
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert plan
    return found


def test_four_checks_move_the_wide_input_once(spark):
    df, refs = frames(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        four = [RULES[0], RULES[2], RULES[6], rule("is_aggr_equal", "c_count", aggr_type="count", group_by=["c"], limit=3)]
        assert wide_exchanges(apply_checks(df.repartition(3), four, refs)) >= 4
        assert wide_exchanges(apply_checks(df.repartition(3), four, refs, join_back="once")) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


# ------------------------------------------------------------------ comparison
def plain_compare(rows, ref, null_keys, null_values, missing):
    """By the definition, row by row; rows are (key, a, b)."""
    same = lambda x, y: (x is None and y is None and null_values) or (x is not None and y is not None and (x == y or x != x and y != y))
    by_key = defaultdict(list)
    for k, *values in ref:
        by_key[k].append(values)
    alike = lambda x, y: x is None and y is None or (x is not None and y is not None and (x == y or x != x and y != y))
    out = []
    for k, *values in rows:
        versions = by_key.get(k, []) if k is not None or null_keys else []
        if not versions:
            out.append((k, "extra", None))
        elif any(not all(map(alike, versions[0], v)) for v in versions):
            out.append((k, "ambiguous", None))
        else:
            names = [n for n, x, y in zip("ab", values, versions[0]) if not same(x, y)]
            out.append((k, "changed", ",".join(names)) if names else (k, "matched", None))
    if missing:
        have = {k for k, *_ in rows if k is not None or null_keys}
        out += [(k, "missing", None) for k in by_key if k not in have]
    return sorted(out, key=repr)


@pytest.mark.parametrize("null_keys", [True, False])
@pytest.mark.parametrize("null_values", [True, False])
@pytest.mark.parametrize("missing", [True, False])
def test_comparison_is_the_definition(spark, null_keys, null_values, missing):
    rng = random.Random(5)
    pick = lambda: (rng.choice([None, 1.5, -0.0, 0.0, math.nan]), rng.choice([None, "s", "", "None"]))
    rows = [(rng.choice([None, *range(25)]), *pick()) for _ in range(60)]
    ref = [(k, *v) for k, *v in rows if rng.random() < 0.5] + [(rng.choice([None, *range(40)]), *pick()) for _ in range(15)]
    schema = "k int, a double, b string"
    got = compare_report(spark.createDataFrame(rows, schema), spark.createDataFrame(ref, schema.replace("int", "long")).withColumnRenamed("k", "rk"), ["k"], ["rk"],
                         check_missing_records=missing, null_safe_row_matching=null_keys, null_safe_column_value_matching=null_values)
    assert sorted(((r["k"], r["_compare_status"], r["_changed_columns"]) for r in got.collect()), key=repr) == plain_compare(rows, ref, null_keys, null_values, missing)


def test_values_that_hash_alike_and_types_that_differ(spark):
    left = spark.createDataFrame([(1, None, "x", [None, 1], 5, "7"), (2, "x", None, [1, None], 2, "8"), (3, "q", "q", [], 3, "9")], "k int, a string, b string, l array<int>, n int, s string")
    right = spark.createDataFrame([(1, "x", None, [1, None], 5.0, 7), (2, "x", None, [1, None], 2.5, 8), (3, "q", "q", [], 3.0, 9)], "k int, a string, b string, l array<int>, n double, s int")
    got = {r["k"]: (r["_compare_status"], r["_changed_columns"]) for r in compare_report(left, right, ["k"], ["k"]).collect()}
    assert got == {1: ("changed", "a,b,l"), 2: ("changed", "n"), 3: ("matched", None)}


def test_comparison_plan(spark):
    df, refs = frames(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
        report = compare_report(df, refs["other"], ["id"], ["id"], check_missing_records=True)
        report.collect()
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
        # one narrow aggregation for verdicts and missing keys: its shuffle is used again
        assert re.search(r"HashAggregate\(keys=\[__rf_rk0_cmp#\d+L?, apart#\d+\]", plan) and "ReusedExchange" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
