"""Dataset-level checks: null keys, grouping, references, no row multiplication."""

import datetime as dt

from pyspark.sql import functions as F

from ruleforge import apply_checks
from ruleforge.operators.dataset_checks import compare_report, freshness_windows, render_query
from ruleforge.plans.apply import summarize


def flags(df, rules, key="id", refs=None):
    out = summarize(apply_checks(df, rules, refs), [key]).orderBy(key).collect()
    return [r["error_checks"] is not None for r in out]


def rule(fn, **a):
    return {"name": "r", "criticality": "error", "check": {"function": fn, "arguments": a}}


def test_unique_null_keys(spark):
    # (NULL, NULL) x2 and (1, NULL) x2: no duplicates by default, duplicates when nulls are equal
    df = spark.createDataFrame([(1, None, None), (2, None, None), (3, 1, None), (4, 1, None), (5, 2, 2), (6, 2, 2), (7, 3, 3)],
                               "id int, a int, b int")
    assert flags(df, [rule("is_unique", columns=["a", "b"])]) == [False, False, False, False, True, True, False]
    assert flags(df, [rule("is_unique", columns=["a", "b"], nulls_distinct=False)]) == [True] * 6 + [False]


def test_aggregates_grouped_and_ungrouped(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (2, "x", 2.0), (3, "y", 10.0), (4, None, 5.0), (5, None, 5.0)],
                               "id int, g string, v double")
    assert flags(df, [rule("is_aggr_not_greater_than", column="v", aggr_type="sum", group_by=["g"], limit=5)]) == \
        [False, False, True, True, True]
    assert flags(df, [rule("is_aggr_not_less_than", aggr_type="count", group_by=["g"], limit=2)]) == \
        [False, False, True, False, False]
    assert flags(df, [rule("is_aggr_equal", column="v", aggr_type="max", limit=10)]) == [False] * 5
    assert flags(df, [rule("is_aggr_not_equal", column="v", aggr_type="min", group_by=["g"], limit="v")]) == \
        [True, False, True, True, True]
    # with a filter only filtered rows are aggregated and judged
    r = rule("is_aggr_not_greater_than", column="v", aggr_type="sum", limit=3)
    r["filter"] = "g = 'x'"
    assert flags(df, [r]) == [False] * 5


def test_foreign_key_null_and_negate(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, None), (4, 10)], "id int, k int")
    ref = spark.createDataFrame([(10,), (10,), (30,)], "rk int")  # duplicate reference keys do not multiply rows
    out = apply_checks(df, [rule("foreign_key", columns=["k"], ref_columns=["rk"], ref_df_name="ref")], {"ref": ref})
    assert out.count() == 4
    assert flags(df, [rule("foreign_key", columns=["k"], ref_columns=["rk"], ref_df_name="ref")], refs={"ref": ref}) == \
        [False, True, False, False]
    assert flags(df, [rule("foreign_key", columns=["k"], ref_columns=["rk"], ref_df_name="ref", negate=True)],
                 refs={"ref": ref}) == [True, False, False, True]


def test_sql_query_keys_reduced(spark):
    df = spark.createDataFrame([(1, 5), (2, 50), (3, 7)], "id int, v int")
    q = "SELECT id, v > 10 AS bad FROM {{ input }} UNION ALL SELECT id, false FROM {{input}} WHERE id = 2 " \
        "UNION ALL SELECT 1, v > 1000 FROM {{ input }} WHERE id = 1"
    r = rule("sql_query", query=q, merge_columns=["id"], condition_column="bad", input_placeholder="input")
    out = apply_checks(df, [r])
    assert out.count() == 3  # several query rows per key: still one row each
    assert flags(df, [r]) == [False, True, False]


def test_render_query_keeps_other_braces():
    text, names = render_query("SELECT * FROM {{ a }} WHERE x RLIKE '[0-9]{3}' AND y IN (SELECT k FROM {{b}})")
    assert names == ["a", "b"]
    assert text == "SELECT * FROM {a} WHERE x RLIKE '[0-9]{{3}}' AND y IN (SELECT k FROM {b})"


def test_compare_report(spark):
    src = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0), (4, "d", None)], "k int, s string, v double")
    ref = spark.createDataFrame([(1, "a", 1.0), (2, "b", 9.0), (5, "e", 5.0), (4, "d", None), (3, "c", 3.0), (3, "x", 3.0)],
                                "k int, s string, v double")
    rep = compare_report(src, ref, ["k"], ["k"], check_missing_records=True)
    got = {(r["k"], r["_compare_status"], r["_changed_columns"]) for r in rep.collect()}
    assert got == {(1, "matched", None), (2, "changed", "v"), (3, "ambiguous", None), (4, "matched", None),
                   (5, "missing", None)}
    rep2 = compare_report(src, ref, ["k"], ["k"], null_safe_column_value_matching=False)
    assert {r["k"]: r["_compare_status"] for r in rep2.collect()}[4] == "changed"


def test_fresh_per_window(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=m)) for i, m in enumerate([1, 2, 3, 61, 125, 126])]
    df = spark.createDataFrame(rows, "id int, t timestamp").withColumn("t", F.col("t").cast("timestamp_ntz"))
    r = rule("is_data_fresh_per_time_window", column="t", window_minutes=60, min_records_per_window=2)
    assert flags(df, [r]) == [False, False, False, True, False, False]
    rep = {r["window_start"].hour: r["records"] for r in freshness_windows(df, "t", 60).collect()}
    assert rep == {0: 3, 1: 1, 2: 2}
    # lookback: only the last two windows before now are judged
    r2 = rule("is_data_fresh_per_time_window", column="t", window_minutes=60, min_records_per_window=3,
              lookback_windows=2, curr_timestamp="2024-01-01 03:00:00")
    assert flags(df, [r2]) == [False, False, False, True, True, True]


def test_results_do_not_depend_on_partitioning(spark):
    df = spark.range(0, 2000).select(F.col("id").cast("int").alias("id"), (F.col("id") % 7).alias("g"),
                                     (F.col("id") % 13).alias("v"))
    rules = [rule("is_unique", columns=["g", "v"]),
             rule("is_aggr_not_greater_than", column="v", aggr_type="avg", group_by=["g"], limit=6)]
    a = sorted(summarize(apply_checks(df.repartition(1), rules), ["id"]).collect())
    b = sorted(summarize(apply_checks(df.repartition(7, "v"), rules), ["id"]).collect())
    assert a == b


def test_aggregates_with_same_grouping_share_one_join(spark):
    df = spark.range(0, 3000).select(F.col("id").cast("int").alias("id"), (F.col("id") % 11).alias("g"),
                                     (F.col("id") % 17).cast("double").alias("v"))
    rules = [rule("is_aggr_not_greater_than", column="v", aggr_type="avg", group_by=["g"], limit=8),
             rule("is_aggr_not_less_than", aggr_type="count", group_by=["g"], limit=273),
             rule("is_aggr_not_equal", column="v", aggr_type="max", group_by=["g"], limit=16)]
    for i, r in enumerate(rules):
        r["name"] = f"r{i}"
    together = apply_checks(df, rules)
    plan = together._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1
    one_by_one = None
    for r in rules:
        part = summarize(apply_checks(df, [r]), ["id"]).withColumnRenamed("error_checks", r["name"])
        one_by_one = part if one_by_one is None else one_by_one.join(part.drop("warning_checks"), "id")
    got = {row["id"]: row["error_checks"] for row in summarize(together, ["id"]).collect()}
    for row in one_by_one.collect():
        names = ",".join(n for n in ["r0", "r1", "r2"] if row[n] is not None) or None
        assert got[row["id"]] == names


def test_compare_exclude_and_null_keys(spark):
    src = spark.createDataFrame([(1, "a", 1.0), (None, "n", 2.0), (3, "c", 3.0)], "k int, s string, v double")
    ref = spark.createDataFrame([(1, "A", 1.0), (None, "n", 2.0), (3, "c", 4.0)], "k int, s string, v double")
    rep = {r["s"]: (r["_compare_status"], r["_changed_columns"])
           for r in compare_report(src, ref, ["k"], ["k"], exclude_columns=["s"]).collect()}
    assert rep == {"a": ("matched", None), "n": ("matched", None), "c": ("changed", "v")}
    strict = {r["s"]: r["_compare_status"]
              for r in compare_report(src, ref, ["k"], ["k"], null_safe_row_matching=False,
                                      check_missing_records=True).collect()}
    assert strict["n"] == "extra"  # a NULL key matches nothing when nulls are not equal
    assert sorted(r["_compare_status"] for r in compare_report(src, ref, ["k"], ["k"], null_safe_row_matching=False,
                                                               check_missing_records=True).collect()).count("missing") == 1


def test_foreign_key_by_table_name(spark):
    from ruleforge.plans.suite.io import register_tables
    tag = register_tables(spark, "/root/testdata/sf0.001")
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    r = rule("foreign_key", columns=["l_orderkey"], ref_columns=["o_orderkey"],
             ref_table=f"spark_catalog.{tag}_fact.orders")
    out = apply_checks(li, [r])
    assert out.count() == li.count() and out.where("_errors IS NOT NULL").count() == 0


def test_sql_query_negate(spark):
    df = spark.createDataFrame([(1, 5), (2, 50)], "id int, v int")
    q = "SELECT id, v > 10 AS ok FROM {{ t }}"
    r = rule("sql_query", query=q, merge_columns=["id"], condition_column="ok", input_placeholder="t", negate=True)
    assert flags(df, [r]) == [True, False]


def test_compare_accepts_column_objects(spark):
    src = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, v double")
    ref = spark.createDataFrame([(1, "a", 1.5), (2, "B", 2.0)], "rk int, s string, v double")
    rep = {r["k"]: r["_changed_columns"] for r in
           compare_report(src, ref, [F.col("k")], [F.col("rk")], exclude_columns=[F.col("s")]).collect()}
    assert rep == {1: "v", 2: None}


def test_unique_shares_the_aggregate_of_the_same_keys(spark):
    df = spark.createDataFrame([(1, 1, None, 5), (2, 1, None, 6), (3, 2, 2, 1), (4, 2, 2, 9), (5, 3, 1, 4),
                                (6, None, None, 2), (7, None, None, 3)], "id int, a int, b int, v int")
    for nulls_distinct in (True, False):
        uniq = rule("is_unique", columns=["a", "b"], nulls_distinct=nulls_distinct)
        aggr = rule("is_aggr_not_greater_than", column="v", aggr_type="sum", group_by=["a", "b"], limit=9)
        uniq["name"], aggr["name"] = "u", "s"
        together = apply_checks(df, [uniq, aggr])
        plan = together._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join LeftOuter") == 1
        got = {r["id"]: r["error_checks"] for r in summarize(together, ["id"]).collect()}
        alone_u = {r["id"]: r["error_checks"] for r in summarize(apply_checks(df, [uniq]), ["id"]).collect()}
        alone_s = {r["id"]: r["error_checks"] for r in summarize(apply_checks(df, [aggr]), ["id"]).collect()}
        for i in got:
            names = ",".join(n for n, d in (("s", alone_s), ("u", alone_u)) if d[i] is not None) or None
            assert got[i] == names, (nulls_distinct, i)
