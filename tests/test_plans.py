"""Plan properties every registered query keeps: no all-pairs joins, no window operators,
rule projections inside whole-stage codegen, filters and columns pushed into scans."""

import pytest

import __spark_entry__ as entry

from conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "Window", "WindowGroupLimit")
# these run their work eagerly (streams, writes) and return a re-read of the result
EAGER = ("stream_", "sink_", "src_rule_documents")


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in entry.REGISTRY if not n.startswith(EAGER)))
def test_no_all_pairs_and_no_windows(spark, name):
    text = plan_text(entry.queries()[name](spark, SF_SMALL))
    operators = [line.lstrip(" :+-*()0123456789").split(" ")[0] for line in text.split("\n")]
    for op in FORBIDDEN:
        if name == "view_topk" and op in ("Window", "WindowGroupLimit"):
            continue  # ranks bounded buckets of partitions
        assert op not in operators, f"{name} plans {op}"


def test_rule_projection_is_code_generated(spark):
    from ruleforge import apply_checks
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    rules = [{"name": f"r{i}", "criticality": "error" if i % 2 else "warn",
              "check": {"function": "is_in_range", "arguments": {"column": "l_quantity", "min_limit": i,
                                                                 "max_limit": 50}}} for i in range(12)]
    text = plan_text(apply_checks(li, rules))
    projects = [line for line in text.split("\n") if "Project [" in line]
    assert projects and all(line.lstrip(" :+-").startswith("*(") for line in projects), projects


def test_filters_and_columns_reach_the_scan(spark):
    from ruleforge import apply_checks
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    sup = spark.read.parquet(f"{SF_SMALL}/supplier.parquet").where("s_acctbal > 0")
    out = apply_checks(li.select("l_orderkey", "l_suppkey"), [
        {"criticality": "error", "check": {"function": "foreign_key", "arguments": {
            "columns": ["l_suppkey"], "ref_columns": ["s_suppkey"], "ref_df_name": "s"}}}], refs={"s": sup})
    text = plan_text(out)
    assert "PushedFilters: [IsNotNull(s_acctbal), GreaterThan(s_acctbal,0.0)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in text


def test_hot_key_is_split_by_aqe(spark):
    """One key holding a third of the rows: the join-back's skewed partition is split into several tasks."""
    from pyspark.sql import functions as F

    from ruleforge import apply_checks
    from ruleforge.plans.apply import summarize

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
            "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        n = 30000
        df = spark.range(0, n).select(
            F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"),
            F.lit("payload-text-to-make-rows-wide").alias("pad"))
        ref = spark.range(0, n, 2).select(F.col("id").alias("rk"))
        rules = [{"name": "u", "criticality": "error", "check": {"function": "is_unique", "arguments": {"columns": ["k"]}}},
                 {"name": "fk", "criticality": "warn", "check": {"function": "foreign_key", "arguments": {
                     "columns": ["k"], "ref_columns": ["rk"], "ref_df_name": "r"}}}]
        res = summarize(apply_checks(df, rules, {"r": ref}), ["id", "k"])
        rows = res.collect()
        plan = res._jdf.queryExecution().executedPlan().toString()  # the final adaptive plan
        assert "SortMergeJoin(skew=true)" in plan
        assert len(rows) == n
        # every row of the hot key (the multiples of 3, and row 7 itself) is a duplicate
        assert sum(r["error_checks"] == "u" for r in rows) == n // 3 + 1
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
