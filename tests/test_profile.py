"""Profiles and generated rules, on the examples of the option texts."""

import pytest
from pyspark.sql import functions as F

from ruleforge import apply_checks
from ruleforge.operators.generate import generate_rules
from ruleforge.operators.options import FORM_PRESET, ProfileOptions
from ruleforge.operators.prepare import hash_sample, prepare
from ruleforge.operators.profile import histogram_categorical, profile
from ruleforge.plans.rules import rules_from_documents

FULL = ProfileOptions(sample_fraction=1.0, limit=None)


def rules_of(spark, df, opts=FULL):
    return {r["name"]: r["arguments"]["expression"] for r in generate_rules(profile(df, opts, table_name="t"), opts).collect()}


def test_rounding(spark):
    df = spark.createDataFrame([(x / 10,) for x in range(2, 99)], "v double")
    assert rules_of(spark, df, FULL.with_(remove_outliers=False))["v_min_max"] == "`v` >= 0 AND `v` <= 10"


def test_few_values_by_count_and_ratio(spark):
    df = spark.createDataFrame([(["A", "B", "C"][i % 3],) for i in range(90)], "status string")
    assert rules_of(spark, df)["status_is_in"] == "trim(`status`) IN ('A', 'B', 'C')"
    df2 = spark.createDataFrame([(f"v{i % 10}",) for i in range(1000)], "s string")
    assert "s_is_in" in rules_of(spark, df2)
    assert "s_is_in" not in rules_of(spark, df2, FULL.with_(distinct_ratio=0.005))


def test_rare_nulls_and_empties(spark):
    df = spark.createDataFrame([(None if i < 2 else i,) for i in range(5000)], "v int")
    assert "v_is_not_null" in rules_of(spark, df)
    df2 = spark.createDataFrame([("" if i < 50 else "x",) for i in range(10000)], "s string")
    assert rules_of(spark, df2)["s_is_not_null_or_empty"] == "`s` IS NOT NULL AND trim(`s`) <> ''"
    assert "s_is_not_null" not in rules_of(spark, df2)


def test_outliers(spark):
    rows = [(float(v),) for v in range(1, 101)] * 3 + [(5_000_000.0,)]
    df = spark.createDataFrame(rows, "amount double")
    assert rules_of(spark, df)["amount_min_max"] == "`amount` >= 1 AND `amount` <= 100"
    assert rules_of(spark, df, FULL.with_(remove_outliers=False))["amount_min_max"].endswith("<= 5000000")


def test_trim_length_and_value_bounds(spark):
    df = spark.createDataFrame([("  apple ",), ("a",), ("ok",), ("pear",)], "s string")
    p = profile(df, FULL.with_(min_length=3), table_name="t").collect()[0]
    assert p["values"] == ["apple", "pear"]
    df2 = spark.createDataFrame([(-5.0,), (-1.0,), (3.0,), (7.0,)], "v double")
    p2 = profile(df2, FULL.with_(min_value=0, remove_outliers=False), table_name="t").collect()[0]
    assert (p2["min"], p2["max"]) == (3.0, 7.0)


def test_histogram(spark):
    df = spark.createDataFrame([("A",)] * 300 + [("B",)] * 200 + [("C",)] * 5, "status string")
    got = {r["value"]: r["count"] for r in histogram_categorical(df, ["status"], FULL).collect()}
    assert got == {"A": 300, "B": 200, "C": 5}


def test_types_columns_and_empty_sample(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "i int, s string, d double")
    assert prepare(df, FULL.with_(profile_types=["double", "int"])).columns == ["i", "d"]
    assert prepare(df, FULL, columns=["s"]).columns == ["s"]
    with pytest.raises(ValueError):
        prepare(df, FULL, columns=["nope"])
    assert generate_rules(profile(df, FULL.with_(sample_fraction=0.0), table_name="t"), FULL).count() == 0


def test_sample_and_limit_are_repeatable(spark):
    df = spark.range(0, 5000).withColumn("v", F.col("id") % 97)
    a = hash_sample(df.repartition(3), 0.2, 11, ["id"]).select("id").collect()
    b = hash_sample(df.repartition(8), 0.2, 11, ["id"]).select("id").collect()
    assert sorted(a) == sorted(b) and 700 < len(a) < 1300
    # without a key rows are drawn one by one: equal rows don't stay or go together, and a map column will do
    few = spark.range(0, 5000).select((F.col("id") % 3).alias("v"), F.create_map(F.lit("k"), F.lit(1)).alias("m"))
    for seed in (1, 2, 3):
        got = hash_sample(few, 0.2, seed)
        assert 700 < got.count() < 1300 and got.select("v").distinct().count() == 3
    # with a key: the first rows in key order, whatever the partitioning
    keyed = ProfileOptions(sample_fraction=0.5, sample_seed=3, limit=100, sample_key=("id",))
    x = sorted(prepare(df.repartition(2), keyed).collect())
    y = sorted(prepare(df.repartition(5), keyed).collect())
    assert x == y and len(x) == 100
    # without a key: any 100 rows of the table, fixed for the run (checkpointed)
    plain = ProfileOptions(sample_fraction=0.5, sample_seed=3, limit=100)
    sampled = {tuple(r) for r in df.collect()}
    got = prepare(df.repartition(4), plain)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == 100 and set(rows) <= sampled and rows == [tuple(r) for r in got.collect()]


def test_generated_rules_hold_on_their_own_data(spark):
    # full sample, outliers off, ratio thresholds permissive: generated rules never fail on the data
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    opts = FULL.with_(remove_outliers=False, max_in_count=10, distinct_ratio=1.0)
    rules = rules_from_documents(generate_rules(profile(df, opts, table_name="orders"), opts))
    assert len(rules) >= 6
    out = apply_checks(df, rules)
    assert out.where("_errors IS NOT NULL OR _warnings IS NOT NULL").count() == 0


def test_form_preset_differs():
    assert FORM_PRESET.max_in_count == 20 and FORM_PRESET.remove_outliers is False
    assert ProfileOptions.from_dict({"max_in_count": 3, "unknown": 1, "outlier_columns": ["a"]}).outlier_columns == ("a",)


def test_wide_table_profile_in_chunks(spark):
    import ruleforge.operators.profile as prof
    df = spark.range(0, 300).select(*[((F.col("id") * (i + 1)) % (i + 3)).alias(f"c{i}") for i in range(12)])
    old = prof.STATS_CHUNK
    try:
        prof.STATS_CHUNK = 5
        chunked = {r["column_name"]: (r["null_count"], r["min"], r["max"], r["distinct_count"])
                   for r in profile(df, FULL, table_name="w").collect()}
    finally:
        prof.STATS_CHUNK = old
    whole = {r["column_name"]: (r["null_count"], r["min"], r["max"], r["distinct_count"])
             for r in profile(df, FULL, table_name="w").collect()}
    assert chunked == whole and len(whole) == 12


def test_profile_histograms(spark):
    df = spark.createDataFrame([("A", float(i % 10), i * 1.5) for i in range(300)] + [("B", 50.0, 7.0)] * 20
                               + [("C", 99.0, 8.0)] * 5, "status string, v double, w double")
    opts = FULL.with_(include_histograms=True, histogram_bins=4, remove_outliers=False)
    h = {r["column_name"]: r["histogram"] for r in profile(df, opts, table_name="t").collect()}
    assert h["status"] == {"A": 300, "B": 20, "C": 5}
    # few values: frequencies per value; many values: equal-width buckets over [min, max]
    assert len(h["v"]) == 12 and h["v"]["50.0"] == 20
    assert sum(h["w"].values()) == 325 and len(h["w"]) == 4 and h["w"]["0.0"] == 75 + 25
    assert "histogram" not in profile(df, FULL, table_name="t").columns


def test_dotted_column_names(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (None, "x")], "`a.b` int, `c d` string")
    p = {r["column_name"]: r for r in profile(df, FULL, table_name="t").collect()}
    assert p["a.b"]["null_count"] == 1 and p["a.b"]["max"] == 2.0 and p["c d"]["values"] == ["x", "y"]
    rules = generate_rules(profile(df, FULL, table_name="t"), FULL)
    out = apply_checks(df, rules_from_documents(rules))
    assert out.count() == 3


def test_distinct_counts_are_exact_or_missing(spark):
    from ruleforge.operators.options import ProfileOptions
    from ruleforge.operators.profile import profile
    df = spark.range(5000).selectExpr("id", "id % 4 AS few", "CAST(NULL AS int) AS none", "array(id) AS list", "CASE WHEN id < 31 THEN id % 31 ELSE 0 END AS edge")
    got = {r["column_name"]: r for r in profile(df, ProfileOptions(), table_name="t").collect()}
    assert got["id"]["distinct_count"] is None and abs(got["id"]["approx_distinct"] - 5000) < 500 and not got["id"]["distinct_exact"]
    assert got["few"]["distinct_count"] == 4 and got["few"]["values_note"] is None and got["none"]["distinct_count"] == 0 and got["none"]["values"] == []
    assert got["id"]["values_note"] == got["edge"]["values_note"] == "more than 30 different values" and got["edge"]["values"] is None
    assert "list" not in got or got["list"]["values_note"] == "values of this type are not listed"
    assert {r["column_name"]: r["distinct_count"] for r in profile(df, ProfileOptions(exact_distinct=True)).collect()}["id"] == 5000


def test_sketches_of_runs_merge(spark, tmp_path):
    from ruleforge.operators import sketches
    path = str(tmp_path / "store")
    for run, (lo, hi) in {"one": (0, 40000), "two": (20000, 60000), "one again": (0, 40000)}.items():
        df = spark.range(lo, hi).selectExpr("id", "CASE WHEN id % 10 = 0 THEN NULL ELSE concat(' k', id % 7, ' ') END AS k")
        sketches.store_sketches(sketches.column_sketches(df, "c.s.t", run.split()[0]), path)   # the third replaces the first
    sketches.store_sketches(sketches.column_sketches(spark.range(5), "c.s.u", "one"), path)
    got = {(r["table_name"], r["column_name"]): r for r in sketches.merged_distinct(sketches.stored_sketches(spark, path)).collect()}
    ids = got["c.s.t", "id"]
    assert ids["runs"] == 2 and ids["rows"] == 80000 and abs(ids["distinct_estimate"] - 60000) <= 4 * ids["relative_error"] * 60000
    assert got["c.s.t", "k"]["distinct_estimate"] == 7 and got["c.s.t", "k"]["nulls"] == 8000 and got["c.s.u", "id"]["distinct_estimate"] == 5
    wider = sketches.column_sketches(spark.range(40000).selectExpr("CAST(id AS string) AS id"), "c.s.t", "text")
    both = sketches.merged_distinct(sketches.stored_sketches(spark, path).where("table_name = 'c.s.t' AND column_name = 'id'").unionByName(wider)).first()
    assert both["distinct_estimate"] == ids["distinct_estimate"]


@pytest.mark.parametrize("keys, kind", [([0, 775807], "bigint"), ([None, 3, 775808, 5900000], "decimal(21,0)"), ([], "bigint")])
def test_bounds_beyond_bigint(spark, keys, kind):
    from ruleforge.plans.suite.profiling import bounds_frame
    orders = spark.createDataFrame([(k, 1.5) for k in keys], "o_orderkey bigint, o_totalprice double")
    frame = bounds_frame(orders).select("big")
    assert dict(frame.dtypes)["big"] == kind
    got = rules_of(spark, frame, FULL.with_(remove_outliers=False, round=False)).get("big_min_max")
    known = [9223372036854000000 + k for k in keys if k is not None]
    assert got == (f"`big` >= {min(known)} AND `big` <= {max(known)}" if known else None)
