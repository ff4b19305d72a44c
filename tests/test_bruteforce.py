"""Dataset-level checks against plain-Python brute force on small random frames (NULL keys, duplicates)."""

import os
from collections import Counter, defaultdict

from hypothesis import given, settings, strategies as st

from ruleforge import apply_checks
from ruleforge.operators.dataset_checks import compare_report
from ruleforge.plans.apply import summarize

KEY = st.one_of(st.none(), st.integers(0, 3))
ROWS = st.lists(st.tuples(KEY, KEY, st.integers(-5, 5)), min_size=1, max_size=25)
SCHEMA = "id int, a int, b int, v int"
FAST = settings(max_examples=int(os.environ.get("BRUTE_EXAMPLES", "12")), deadline=None)  # more: BRUTE_EXAMPLES


def frame(spark, rows):
    return spark.createDataFrame([(i, a, b, v) for i, (a, b, v) in enumerate(rows)], SCHEMA)


def verdicts(df, rule, refs=None):
    out = summarize(apply_checks(df, [dict(rule, name="r", criticality="error")], refs), ["id"]).collect()
    return {r["id"]: r["error_checks"] is not None for r in out}


def test_unique_matches_brute_force(spark):
    @FAST
    @given(ROWS, st.booleans())
    def check(rows, nulls_distinct):
        counts = Counter((a, b) for a, b, _ in rows)
        expect = {i: (counts[(a, b)] > 1 and (not nulls_distinct or (a is not None and b is not None)))
                  for i, (a, b, _) in enumerate(rows)}
        got = verdicts(frame(spark, rows), {"check": {"function": "is_unique", "arguments": {
            "columns": ["a", "b"], "nulls_distinct": nulls_distinct}}})
        assert got == expect
    check()


def test_grouped_sum_matches_brute_force(spark):
    @FAST
    @given(ROWS, st.integers(-6, 6))
    def check(rows, limit):
        sums = defaultdict(int)
        for a, _, v in rows:
            sums[a] += v  # NULL group keys form one group
        expect = {i: sums[a] > limit for i, (a, _, _) in enumerate(rows)}
        got = verdicts(frame(spark, rows), {"check": {"function": "is_aggr_not_greater_than", "arguments": {
            "column": "v", "aggr_type": "sum", "group_by": ["a"], "limit": limit}}})
        assert got == expect
    check()


def test_foreign_key_matches_brute_force(spark):
    @FAST
    @given(ROWS, st.lists(KEY, max_size=6), st.booleans())
    def check(rows, ref_keys, negate):
        ref = spark.createDataFrame([(k,) for k in ref_keys] or [(None,)], "rk int")
        present = {k for k in ref_keys if k is not None}
        expect = {i: (a is not None and ((a in present) if negate else (a not in present)))
                  for i, (a, _, _) in enumerate(rows)}
        got = verdicts(frame(spark, rows), {"check": {"function": "foreign_key", "arguments": {
            "columns": ["a"], "ref_columns": ["rk"], "ref_df_name": "ref", "negate": negate}}}, {"ref": ref})
        assert got == expect
    check()


def test_compare_matches_brute_force(spark):
    pairs = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 2)), max_size=8)

    @FAST
    @given(pairs, pairs)
    def check(src_rows, ref_rows):
        src = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(src_rows)] or [(0, 0, 0)][:0],
                                    "id int, k int, v int")
        ref = spark.createDataFrame(ref_rows or [], "k int, v int")
        versions = defaultdict(set)
        for k, v in ref_rows:
            versions[k].add(v)
        expect = {}
        for i, (k, v) in enumerate(src_rows):
            vs = versions.get(k)
            if not vs:
                expect[i] = "extra"
            elif len(vs) > 1:
                expect[i] = "ambiguous"
            else:
                expect[i] = "matched" if v in vs else "changed"
        got = {r["id"]: r["_compare_status"] for r in compare_report(src, ref, ["k"], ["k"]).collect()}
        assert got == expect
        missing = sorted(k for k in versions if k not in {k2 for k2, _ in src_rows})
        rep = compare_report(src, ref, ["k"], ["k"], check_missing_records=True)
        assert sorted(r["k"] for r in rep.where("_compare_status = 'missing'").collect()) == missing
    check()


def test_fresh_per_window_matches_brute_force(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    base = dt.datetime(2024, 1, 1)

    @FAST
    @given(st.lists(st.one_of(st.none(), st.integers(0, 5 * 3600)), min_size=1, max_size=30),
           st.sampled_from([30, 60, 90]), st.integers(1, 4))
    def check(offsets, minutes, min_records):
        rows = [(i, None if o is None else base + dt.timedelta(seconds=o)) for i, o in enumerate(offsets)]
        df = spark.createDataFrame(rows, "id int, t timestamp").withColumn("t", F.col("t").cast("timestamp_ntz"))
        epoch0 = int((base - dt.datetime(1970, 1, 1)).total_seconds())
        bucket = {i: (epoch0 + o) // (60 * minutes) for i, o in enumerate(offsets) if o is not None}
        counts = Counter(bucket.values())
        expect = {i: (i in bucket and counts[bucket[i]] < min_records) for i in range(len(offsets))}
        got = verdicts(df, {"check": {"function": "is_data_fresh_per_time_window", "arguments": {
            "column": "t", "window_minutes": minutes, "min_records_per_window": min_records}}})
        assert got == expect
    check()


def test_no_check_drops_or_adds_rows(spark):
    """Every check keeps exactly the input rows, also when every column holds NULLs."""
    from pyspark.sql import functions as F

    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    dirty = ev.select(*[F.when(F.col("event_id") % 7 == i % 7, None).otherwise(F.col(c)).alias(c)
                        for i, c in enumerate(ev.columns)])
    ref = dirty.select(F.col("user_id").alias("uid")).where("uid % 2 = 0")
    q = "SELECT event_id, value > 100 AS bad FROM {{ input }}"
    rules = [
        {"function": "is_unique", "arguments": {"columns": ["user_id", "event_type"]}},
        {"function": "is_unique", "arguments": {"columns": ["user_id"], "nulls_distinct": False}},
        {"function": "is_aggr_not_greater_than", "arguments": {"column": "value", "aggr_type": "avg",
                                                               "group_by": ["event_type"], "limit": 50}},
        {"function": "is_aggr_equal", "arguments": {"aggr_type": "count", "limit": 3}},
        {"function": "foreign_key", "arguments": {"columns": ["user_id"], "ref_columns": ["uid"], "ref_df_name": "r"}},
        {"function": "sql_query", "arguments": {"query": q, "merge_columns": ["event_id"], "condition_column": "bad",
                                                "input_placeholder": "input"}},
        {"function": "compare_datasets", "arguments": {"columns": ["event_id"], "ref_columns": ["event_id"],
                                                       "ref_df_name": "d"}},
        {"function": "is_data_fresh_per_time_window", "arguments": {"column": "ts", "window_minutes": 60,
                                                                    "min_records_per_window": 2}},
    ]
    n = dirty.count()
    refs = {"r": ref, "d": dirty.where("event_id % 3 = 0")}
    for r in rules:
        out = apply_checks(dirty, [{"criticality": "error", "check": r}], refs)
        assert out.count() == n, r["function"]
    everything = apply_checks(dirty, [{"criticality": "warn", "check": r} for r in rules], refs)
    assert everything.count() == n


def test_profile_matches_brute_force(spark):
    from ruleforge.operators.generate import generate_rules
    from ruleforge.operators.options import ProfileOptions
    from ruleforge.operators.profile import profile
    from ruleforge.plans.rules import rules_from_documents

    texts = st.one_of(st.none(), st.sampled_from(["", " a", "a", "b ", "c", "  "]))
    nums = st.one_of(st.none(), st.integers(-3, 40))
    opts = ProfileOptions(sample_fraction=1.0, limit=None, remove_outliers=False, distinct_ratio=1.0)

    @FAST
    @given(st.lists(st.tuples(texts, nums), min_size=1, max_size=30))
    def check(rows):
        df = spark.createDataFrame(rows, "s string, x int")
        p = {r["column_name"]: r for r in profile(df, opts, table_name="t").collect()}
        ss = [None if s is None else s.strip() for s, _ in rows]
        xs = [x for _, x in rows]
        assert p["s"]["null_count"] == sum(s is None for s in ss)
        assert p["s"]["empty_count"] == sum(s == "" for s in ss)
        assert p["s"]["distinct_count"] == len({s for s in ss if s is not None})
        assert p["s"]["values"] == sorted({s for s in ss if s is not None})
        present = [x for x in xs if x is not None]
        assert p["x"]["null_count"] == len(xs) - len(present)
        assert (p["x"]["min"], p["x"]["max"]) == ((min(present), max(present)) if present else (None, None))
        # rules made from the whole table never fail on that table (outliers off, ratio permissive)
        rules = rules_from_documents(generate_rules(profile(df, opts, table_name="t"), opts))
        assert apply_checks(df, rules).where("_errors IS NOT NULL OR _warnings IS NOT NULL").count() == 0
    check()


def test_row_checks_match_brute_force(spark):
    import datetime as dt
    import ipaddress
    import re

    octet = st.one_of(st.integers(0, 300).map(str), st.sampled_from(["01", "x", ""]))
    ips = st.one_of(st.none(), st.lists(octet, min_size=3, max_size=5).map(".".join))
    dates = st.one_of(st.none(), st.tuples(st.integers(2023, 2024), st.integers(0, 13), st.integers(0, 32))
                      .map(lambda t: f"{t[0]}-{t[1]:02d}-{t[2]:02d}"))
    words = st.one_of(st.none(), st.sampled_from(["", "  ", "ab", " ab ", "Brand#3", "Brand#9", "x"]))
    nums = st.one_of(st.none(), st.integers(-5, 15))

    def valid_ip(s):
        parts = s.split(".")
        return len(parts) == 4 and all(re.fullmatch(r"0|[1-9][0-9]{0,2}", p) and int(p) <= 255 for p in parts)

    def valid_date(s):
        try:
            dt.date.fromisoformat(s)
            return True
        except ValueError:
            return False

    @FAST
    @given(st.lists(st.tuples(ips, dates, words, nums), min_size=1, max_size=30))
    def check(rows):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, ip string, d string, w string, n int")
        rules = {
            "range": ("is_in_range", {"column": "n", "min_limit": 0, "max_limit": 10},
                      lambda r: r[3] is not None and not 0 <= r[3] <= 10),
            "nne": ("is_not_null_and_not_empty", {"column": "w", "trim_strings": True},
                    lambda r: r[2] is None or r[2].strip() == ""),
            "list": ("is_in_list", {"column": "w", "allowed": ["ab", "x"]},
                     lambda r: r[2] is not None and r[2] not in ("ab", "x")),
            "rx": ("regex_match", {"column": "w", "regex": "^Brand#[1-5]$"},
                   lambda r: r[2] is not None and not re.search(r"^Brand#[1-5]$", r[2])),
            "rxn": ("regex_match", {"column": "w", "regex": "^Brand#[1-5]$", "negate": True},
                    lambda r: r[2] is not None and bool(re.search(r"^Brand#[1-5]$", r[2]))),
            "date": ("is_valid_date", {"column": "d", "date_format": "yyyy-MM-dd"},
                     lambda r: r[1] is not None and not valid_date(r[1])),
            "ip": ("is_valid_ipv4_address", {"column": "ip"}, lambda r: r[0] is not None and not valid_ip(r[0])),
            "cidr": ("is_ipv4_address_in_cidr", {"column": "ip", "cidr_block": "10.0.0.0/9"},
                     lambda r: r[0] is not None and (not valid_ip(r[0]) or
                                                     ipaddress.ip_address(r[0]) not in ipaddress.ip_network("10.0.0.0/9"))),
        }
        spec = [{"name": k, "criticality": "error", "check": {"function": f, "arguments": a}}
                for k, (f, a, _) in rules.items()]
        got = {r["id"]: set((r["error_checks"] or "").split(",")) - {""}
               for r in summarize(apply_checks(df, spec), ["id"]).collect()}
        for i, row in enumerate(rows):
            expect = {k for k, (_, _, fails) in rules.items() if fails(row)}
            assert got[i] == expect, (row, got[i], expect)
    check()
