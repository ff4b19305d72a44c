"""Row-level checks on small hand-made frames (null semantics, bounds, formats)."""

import datetime as dt

from pyspark.sql import functions as F

from ruleforge import apply_checks
from ruleforge.plans.apply import summarize


def run(spark, rows, schema, rule_fn, **args):
    df = spark.createDataFrame(rows, schema)
    rule = {"name": "r", "criticality": "error", "check": {"function": rule_fn, "arguments": args}}
    out = summarize(apply_checks(df, [rule]), ["id"]).orderBy("id").collect()
    return [r["error_checks"] == "r" for r in out]


def test_not_null_and_empty(spark):
    rows = [(1, "a"), (2, None), (3, ""), (4, "  ")]
    assert run(spark, rows, "id int, v string", "is_not_null", column="v") == [False, True, False, False]
    # null passes is_not_empty
    assert run(spark, rows, "id int, v string", "is_not_empty", column="v") == [False, False, True, False]
    assert run(spark, rows, "id int, v string", "is_not_null_and_not_empty", column="v") == [False, True, True, False]
    assert run(spark, rows, "id int, v string", "is_not_null_and_not_empty", column="v",
               trim_strings=True) == [False, True, True, True]


def test_lists(spark):
    rows = [(1, "A"), (2, "Z"), (3, None)]
    assert run(spark, rows, "id int, v string", "is_in_list", column="v", allowed=["A", "B"]) == [False, True, False]
    assert run(spark, rows, "id int, v string", "is_not_null_and_is_in_list", column="v",
               allowed=["A", "B"]) == [False, True, True]


def test_array(spark):
    rows = [(1, [1.0]), (2, []), (3, None)]
    assert run(spark, rows, "id int, v array<double>", "is_not_null_and_not_empty_array", column="v") == [False, True, True]


def test_ranges_inclusive(spark):
    rows = [(1, 0.0), (2, 1.0), (3, 5.0), (4, 10.0), (5, 11.0), (6, None)]
    s = "id int, v double"
    assert run(spark, rows, s, "is_in_range", column="v", min_limit=1, max_limit=10) == [True, False, False, False, True, False]
    assert run(spark, rows, s, "is_not_in_range", column="v", min_limit=1, max_limit=10) == [False, True, True, True, False, False]
    assert run(spark, rows, s, "is_not_less_than", column="v", limit=1) == [True, False, False, False, False, False]
    assert run(spark, rows, s, "is_not_greater_than", column="v", limit=10) == [False, False, False, False, True, False]


def test_limit_as_expression_and_column(spark):
    rows = [(1, 5.0, 4.0), (2, 5.0, 6.0)]
    s = "id int, v double, lim double"
    assert run(spark, rows, s, "is_not_greater_than", column="v", limit="lim") == [True, False]
    assert run(spark, rows, s, "is_not_greater_than", column="v", limit="lim * 2") == [False, False]


def test_dates_and_timestamps(spark):
    rows = [(1, "2024-01-31"), (2, "2024-13-01"), (3, None), (4, "x")]
    s = "id int, v string"
    assert run(spark, rows, s, "is_valid_date", column="v") == [False, True, False, True]
    assert run(spark, rows, s, "is_valid_date", column="v", date_format="yyyy-MM-dd") == [False, True, False, True]
    rows = [(1, "2024-01-31 10:00:00"), (2, "2024-01-31 25:00:00")]
    assert run(spark, rows, s, "is_valid_timestamp", column="v", timestamp_format="yyyy-MM-dd HH:mm:ss") == [False, True]


def test_future_and_age(spark):
    now = "2024-01-20 00:00:00"
    rows = [(1, dt.datetime(2024, 1, 19)), (2, dt.datetime(2024, 1, 20, 0, 0, 30)), (3, dt.datetime(2024, 1, 20, 2))]
    df = spark.createDataFrame(rows, "id int, t timestamp").withColumn("t", F.col("t").cast("timestamp_ntz"))
    def chk(fn, **a):
        r = {"name": "r", "criticality": "error", "check": {"function": fn, "arguments": a}}
        return [x["error_checks"] == "r" for x in summarize(apply_checks(df, [r]), ["id"]).orderBy("id").collect()]
    assert chk("is_not_in_future", column="t", offset=60, curr_timestamp=now) == [False, False, True]
    assert chk("is_not_in_near_future", column="t", offset=60, curr_timestamp=now) == [False, True, False]
    # exactly N minutes old passes
    assert chk("is_data_fresh", column="t", max_age_minutes=60 * 24, base_timestamp="2024-01-20 00:00:00") == [False, False, False]
    assert chk("is_data_fresh", column="t", max_age_minutes=60, base_timestamp="2024-01-20 00:00:00") == [True, False, False]
    assert chk("is_older_than_n_days", column="t", days=1, curr_date="2024-01-20") == [False, True, True]
    assert chk("is_older_than_n_days", column="t", days=1, curr_date="2024-01-20", negate=True) == [True, False, False]


def test_regex_negate_is_complement_on_non_null(spark):
    rows = [(1, "Brand#1"), (2, "Brand#7"), (3, None)]
    s = "id int, v string"
    plain = run(spark, rows, s, "regex_match", column="v", regex="^Brand#[1-5]$")
    neg = run(spark, rows, s, "regex_match", column="v", regex="^Brand#[1-5]$", negate=True)
    assert plain == [False, True, False] and neg == [True, False, False]


def test_ipv4_and_cidr(spark):
    rows = [(1, "10.1.2.3"), (2, "10.200.0.1"), (3, "256.1.1.1"), (4, "1.2.3"), (5, None), (6, "010.1.1.1")]
    s = "id int, v string"
    assert run(spark, rows, s, "is_valid_ipv4_address", column="v") == [False, False, True, True, False, True]
    # invalid addresses fail the CIDR check too
    assert run(spark, rows, s, "is_ipv4_address_in_cidr", column="v", cidr_block="10.0.0.0/9") == [False, True, True, True, False, True]


def test_sql_expression_passes_when_true(spark):
    rows = [(1, 5), (2, -1), (3, None)]
    s = "id int, v int"
    assert run(spark, rows, s, "sql_expression", expression="v > 0") == [False, True, False]
    assert run(spark, rows, s, "sql_expression", expression="v > 0", negate=True) == [True, False, False]


def test_pii(spark):
    rows = [(1, "write to ann@example.org"), (2, "nothing here"), (3, "call +1 555 123 4567 now")]
    assert run(spark, rows, "id int, v string", "contains_pii", column="v") == [True, False, True]


def test_filter_and_criticality(spark):
    df = spark.createDataFrame([(1, "F", 10.0), (2, "O", 10.0), (3, "F", 99.0)], "id int, s string, v double")
    rules = [{"name": "small", "criticality": "error", "filter": "s = 'F'",
              "check": {"function": "is_not_less_than", "arguments": {"column": "v", "limit": 50}}},
             {"name": "known", "criticality": "warning",
              "check": {"function": "is_in_list", "arguments": {"column": "s", "allowed": ["F"]}}}]
    out = summarize(apply_checks(df, rules), ["id"]).orderBy("id").collect()
    assert [(r["error_checks"], r["warning_checks"]) for r in out] == [("small", None), (None, "known"), (None, None)]


def test_for_each_and_run_config(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "y", None)], "id int, a string, b string")
    rules = [{"name": "nn", "criticality": "error", "run_config_name": "nightly",
              "check": {"function": "is_not_null", "for_each_column": ["a", "b"], "arguments": {}}},
             {"name": "off", "criticality": "error", "active": False,
              "check": {"function": "is_not_null", "arguments": {"column": "id"}}}]
    out = summarize(apply_checks(df, rules, run_config_name="nightly"), ["id"]).orderBy("id").collect()
    assert [r["error_checks"] for r in out] == ["nn_a", "nn_b"]
    assert summarize(apply_checks(df, rules, run_config_name="other"), ["id"]).where("error_checks is not null").count() == 0


def test_result_shape(spark):
    df = spark.createDataFrame([(1, None)], "id int, v string")
    rule = {"name": "r", "criticality": "error", "user_metadata": {"team": "qa"},
            "check": {"function": "is_not_null", "arguments": {"column": "v"}}}
    out = apply_checks(df, [rule])
    assert out.columns == ["id", "v", "_errors", "_warnings"]
    row = out.collect()[0]
    assert row["_warnings"] is None
    issue = row["_errors"][0]
    assert issue["name"] == "r" and issue["function"] == "is_not_null" and issue["user_metadata"] == {"team": "qa"}


def test_date_text_limits_are_literals(spark):
    rows = [(1, dt.date(2024, 1, 5)), (2, dt.date(2024, 2, 5))]
    assert run(spark, rows, "id int, v date", "is_not_greater_than", column="v", limit="2024-01-31") == [False, True]
    assert run(spark, rows, "id int, v date", "is_in_range", column="v", min_limit="2024-01-01",
               max_limit="2024-01-31 00:00:00") == [False, True]


def test_checking_twice_extends_issues(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, v string")
    r1 = {"name": "a", "criticality": "error", "check": {"function": "is_not_null", "arguments": {"column": "v"}}}
    r2 = {"name": "b", "criticality": "warn", "check": {"function": "is_in_list",
                                                        "arguments": {"column": "v", "allowed": ["y"]}}}
    twice = apply_checks(apply_checks(df, [r1]), [r2])
    assert twice.columns == ["id", "v", "_errors", "_warnings"]
    got = summarize(twice, ["id"]).orderBy("id").collect()
    assert [(r["error_checks"], r["warning_checks"]) for r in got] == [("a", None), (None, "b")]


def test_issue_summary(spark):
    from ruleforge import issue_summary
    df = spark.createDataFrame([(1, None, 5), (2, "x", 50), (3, None, 70)], "id int, v string, n int")
    rules = [{"name": "v_nn", "criticality": "error", "check": {"function": "is_not_null", "arguments": {"column": "v"}}},
             {"name": "n_cap", "criticality": "warn",
              "check": {"function": "is_not_greater_than", "arguments": {"column": "n", "limit": 10}}}]
    got = {(r["criticality"], r["name"]): r["failing_rows"] for r in issue_summary(apply_checks(df, rules)).collect()}
    assert got == {("error", "v_nn"): 2, ("warn", "n_cap"): 2}


def test_validate_rules(spark):
    from ruleforge import validate_rules
    good = {"name": "ok", "criticality": "warn", "check": {"function": "is_not_null", "arguments": {"column": "a"}}}
    bad = [{"name": "nofn", "check": {"arguments": {}}},
           {"name": "unknown", "check": {"function": "is_purple", "arguments": {}}},
           {"name": "badarg", "check": {"function": "is_in_range", "arguments": {"column": "a", "lo": 1}}},
           {"name": "crit", "criticality": "fatal", "check": {"function": "is_not_null", "arguments": {"column": "a"}}},
           {"name": "cidr", "check": {"function": "is_ipv4_address_in_cidr", "arguments": {"column": "a",
                                                                                         "cidr_block": "10.0.0.0/40"}}},
           {"name": "filt", "filter": "a = = 1", "check": {"function": "is_not_null", "arguments": {"column": "a"}}},
           {"name": "expr", "check": {"function": "sql_expression", "arguments": {"expression": "a >"}}}]
    assert validate_rules([good]) == []
    problems = validate_rules([good] + bad)
    assert [p.split(":")[0] for p in problems] == ["nofn", "unknown", "badarg", "crit", "cidr", "filt", "expr"]


def test_pii_numbers_with_a_wrong_digit_pass(spark):
    texts = ["card 4111 1111 1111 1111", "card 4111 1111 1111 1112", "4111-1111-1111-1111.", "5500000000000004", "5500000000000005", "378282246310005", "6011000990139424 x",
             "DE89370400440532013000", "DE88370400440532013000", "to GB82WEST12345698765432 now", "GB82WEST12345698765433", "FR1420041010050500013M02606", "NL91ABNA0417164300",
             "at 10.0.0.255", "at 10.0.0.256", "at 999.1.1.1", "call +49 30 1234567", "call 030 12 34", "12 345 678 901 234 567 890", "2024", "", None, "a@b.io", "4111111111111111 or 4111111111111112"]
    bad = {0, 2, 3, 5, 6, 7, 9, 11, 12, 13, 16, 22, 23}
    got = run(spark, list(enumerate(texts)), "id int, v string", "contains_pii", column="v")
    assert {i for i, fails in enumerate(got) if fails} == bad


def test_pii_checksums_against_plain_python(spark):
    import random
    rng, rows = random.Random(4), []
    for i in range(600):
        n = "".join(rng.choice("0123456789") for _ in range(rng.choice([13, 15, 16, 19])))
        total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(n)))
        country = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(2))
        body = "".join(rng.choice("0123456789ABCXYZ") for _ in range(rng.randrange(11, 31)))
        right = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        check = f"{right:02d}" if i % 3 else f"{(right + 1 + i) % 100:02d}"
        iban = country + check + body
        rows.append((i, n, total % 10 == 0, iban, int("".join(str(int(c, 36)) for c in body + country + check)) % 97 == 1))
    df = spark.createDataFrame(rows, "id int, card string, card_ok boolean, iban string, iban_ok boolean")
    from ruleforge.functions.row_checks import contains_pii
    for column in ("card", "iban"):
        got = {r["id"]: r["hit"] for r in df.select("id", contains_pii(column, kinds=[column]).fail.alias("hit")).collect()}
        assert got == {r[0]: r[2 if column == "card" else 4] for r in rows}


def test_pii_messages_name_the_kinds_found(spark):
    from ruleforge import apply_checks
    texts = ["card 4111 1111 1111 1111", "card 4111 1111 1111 1112", "at 10.0.0.255 or a@b.io", "GB82WEST12345698765432 and +49 30 1234567", "nothing"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, v string").repartition(2)
    rules = [{"name": n, "criticality": "error", "check": {"function": "contains_pii", "arguments": {"column": "v"}}} for n in ("p", "q")]
    got = {r["id"]: [i["message"].split(": ")[1] for i in r["_errors"] or []] for r in apply_checks(df, rules).collect()}
    assert got == {0: ["card"] * 2, 1: [], 2: ["email,ipv4"] * 2, 3: ["phone,iban"] * 2, 4: []}
