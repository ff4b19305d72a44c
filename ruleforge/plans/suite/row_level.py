"""Queries for the row-level checks C1-C22 (each through ``apply_checks``)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ...plans.apply import apply_checks, summarize
from . import fixtures as fx
from .registry import query, table


def checked(df: DataFrame, rules: list[dict], keys: list[str], refs=None, warnings: bool = False) -> DataFrame:
    out = summarize(apply_checks(df, rules, refs), keys)
    return out if warnings else out.drop("warning_checks")


def rule(function: str, name: str, criticality: str = "error", filter: str | None = None, **arguments) -> dict:
    r = {"name": name, "criticality": criticality, "check": {"function": function, "arguments": arguments}}
    if filter:
        r["filter"] = filter
    return r


def oracle(source: str, keys: list[str], fail_sql: str, name: str) -> str:
    return (f"SELECT {', '.join(keys)}, CASE WHEN coalesce({fail_sql}, false) THEN '{name}' END AS error_checks "
            f"FROM ({source}) t")


EV_DUCK = fx.duck(fx.EVENTS_DIRTY, "events")
CONV_DUCK = fx.duck(fx.CONVERSATIONS_PADDED, "conversations")
EMB_DUCK = fx.duck(fx.EMBEDDINGS_DIRTY_DUCK, "embeddings")
LIO_DUCK = ("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, o_orderdate "
            "FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
EV_KEYS = ["event_id"]
IPV4_DUCK = ("regexp_full_match(ip_text, '(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|"
             "[1-9]?[0-9])\\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])')")
IP_LONG_DUCK = ("(CAST(split_part(ip_text, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip_text, '.', 2) AS BIGINT) * 65536"
                " + CAST(split_part(ip_text, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip_text, '.', 4) AS BIGINT))")


@query("chk_not_null", "C1", oracle(EV_DUCK, EV_KEYS, "etype_null IS NULL", "etype_not_null"))
def chk_not_null(spark, sf):
    return checked(fx.events_dirty(spark, sf), [rule("is_not_null", "etype_not_null", column="etype_null")], EV_KEYS)


@query("chk_not_empty", "C2", oracle(EV_DUCK, EV_KEYS, "etype_empty = ''", "etype_not_empty"))
def chk_not_empty(spark, sf):
    return checked(fx.events_dirty(spark, sf), [rule("is_not_empty", "etype_not_empty", column="etype_empty")], EV_KEYS)


@query("chk_not_null_not_empty", "C3",
       oracle(CONV_DUCK, ["conv_id", "turn"], "role_padded IS NULL OR trim(role_padded) = ''", "role_present"))
def chk_not_null_not_empty(spark, sf):
    return checked(fx.conversations_padded(spark, sf),
                   [rule("is_not_null_and_not_empty", "role_present", column="role_padded", trim_strings=True)],
                   ["conv_id", "turn"])


@query("chk_in_list", "C4", oracle("SELECT * FROM orders", ["o_orderkey"],
                                   "o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O')", "status_known"))
def chk_in_list(spark, sf):
    return checked(table(spark, sf, "orders"),
                   [rule("is_in_list", "status_known", column="o_orderstatus", allowed=["F", "O"])], ["o_orderkey"])


@query("chk_not_null_in_list", "C5",
       oracle(EV_DUCK, EV_KEYS, "etype_null IS NULL OR etype_null NOT IN ('click', 'purchase', 'view')", "etype_listed"))
def chk_not_null_in_list(spark, sf):
    return checked(fx.events_dirty(spark, sf),
                   [rule("is_not_null_and_is_in_list", "etype_listed", column="etype_null",
                         allowed=["click", "purchase", "view"])], EV_KEYS)


@query("chk_array_not_empty", "C6", oracle(EMB_DUCK, ["vec_id"], "emb IS NULL OR len(emb) = 0", "emb_present"))
def chk_array_not_empty(spark, sf):
    return checked(fx.embeddings_dirty(spark, sf),
                   [rule("is_not_null_and_not_empty_array", "emb_present", column="emb")], ["vec_id"])


@query("chk_in_range", "C7", oracle("SELECT * FROM orders", ["o_orderkey"],
                                    "o_totalprice < 50000 OR o_totalprice > 400000", "price_in_range"))
def chk_in_range(spark, sf):
    return checked(table(spark, sf, "orders"),
                   [rule("is_in_range", "price_in_range", column="o_totalprice", min_limit=50000, max_limit=400000)],
                   ["o_orderkey"])


@query("chk_not_in_range", "C8", oracle("SELECT * FROM part", ["p_partkey"], "p_size BETWEEN 10 AND 20",
                                        "size_outside_band"))
def chk_not_in_range(spark, sf):
    return checked(table(spark, sf, "part"),
                   [rule("is_not_in_range", "size_outside_band", column="p_size", min_limit=10, max_limit=20)],
                   ["p_partkey"])


@query("chk_not_less", "C9", oracle("SELECT * FROM customer", ["c_custkey"], "c_acctbal < 0", "balance_not_negative"))
def chk_not_less(spark, sf):
    return checked(table(spark, sf, "customer"),
                   [rule("is_not_less_than", "balance_not_negative", column="c_acctbal", limit=0)], ["c_custkey"])


@query("chk_not_greater", "C10", oracle("SELECT * FROM part", ["p_partkey"], "p_retailprice > p_size * 20 + 900",
                                        "price_capped_by_size"))
def chk_not_greater(spark, sf):
    # the limit is an SQL expression over other columns of the row
    return checked(table(spark, sf, "part"),
                   [rule("is_not_greater_than", "price_capped_by_size", column="p_retailprice",
                         limit="p_size * 20 + 900")], ["p_partkey"])


@query("chk_valid_date", "C11", oracle(EV_DUCK, EV_KEYS, "date_text IS NOT NULL AND try_strptime(date_text, '%Y-%m-%d') IS NULL",
                                      "date_text_valid"))
def chk_valid_date(spark, sf):
    return checked(fx.events_dirty(spark, sf),
                   [rule("is_valid_date", "date_text_valid", column="date_text", date_format="yyyy-MM-dd")], EV_KEYS)


@query("chk_valid_timestamp", "C12",
       oracle(EV_DUCK, EV_KEYS, "ts_text IS NOT NULL AND try_strptime(ts_text, '%Y-%m-%d %H:%M:%S') IS NULL",
              "ts_text_valid"))
def chk_valid_timestamp(spark, sf):
    return checked(fx.events_dirty(spark, sf),
                   [rule("is_valid_timestamp", "ts_text_valid", column="ts_text",
                         timestamp_format="yyyy-MM-dd HH:mm:ss")], EV_KEYS)


@query("chk_not_future", "C13", oracle(EV_DUCK, EV_KEYS,
                                      f"ts > TIMESTAMP '{fx.NOW_FUTURE}' + INTERVAL 86400 SECOND", "ts_not_future"))
def chk_not_future(spark, sf):
    return checked(fx.events_dirty(spark, sf),
                   [rule("is_not_in_future", "ts_not_future", column="ts", offset=86400,
                         curr_timestamp=fx.NOW_FUTURE)], EV_KEYS)


@query("chk_not_near_future", "C14",
       oracle(EV_DUCK, EV_KEYS, f"ts > TIMESTAMP '{fx.NOW_FUTURE}' AND ts < TIMESTAMP '{fx.NOW_FUTURE}' + INTERVAL 172800 SECOND",
              "ts_not_near_future"))
def chk_not_near_future(spark, sf):
    return checked(fx.events_dirty(spark, sf),
                   [rule("is_not_in_near_future", "ts_not_near_future", column="ts", offset=172800,
                         curr_timestamp=fx.NOW_FUTURE)], EV_KEYS)


@query("chk_older_n_days", "C15",
       oracle("SELECT * FROM orders", ["o_orderkey"],
              f"date_diff('day', CAST(o_orderdate AS DATE), DATE '{fx.TODAY_AGE}') < 365", "order_year_old"))
def chk_older_n_days(spark, sf):
    return checked(table(spark, sf, "orders"),
                   [rule("is_older_than_n_days", "order_year_old", column="o_orderdate", days=365,
                         curr_date=fx.TODAY_AGE)], ["o_orderkey"])


@query("chk_older_col2", "C16",
       oracle(LIO_DUCK, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
              "date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) < 30", "shipped_month_after_order"))
def chk_older_col2(spark, sf):
    return checked(fx.lineitem_orders(spark, sf),
                   [rule("is_older_than_col2_for_n_days", "shipped_month_after_order", column1="o_orderdate",
                         column2="l_shipdate", days=30)], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("chk_regex", "C17", oracle("SELECT * FROM part", ["p_partkey"],
                                  "NOT regexp_matches(p_brand, '^Brand#[1-5]$')", "brand_low_digit"))
def chk_regex(spark, sf):
    return checked(table(spark, sf, "part"),
                   [rule("regex_match", "brand_low_digit", column="p_brand", regex="^Brand#[1-5]$")], ["p_partkey"])


@query("chk_ipv4", "C18", oracle(EV_DUCK, EV_KEYS, f"ip_text IS NOT NULL AND NOT {IPV4_DUCK}", "ip_valid"))
def chk_ipv4(spark, sf):
    return checked(fx.events_dirty(spark, sf), [rule("is_valid_ipv4_address", "ip_valid", column="ip_text")], EV_KEYS)


@query("chk_ipv4_cidr", "C19",
       oracle(EV_DUCK, EV_KEYS,
              f"ip_text IS NOT NULL AND (NOT {IPV4_DUCK} OR ({IP_LONG_DUCK} >> 23) <> (167772160 >> 23))", "ip_in_block"))
def chk_ipv4_cidr(spark, sf):
    return checked(fx.events_dirty(spark, sf),
                   [rule("is_ipv4_address_in_cidr", "ip_in_block", column="ip_text", cidr_block="10.0.0.0/9")], EV_KEYS)


@query("chk_sql_expression", "C20",
       oracle("SELECT * FROM lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
              "NOT (l_extendedprice * (1 - l_discount) >= l_quantity * 10)", "net_price_floor"))
def chk_sql_expression(spark, sf):
    return checked(table(spark, sf, "lineitem"),
                   [rule("sql_expression", "net_price_floor",
                         expression="l_extendedprice * (1 - l_discount) >= l_quantity * 10")],
                   ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("rule_typed_allowed", "R11,C4,C5",
       oracle(EV_DUCK, EV_KEYS, "event_type NOT IN ('click', 'view') OR etype_null IS NULL OR etype_null NOT IN ('click', 'purchase')", "x")
       .replace("'x'", "concat_ws(',', CASE WHEN event_type NOT IN ('click', 'view') THEN 'listed' END, "
                       "CASE WHEN etype_null IS NULL OR etype_null NOT IN ('click', 'purchase') THEN 'listed_json' END)"))
def rule_typed_allowed(spark, sf):
    # lists of values given as texts, with commas and as JSON
    return checked(fx.events_dirty(spark, sf), [rule("is_in_list", "listed", column="event_type", allowed="click, view"),
                                                rule("is_not_null_and_is_in_list", "listed_json", column="etype_null", allowed='["click", "purchase"]')], EV_KEYS)


# the same patterns and verifications, spelled in SQL
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
PII_VERIFIED_DUCK = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "true"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "list_max(list_transform(string_split(m, '.'), lambda p: p::INT)) <= 255"),
    (r"(?:\+|\b)\d[\d ().-]{7,}\d\b", rf"length({_DIGITS}) BETWEEN 9 AND 15 AND regexp_matches(m, '[^0-9]') AND NOT regexp_matches(m, '^\d+(\.\d+){{3}}$')"),
    (r"\b\d(?:[ -]?\d){12,18}\b",
     f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda d, i: CASE WHEN i % 2 = 1 THEN d::INT WHEN d::INT > 4 "
     "THEN d::INT * 2 - 9 ELSE d::INT * 2 END)) % 10 = 0"),
    (r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
     "list_reduce(list_transform(string_split(substr(m, 5) || substr(m, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT "
     "ELSE ascii(c) - 55 END), lambda r, v: (r * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"),
]


def pii_duck(column: str) -> str:
    return " OR ".join(f"len(list_filter(regexp_extract_all({column}, '{p}'), lambda m: {test})) > 0" for p, test in PII_VERIFIED_DUCK)


# Numbers built from the orders: a card number and an account number (three in four with a wrong check digit), and an address.
PII_NUMBERS = [
    "o_orderkey",
    "concat('card 4111 11', lpad(CAST(o_orderkey % 100 AS string), 2, '0'), ' 1111 11', lpad(CAST(o_custkey % 100 AS string), 2, '0'), '.') AS card_text",
    "concat('pay to DE', lpad(CAST(o_custkey % 97 AS string), 2, '0'), '37040044053201', lpad(CAST(o_orderkey % 10000 AS string), 4, '0')) AS iban_text",
    "concat('from 10.', CAST(o_custkey % 300 AS string), '.0.', CAST(o_orderkey % 300 AS string)) AS ip_text",
]


@query("chk_pii_checksums", "C21",
       "SELECT o_orderkey, NULLIF(concat_ws(',', " + ", ".join(f"CASE WHEN {pii_duck(c)} THEN '{c}' END" for c in ("card_text", "iban_text", "ip_text"))
       + "), '') AS error_checks FROM (" + fx.duck(PII_NUMBERS, "orders") + ") o")
def chk_pii_checksums(spark, sf):
    return checked(table(spark, sf, "orders").selectExpr(*PII_NUMBERS),
                   [rule("contains_pii", c, column=c) for c in ("card_text", "iban_text", "ip_text")], ["o_orderkey"])


@query("chk_pii", "C21", oracle("SELECT * FROM documents", ["doc_id"], pii_duck("text"), "text_without_pii"))
def chk_pii(spark, sf):
    return checked(table(spark, sf, "documents"), [rule("contains_pii", "text_without_pii", column="text")], ["doc_id"])


@query("chk_fresh", "C22", oracle(EV_DUCK, EV_KEYS, f"ts < TIMESTAMP '{fx.NOW_FRESH}' - INTERVAL 10080 MINUTE",
                                  "ts_fresh_week"))
def chk_fresh(spark, sf):
    return checked(fx.events_dirty(spark, sf),
                   [rule("is_data_fresh", "ts_fresh_week", column="ts", max_age_minutes=10080,
                         base_timestamp=fx.NOW_FRESH)], EV_KEYS)
