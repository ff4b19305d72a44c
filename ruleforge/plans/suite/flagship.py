"""The flagship query: profile a table, generate rules, add authored rules, apply them all."""

from __future__ import annotations

from ...operators.generate import generate_rules
from ...operators.options import ProfileOptions
from ...operators.profile import profile
from ...plans.apply import apply_checks, summarize
from ...plans.rules import rules_from_documents
from .registry import query, table
from .row_level import rule

FLAGSHIP_OPTIONS = ProfileOptions(sample_fraction=1.0, limit=None)  # whole table, default thresholds

AUTHORED = [
    rule("is_in_list", "status_known", column="o_orderstatus", allowed=["F", "O"]),
    rule("is_in_range", "finished_price_in_range", column="o_totalprice", min_limit=50000, max_limit=400000,
         filter="o_orderstatus = 'F'"),
    rule("sql_expression", "price_floor", expression="o_totalprice > 1500"),
    rule("is_aggr_not_greater_than", "customer_order_cap", column="o_orderkey", aggr_type="count",
         group_by=["o_custkey"], limit=20),
]
NUMERIC = ["o_orderkey", "o_custkey", "o_totalprice"]


def _band(c: str) -> str:
    return (f"(SELECT floor(min(CASE WHEN {c} BETWEEN m - 3 * s AND m + 3 * s THEN {c} END)) AS lo, "
            f"ceil(max(CASE WHEN {c} BETWEEN m - 3 * s AND m + 3 * s THEN {c} END)) AS hi FROM orders, "
            f"(SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM orders) st) b_{c}")


FLAGSHIP_DUCK = (
    "SELECT o_orderkey, NULLIF(concat_ws(',', "
    "CASE WHEN n_cust > 20 THEN 'customer_order_cap' END, "
    "CASE WHEN o_orderstatus = 'F' AND (o_totalprice < 50000 OR o_totalprice > 400000) THEN 'finished_price_in_range' END, "
    "CASE WHEN NOT (o_totalprice > 1500) THEN 'price_floor' END, "
    "CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status_known' END), '') AS error_checks, "
    "NULLIF(concat_ws(',', "
    + ", ".join(f"CASE WHEN {c} < b_{c}.lo OR {c} > b_{c}.hi THEN '{c}_min_max' END" for c in NUMERIC)
    + "), '') AS warning_checks FROM (SELECT *, count(o_orderkey) OVER (PARTITION BY o_custkey) AS n_cust FROM orders) o, "
    + ", ".join(_band(c) for c in NUMERIC))


@query("apply_rules_end_to_end", "R1-R5,C4,C7,C20,G2,M1,M2", FLAGSHIP_DUCK)
def apply_rules_end_to_end(spark, sf):
    orders = table(spark, sf, "orders")
    generated = generate_rules(profile(orders, FLAGSHIP_OPTIONS, table_name="orders"), FLAGSHIP_OPTIONS,
                               criticality="warn")
    rules = rules_from_documents(generated) + AUTHORED
    return summarize(apply_checks(orders, rules), ["o_orderkey"])


@query("apply_stored_rules", "K1,R6,R7,M4,M5",
       "SELECT o_orderkey, NULLIF(concat_ws(',', "
       + ", ".join(f"CASE WHEN {c} < b_{c}.lo OR {c} > b_{c}.hi THEN '{c}_min_max' END" for c in NUMERIC)
       + "), '') AS warning_checks FROM orders o, " + ", ".join(_band(c) for c in NUMERIC))
def apply_stored_rules(spark, sf):
    """Generated rules appended to the rules table, read back from it and applied (the runner's path)."""
    import uuid

    from ...operators.generate import to_stored_rows
    from ...session import scratch_dir
    from ...sinks.rules_table import append_rules

    orders = table(spark, sf, "orders")
    generated = generate_rules(profile(orders, FLAGSHIP_OPTIONS, table_name="orders"), FLAGSHIP_OPTIONS,
                               criticality="warn")
    fqn = f"rf_rules_{uuid.uuid4().hex[:10]}.generated_checks"
    append_rules(spark, to_stored_rows(generated, "runner", "2024-01-01T00:00:00Z"), fqn,
                 scratch_dir(spark, "stored-rules"))
    stored = spark.table(fqn).where("table_name = 'orders'")
    return summarize(apply_checks(orders, stored), ["o_orderkey"]).drop("error_checks")
