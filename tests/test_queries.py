"""Registered queries against their DuckDB oracles on the smallest tables, and the entry smoke test."""

import duckdb
import pytest

import __spark_entry__ as entry
from scripts.oracle_check import TABLES, digest

from conftest import SF_SMALL

QUICK = ["chk_", "mod_", "prep_", "rule_is_in", "rule_check_id", "src_discover_catalog", "view_topk",
         "stream_row_checks", "apply_rules_end_to_end", "agg_value_list", "sink_rule_files"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["o_orderkey", "error_checks", "warning_checks"]
    assert df.count() == 1500


def test_every_query_has_a_callable_and_most_an_oracle():
    qs, oracles = {n for n in entry.queries() if n in entry.REGISTRY}, entry.oracle_sql()
    assert len(qs) >= 90
    assert set(oracles) <= set(entry.queries())
    assert len(set(qs) - set(oracles)) <= 2


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if any(n.startswith(p) for p in QUICK)))
def test_query_matches_oracle(spark, duck, name):
    sql = entry.oracle_sql().get(name)
    sdf = entry.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    if sql is None:
        return
    res = duck.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]
