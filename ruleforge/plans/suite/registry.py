"""Registry of the named queries run by ``__spark_entry__`` and the bench.

Every query is a callable ``(spark, sf_dir) -> DataFrame`` over the given
tables (or frames Spark derives from them), with an optional DuckDB SQL text
computing the same result. Column names match between the two.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    operator: str  # inventory id(s) the query covers, e.g. "C7" or "G1,M1"


REGISTRY: dict[str, Query] = {}


def query(name: str, operator: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, operator)
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
