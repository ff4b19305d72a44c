"""Exact top-n rows by an ordering, in one pass, without funnelling partitions × n rows into one task.

Spark plans ``orderBy(...).limit(n)`` as ``TakeOrderedAndProject``: every
partition keeps its own n best rows and all of them go to a single task. On
a table split into hundreds of thousands of partitions that task receives
partitions × n rows. ``top_k`` puts a level between: partitions are dealt to
``BUCKETS`` buckets, each bucket keeps its n best rows, and the last task
receives ``BUCKETS`` × n rows at most. Spark plans the ranking as
``WindowGroupLimit`` on both sides of its shuffle, so a task sends n rows.

Spark does so up to ``spark.sql.optimizer.windowGroupLimitThreshold`` rows; for
a larger n that setting of the session is raised to n, so that the plan is the
same for every n. It only chooses plans, never rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
_BUCKET, _RANK = "__rf_bucket", "__rf_rank"


def order_columns(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc() if desc else F.col(c).asc() for c, desc in order]


def top_k(df: DataFrame, order: Sequence[tuple[str, bool]], n: int) -> DataFrame:
    """The first ``n`` rows of ``df`` ordered by ``order`` = [(column, descending), ...]."""
    if not order:
        raise ValueError("top_k needs an ordering")
    n = int(n)
    if n <= 0:
        return df.limit(0)
    by = order_columns(order)
    conf = df.sparkSession.conf
    if n > int(conf.get(GROUP_LIMIT, "1000")):
        conf.set(GROUP_LIMIT, str(n))
    rank = F.row_number().over(Window.partitionBy(_BUCKET).orderBy(*by))
    best = (df.withColumn(_BUCKET, F.pmod(F.spark_partition_id(), F.lit(BUCKETS))).withColumn(_RANK, rank)
            .where(F.col(_RANK) <= n).drop(_BUCKET, _RANK))
    return best.orderBy(*by).limit(n)
