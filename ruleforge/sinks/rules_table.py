"""The stored rules table (K1): create if absent, then append.

The schema is explicit (``RULES_TABLE_SCHEMA``) and column comments travel
in ``StructField`` metadata. Not-null fields are enforced inside the write
job itself (``raise_error`` in the projection), with no extra pass. Appends
do not de-duplicate: a rerun adds rows with the same ``check_id``.
Parquet format (no table-format library is assumed to be installed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.generate import RULES_TABLE_SCHEMA

COLUMN_COMMENTS = {
    "check_id": "Hash of check_id_payload; equal for equal rules of a table.",
    "check_id_payload": "What makes two rules the same, as sorted JSON.",
    "table_name": "Table whose rows are judged.",
    "name": "Name under which issues are reported.",
    "criticality": "Issues go to errors (error) or to warnings (warn).",
    "check": "Function, the columns it is repeated for, and its arguments as text.",
    "filter": "Rows to judge, as a SQL condition; all rows without one.",
    "run_config_name": "Group of rules that run together.",
    "user_metadata": "Notes that are copied to the issues.",
    "yaml_path": "Rule file, or the table of a generated rule.",
    "active": "Whether the rule is applied.",
    "generator_meta": "Options of the profile and of the run that made the rule.",
    "created_by": "Who made the row.",
    "created_at": "When the row was made (UTC).",
    "updated_by": "Who changed the row last.",
    "updated_at": "When the row was changed last (UTC).",
}


def documented_schema() -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable, {"comment": COLUMN_COMMENTS.get(f.name, "")})
                         for f in RULES_TABLE_SCHEMA.fields])


def _enforce_not_null(rows: DataFrame) -> DataFrame:
    cols = []
    for f in RULES_TABLE_SCHEMA.fields:
        c = F.col(f.name)
        if not f.nullable:
            c = F.when(c.isNull(), F.raise_error(F.lit(f"rules table: {f.name} must not be null"))
                       .cast(f.dataType)).otherwise(c)
        cols.append(c.alias(f.name))
    return rows.select(*cols)


def ensure_rules_table(spark: SparkSession, fqn: str, location: str | None = None) -> None:
    parts = fqn.split(".")
    if len(parts) >= 2:
        schema = ".".join(f"`{p}`" for p in parts[:-1])
        # with a table folder given, the schema's own folder sits next to it (not in a local warehouse)
        where = f" LOCATION '{location.rstrip('/')}.schema'" if location else ""
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}{where}")
    if not spark.catalog.tableExists(fqn):
        w = spark.createDataFrame([], documented_schema()).write.format("parquet").mode("overwrite")
        if location:
            w = w.option("path", location)
        w.saveAsTable(fqn)


def append_rules(spark: SparkSession, rows: DataFrame, fqn: str, location: str | None = None) -> None:
    ensure_rules_table(spark, fqn, location)
    _enforce_not_null(rows).write.format("parquet").mode("append").saveAsTable(fqn)
