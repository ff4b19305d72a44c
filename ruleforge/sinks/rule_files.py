"""Rule files (K2): one folder of YAML per table, written by executors.

Each rule is rendered to a YAML list item by Column expressions; scalars are
JSON strings (valid YAML double-quoted scalars, so quotes, newlines and
non-ASCII text round-trip). Rows are repartitioned by table and written with
``partitionBy``: every table gets its own folder whose part files are each a
valid YAML list of that table's rules. No rule text passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_DIR_COLUMN = "table"
KEY_ORDER = "table_name,name,criticality,run_config_name,check,filter,user_metadata"  # of a rule document
MANIFESTS = "_manifests"  # Spark's readers pass over folders that begin with an underscore
MANIFEST_SCHEMA = "`table` string, path string, bytes long, sha256 string, rules long"


def yaml_scalar(col: Column) -> Column:
    """A text value as a YAML scalar (a JSON string), ``null`` for NULL."""
    js = F.to_json(F.array(col.cast("string")))
    return F.coalesce(F.substring(js, F.lit(2), F.length(js) - 2), F.lit("null"))


def _map_block(col: Column, indent: str) -> Column:
    entries = F.array_sort(F.map_entries(col))
    lines = F.transform(entries, lambda e: F.concat(F.lit(indent), yaml_scalar(e["key"]), F.lit(": "),
                                                    yaml_scalar(e["value"])))
    return F.array_join(lines, "\n")


def rule_yaml(rules: DataFrame) -> Column:
    """One YAML list item per rule, keys in the order of a rule document."""
    has = set(rules.columns)
    parts = []
    if "table_name" in has:
        parts.append(F.when(F.col("table_name").isNotNull(),
                            F.concat(F.lit("- table_name: "), yaml_scalar(F.col("table_name")), F.lit("\n  "))))
    parts.append(F.concat(F.lit("name: "), yaml_scalar(F.col("name")), F.lit("\n"),
                          F.lit("  criticality: "), yaml_scalar(F.col("criticality")), F.lit("\n"),
                          F.lit("  run_config_name: "), yaml_scalar(F.col("run_config_name")), F.lit("\n"),
                          F.lit("  check:\n    function: "), yaml_scalar(F.col("function"))))
    if "for_each_column" in has:
        parts.append(F.when(F.size("for_each_column") > 0, F.concat(
            F.lit("\n    for_each_column:\n"),
            F.array_join(F.transform("for_each_column", lambda c: F.concat(F.lit("    - "), yaml_scalar(c))), "\n"))))
    parts.append(F.when(F.size("arguments") > 0, F.concat(F.lit("\n    arguments:\n"),
                                                          _map_block(F.col("arguments"), "      "))))
    if "filter" in has:
        parts.append(F.when(F.col("filter").isNotNull(), F.concat(F.lit("\n  filter: "), yaml_scalar(F.col("filter")))))
    if "user_metadata" in has:
        parts.append(F.when(F.size("user_metadata") > 0, F.concat(F.lit("\n  user_metadata:\n"),
                                                                  _map_block(F.col("user_metadata"), "    "))))
    body = F.concat_ws("", *parts)
    first = F.when(F.col("table_name").isNotNull(), F.lit("")).otherwise(F.lit("- ")) if "table_name" in has \
        else F.lit("- ")
    return F.concat(first, body, F.lit("\n"))


def _table_column(rules: DataFrame, table_col: str | None) -> Column:
    key = table_col or ("source_table" if "source_table" in rules.columns else "table_name")
    return F.coalesce(F.col(key), F.lit("unknown")).alias(TABLE_DIR_COLUMN)


def write_rule_files(rules: DataFrame, out_dir: str, table_col: str | None = None) -> str:
    """Write rules as YAML under ``out_dir/table=<name>/``; returns ``out_dir``.

    Only the folders of the tables that these rules belong to are replaced.
    """
    docs = rules.select(_table_column(rules, table_col), rule_yaml(rules).alias("value"))
    (docs.repartition(TABLE_DIR_COLUMN).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(TABLE_DIR_COLUMN)
     .option("lineSep", "\n").text(out_dir))
    return out_dir


def rule_files(spark: SparkSession, out_dir: str) -> DataFrame:
    """The rule files of a folder as they are now, one row each: ``table, path, value`` (the whole text)."""
    return (spark.read.schema(f"value string, `{TABLE_DIR_COLUMN}` string").text(out_dir, wholetext=True)
            .select(TABLE_DIR_COLUMN, F.col("_metadata.file_path").alias("path"), "value"))


def write_manifest(rules: DataFrame, out_dir: str, run: str, table_col: str | None = None) -> str:
    """List the files that ``write_rule_files`` has just made of these rules, with size, digest and number of rules.

    The folder of each of the rules' tables holds this run's files and no
    others, since they replaced what was there. Returns the manifest's folder.
    """
    spark = rules.sparkSession
    tables = rules.select(_table_column(rules, table_col)).distinct()
    listed = (rule_files(spark, out_dir).join(tables, TABLE_DIR_COLUMN, "left_semi")
              .select(TABLE_DIR_COLUMN, "path", F.octet_length("value").cast("long").alias("bytes"), F.sha2("value", 256).alias("sha256"),
                      F.regexp_count("value", F.lit(r"(?m)^- ")).cast("long").alias("rules")))
    path = f"{out_dir.rstrip('/')}/{MANIFESTS}/run={run}"
    listed.write.json(path)
    return path


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(path)
