"""Rule documents as a source (S8): YAML files → rules DataFrame.

Each file is read whole (``wholetext``), one row per file, and parsed by
PyYAML inside ``mapInPandas`` on the executors: a file holds one or more YAML
documents; a document is a rule or a list of rules; non-mapping entries are
dropped; a file that does not parse yields a warning row instead of rules.
"""

from __future__ import annotations

import json
import re
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_SCHEMA = ("table_name string, name string, criticality string, run_config_name string, function string, "
              "for_each_column array<string>, arguments map<string,string>, filter string, "
              "user_metadata map<string,string>, yaml_path string, warning string")


def stringify(value) -> str:
    """The stored text of an argument value: JSON for what JSON spells differently from text, else the text."""
    as_json = value is None or isinstance(value, (bool, list, tuple, dict))
    return json.dumps(value, sort_keys=True, separators=(",", ":")) if as_json else str(value)


def _rules_of(text: str) -> list[dict]:
    """The mappings of a file: each of its YAML documents is one, or a list of them."""
    import yaml

    entries = (doc if isinstance(doc, list) else [doc] for doc in yaml.safe_load_all(text))
    return [entry for group in entries for entry in group if isinstance(entry, dict) and entry]


def _table_of_path(path: str) -> str | None:
    """The table of a rule file written by ``write_rule_files``: its ``table=<name>`` folder."""
    from urllib.parse import unquote

    m = re.search(r"/table=([^/]+)/", path or "")
    return unquote(m.group(1)) if m else None


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["table_name", "name", "criticality", "run_config_name", "function", "for_each_column", "arguments",
            "filter", "user_metadata", "yaml_path", "warning"]
    for pdf in batches:
        rows = []
        for path, text in zip(pdf["path"], pdf["value"]):
            try:
                rules = _rules_of(text or "")
            except Exception as e:  # noqa: BLE001 - unreadable file → warning row
                rows.append([None] * 9 + [path, f"could not load rule document: {type(e).__name__}: {e}"])
                continue
            folder_table = _table_of_path(path)
            for r in rules:
                chk = r.get("check") or {}
                fec = chk.get("for_each_column")
                meta = r.get("user_metadata")
                rows.append([
                    r.get("table_name") or folder_table, r.get("name"), r.get("criticality"), r.get("run_config_name"),
                    chk.get("function"),
                    [str(x) for x in fec] if isinstance(fec, list) else None,
                    {str(k): stringify(v) for k, v in (chk.get("arguments") or {}).items()},
                    r.get("filter"),
                    {str(k): stringify(v) for k, v in meta.items()} if isinstance(meta, dict) and meta else None,
                    path, None])
        yield pd.DataFrame(rows, columns=cols)


def _ship_by_value() -> None:
    # executors may not have this package installed: send the parse function with the task
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_rule_documents(spark: SparkSession, path: str, with_warnings: bool = False) -> DataFrame:
    """Rules of every YAML/text file under ``path`` (recursively)."""
    _ship_by_value()
    files = (spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
             .select(F.input_file_name().alias("path"), "value"))
    docs = files.mapInPandas(_parse, DOC_SCHEMA)
    if with_warnings:
        return docs
    return docs.where(F.col("warning").isNull()).drop("warning")


def rule_documents_warnings(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("warning").isNotNull()).select("yaml_path", "warning")


def read_written_documents(spark: SparkSession, out_dir: str, manifest: DataFrame) -> DataFrame:
    """Rules of exactly the files that a manifest lists, with warnings (``rule_documents_warnings``).

    A listed file that is gone, or whose text isn't the one that was written,
    gives a warning; what is left of it is read all the same. Files that the
    manifest doesn't list are other runs' and aren't looked at.
    """
    from ..sinks.rule_files import rule_files

    _ship_by_value()
    now = rule_files(spark, out_dir).select("path", "value")
    docs = now.join(manifest.select("path"), "path", "left_semi").mapInPandas(_parse, DOC_SCHEMA)
    state = (manifest.select("path", "rules", F.col("sha256").alias("written"))
             .join(now.select("path", F.sha2("value", 256).alias("found")), "path", "left"))
    problem = (F.when(F.col("found").isNull(), F.concat(F.lit("rule file is gone: "), F.col("rules"), F.lit(" rules were written to it")))
               .when(F.col("found") != F.col("written"), F.lit("rule file was changed after it was written")))
    told = state.select(F.col("path").alias("yaml_path"), problem.alias("warning")).where(F.col("warning").isNotNull())
    return docs.unionByName(told, allowMissingColumns=True)
