"""The rule generation job (discovery → profile → rules → sinks → summary).

The per-table work is a Spark job each; tables are independent, so they are
submitted from a small thread pool (Spark runs jobs of several threads
concurrently) rather than one after another. A failing table becomes a
warning and the others go on. Rule rows stay DataFrames until a sink writes
them; nothing is gathered in driver lists.
"""

from __future__ import annotations

import datetime as dt
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from typing import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.generate import generate_rules, to_stored_rows
from ..operators.options import ProfileOptions
from ..operators.profile import profile
from ..session import scratch_dir
from ..sinks.rule_files import KEY_ORDER

RULE_DOC_SCHEMA = ("table_name string, name string, criticality string, run_config_name string, "
                   "function string, arguments map<string,string>, filter string")
SUMMARY_SCHEMA = "position int, table_name string, checks long, status string, warning string"
MESSAGE_SCHEMA = "kind string, position int, message string"


@dataclass(frozen=True)
class RulegenSettings:
    output_format: str = "yaml"  # yaml | table | both
    output_yaml: str | None = None
    output_table: str | None = None
    criticality: str = "warn"
    run_config_name: str = "default"
    include_table_name: bool = True
    created_by: str = "unknown"
    # where the tables come from when run() gets none (see sources/discovery.py); stored with the rules in any case
    mode: str = "table"  # catalog | schema | table | pipeline
    name_param: str = ""
    exclude_pattern: str | None = None
    exclude_prefix_regex: str | None = None
    columns: tuple | None = None  # only with a single explicit table
    parallelism: int = 4
    table_location: str | None = None  # folder of the rules table when it is created here

    def __post_init__(self):
        if self.output_format not in {"yaml", "table", "both"}:
            raise ValueError("output_format must be yaml, table or both")
        if self.output_format in {"yaml", "both"} and not self.output_yaml:
            raise ValueError("output_yaml is required for yaml / both")
        if self.output_format in {"table", "both"} and not self.output_table:
            raise ValueError("output_table is required for table / both")
        if self.criticality not in {"warn", "error"}:
            raise ValueError("criticality must be warn or error")
        if self.mode not in {"catalog", "schema", "table", "pipeline"}:
            raise ValueError("mode must be catalog, schema, table or pipeline")

    def recorded(self, tables: Sequence[str]) -> dict:
        """The settings stored with every rule: what the run was asked for, and the order in which documents name their keys."""
        kept = {k: v for k, v in asdict(self).items() if k not in {"columns", "parallelism", "table_location", "created_by"}}
        return {**kept, "name_param": self.name_param or ",".join(tables), "key_order": KEY_ORDER,
                "output_yaml": self.output_yaml or "", "output_table": self.output_table or "",
                "exclude_pattern": self.exclude_pattern or "", "exclude_prefix_regex": self.exclude_prefix_regex or ""}


@dataclass
class Generated:
    """What the tables gave: one written table of rules and one of outcomes, whatever the number of tables."""

    rules: DataFrame
    summary: DataFrame  # position, table_name, checks, status, warning
    warnings: list  # one per failed table


@dataclass
class RunResult:
    rules: DataFrame
    summary: DataFrame  # one row per table: checks and status
    overview: DataFrame | None = None  # one row: the run's totals, outputs, files and warnings
    written_files: list = field(default_factory=list)
    warnings: list = field(default_factory=list)
    manifest: str | None = None  # list of the files this run wrote


def rules_for_table(spark: SparkSession, table_name: str, options: ProfileOptions, criticality: str = "warn",
                    run_config_name: str = "default", include_table_name: bool = True,
                    columns: Sequence[str] | None = None, reader: Callable[[str], DataFrame] | None = None
                    ) -> DataFrame:
    df = (reader or spark.table)(table_name)
    prof = profile(df, options, columns=columns, table_name=table_name)
    rules = generate_rules(prof, options, criticality, run_config_name, include_table_name=True)
    if not include_table_name:
        rules = rules.withColumn("source_table", F.col("table_name")).withColumn("table_name", F.lit(None).cast("string"))
    return rules


def generate_all(spark: SparkSession, tables: Sequence[str] | DataFrame, options: ProfileOptions,
                 settings: RulegenSettings | None = None,
                 reader: Callable[[str], DataFrame] | None = None) -> Generated:
    """Rules of every table, and how each table ended.

    A table writes its rules to the run's shared folder as it ends, and their
    number is observed in that same job; the outcomes are one more small
    table. Both are read back as one scan each, so no plan grows with the
    number of tables, and a rule is computed once.
    """
    settings = settings or RulegenSettings(output_format="yaml", output_yaml="unused")
    tables = table_names(tables)
    if settings.columns is not None and len(tables) != 1:
        raise ValueError("columns can only be given for a single table")
    folder = scratch_dir(spark, "rulegen")

    def one(position: int, t: str) -> tuple:
        try:
            rules = rules_for_table(spark, t, options, settings.criticality, settings.run_config_name,
                                    settings.include_table_name, settings.columns, reader)
            seen = Observation()
            rules.observe(seen, F.count(F.lit(1)).alias("checks")).write.mode("overwrite").parquet(f"{folder}/rules/position={position}")
            checks = seen.get["checks"]
            return position, t, checks, "ok" if checks else "no checks", None
        except Exception as e:  # noqa: BLE001 - a failing table is reported, not fatal
            return position, t, 0, "failed", f"profiling or rule generation failed for {t}: {type(e).__name__}: {e}"

    with ThreadPoolExecutor(max_workers=max(1, settings.parallelism)) as pool:
        outcomes = list(pool.map(one, range(len(tables)), tables))
    schema = RULE_DOC_SCHEMA + ("" if settings.include_table_name else ", source_table string")
    spark.createDataFrame([], schema).write.parquet(f"{folder}/rules/position=-1")  # so that the folder is there in any case
    rules = spark.read.schema(schema).parquet(f"{folder}/rules").select(*[c.split(" ")[0] for c in schema.split(", ")])
    spark.createDataFrame(outcomes, SUMMARY_SCHEMA).coalesce(1).write.parquet(f"{folder}/summary")
    return Generated(rules, spark.read.schema(SUMMARY_SCHEMA).parquet(f"{folder}/summary"), [o[4] for o in outcomes if o[4]])


def table_names(tables: Sequence[str] | DataFrame) -> list[str]:
    """Names from a list or from a discovery frame (``table_name``): one per table, bounded by the catalog."""
    if isinstance(tables, DataFrame):
        return [r[0] for r in tables.select("table_name").orderBy("table_name").collect()]
    return list(tables)


def now_iso() -> str:
    return f"{dt.datetime.now(dt.timezone.utc):%Y-%m-%dT%H:%M:%SZ}"


def run(spark: SparkSession, tables: Sequence[str] | DataFrame | None, options: ProfileOptions, settings: RulegenSettings,
        reader: Callable[[str], DataFrame] | None = None, created_at: str | None = None,
        event_log: DataFrame | None = None) -> RunResult:
    """The whole job: rules for every table, then the configured sinks.

    Without ``tables`` the settings' mode, name and exclusions find them.
    """
    from ..sinks import rule_files
    from ..sinks.rules_table import append_rules
    from ..sources.discovery import discover
    from ..sources.rule_documents import read_written_documents, rule_documents_warnings

    if tables is None:
        tables = discover(spark, settings.mode, settings.name_param, settings.exclude_pattern, settings.exclude_prefix_regex, event_log)
    tables = table_names(tables)
    made = generate_all(spark, tables, options, settings, reader)
    rules, warnings = made.rules, list(made.warnings)
    created_at = created_at or now_iso()
    meta = {"profile_options": options.to_dict(), "generator_settings": settings.recorded(tables)}
    written: list[str] = []
    manifest = None
    if settings.output_format in {"yaml", "both"}:
        written = [rule_files.write_rule_files(rules, settings.output_yaml)]
        manifest = rule_files.write_manifest(rules, settings.output_yaml, uuid.uuid4().hex[:12])
    if settings.output_format == "table":
        # a stored row always names its table, also where rule documents leave the name out
        named = rules if settings.include_table_name else rules.withColumn("table_name", F.coalesce("table_name", "source_table"))
        append_rules(spark, to_stored_rows(named, settings.created_by, created_at, generator_meta=meta),
                     settings.output_table, settings.table_location)
    elif settings.output_format == "both":
        # the table gets exactly what this run's files say (K3): a file is read once, and what is wrong with it is told
        reloaded = scratch_dir(spark, "reloaded")
        read_written_documents(spark, settings.output_yaml, rule_files.read_manifest(spark, manifest)).write.parquet(reloaded)
        docs = spark.read.parquet(reloaded)
        stored = to_stored_rows(docs.where(F.col("warning").isNull()).drop("warning"), settings.created_by, created_at,
                                yaml_path=F.col("yaml_path"), generator_meta=meta)
        append_rules(spark, stored, settings.output_table, settings.table_location)
        # at most two for each file of this run
        warnings += [f"{r['yaml_path']}: {r['warning']}" for r in rule_documents_warnings(docs).sort("yaml_path", "warning").collect()]
    summary = made.summary.select("table_name", "checks", "status")
    return RunResult(rules, summary, run_overview(spark, made.summary, settings, manifest, warnings), written, warnings, manifest)


def run_overview(spark: SparkSession, summary: DataFrame, settings: RulegenSettings, manifest: str | None,
                 warnings: Sequence[str] = (), errors: Sequence[str] = ()) -> DataFrame:
    """One row with the run's tables, total checks (every sink counted), outputs, table folders written, warnings and errors.

    The lists are aggregated from the summary, the manifest and a written
    table of messages: none of them is a literal of the plan.
    """
    from ..sinks.rule_files import read_manifest

    folder = scratch_dir(spark, "messages")
    told = [("warning", k, w) for k, w in enumerate(warnings)] + [("error", k, e) for k, e in enumerate(errors)]
    spark.createDataFrame(told, MESSAGE_SCHEMA).coalesce(1).write.parquet(folder)
    messages = spark.read.schema(MESSAGE_SCHEMA).parquet(folder)

    def listed(df: DataFrame, position: str, value: str):
        pairs = F.array_sort(F.collect_list(F.struct(F.col(position).alias("position"), F.col(value).alias("value"))))
        return df.agg(F.transform(pairs, lambda p: p["value"]).alias("values")).scalar()

    if manifest:  # a folder for each table, not its part files
        folders = read_manifest(spark, manifest).select(F.regexp_replace("path", "/[^/]+$", "").alias("folder")).distinct()
        files = listed(folders, "folder", "folder")
    else:
        files = F.array().cast("array<string>")
    totals = summary.agg(F.coalesce(F.sum("checks"), F.lit(0)).cast("bigint").alias("total_checks"))
    return totals.select(
        listed(summary, "position", "table_name").alias("tables"), "total_checks",
        F.lit(settings.output_format).alias("output_format"),
        F.lit(settings.output_yaml).cast("string").alias("output_yaml"),
        F.lit(settings.output_table).cast("string").alias("output_table"), files.alias("written_files"),
        listed(messages.where("kind = 'warning'"), "position", "message").alias("warnings"),
        listed(messages.where("kind = 'error'"), "position", "message").alias("errors"))
