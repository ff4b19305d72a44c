"""Applying rules to a DataFrame: one plan, every rule, one pass per row.

``apply_checks(df, rules)`` returns the input columns plus ``_errors`` and
``_warnings``: arrays of ``struct<name, message, function, filter,
run_config_name, user_metadata>``, NULL when the row has no issue.

Plan shape: row-level checks are plain Columns evaluated in a single
projection (one whole-stage-codegen stage over one scan, whatever the number
of rules). Dataset-level checks each add one aggregate + LEFT join-back
(see ``operators/dataset_checks.py``); the final projection folds all verdicts
into the two arrays and drops helper columns.
"""

from __future__ import annotations

from functools import partial
from typing import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import name_col
from ..functions.row_checks import ROW_CHECKS
from ..session import scratch_dir
from ..operators.dataset_checks import DATASET_CHECKS, HELPER, CheckContext, attach_grouped_aggregates
from .rules import select_rules

ISSUE_TYPE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("function", T.StringType()),
    T.StructField("filter", T.StringType()),
    T.StructField("run_config_name", T.StringType()),
    T.StructField("user_metadata", T.MapType(T.StringType(), T.StringType())),
])
ERRORS, WARNINGS = "_errors", "_warnings"

# alias of the catalogue name of the personal-data check
_ALIASES = {"pii_detection": "contains_pii"}


def _issue(name: str, message: Column, rule: dict) -> Column:
    meta = rule.get("user_metadata")
    meta_col = (F.create_map(*[F.lit(x) for kv in sorted(meta.items()) for x in kv]) if meta
                else F.lit(None).cast("map<string,string>"))
    return F.struct(F.lit(name).alias("name"), message.cast("string").alias("message"),
                    F.lit(rule["function"]).alias("function"),
                    F.lit(rule.get("filter")).cast("string").alias("filter"),
                    F.lit(rule.get("run_config_name")).cast("string").alias("run_config_name"),
                    meta_col.alias("user_metadata"))


def _collect(items: list[tuple[Column, Column]]) -> Column:
    """Issues of a row: concat of one-element arrays of the violated rules, NULL when none.

    Built from ``concat`` / ``array`` / ``CASE`` only (no lambda functions),
    so the whole rule projection stays inside whole-stage codegen.
    """
    if not items:
        return F.lit(None).cast(T.ArrayType(ISSUE_TYPE))
    empty = F.array().cast(T.ArrayType(ISSUE_TYPE))
    return F.concat(*[F.when(fail, F.array(issue)).otherwise(empty) for fail, issue in items])


def _null_if_empty(name: str) -> Column:
    return F.when(F.size(F.col(name)) > 0, F.col(name))


def build_condition(rule: dict):
    fn = _ALIASES.get(rule["function"], rule["function"])
    args = dict(rule["arguments"])
    if fn in ROW_CHECKS:
        return "row", ROW_CHECKS[fn](**args)
    if fn in DATASET_CHECKS:
        return "dataset", DATASET_CHECKS[fn](**args)
    raise ValueError(f"unknown check function {rule['function']!r}")


ROW_ID, VERDICTS = f"{HELPER}row", f"{HELPER}verdicts"


def _judged_apart(spark: SparkSession, df: DataFrame, built: list, shared: dict, refs, running, row_key: str | None):
    """Verdicts of the checks that would join, on narrow frames: the input with its row id, the verdicts, the checks they decide."""
    units: list[list[int]] = []
    for i, (rule, kind, cond) in enumerate(built):
        # an ungrouped aggregate is one value, without a join; a comparison may append rows, which have no id
        if kind == "row" or cond.agg_spec is not None and cond.share_key is None or rule["arguments"].get("check_missing_records"):
            continue
        members = shared.get((cond.share_key, rule.get("filter") or ""), [i]) if cond.share_key is not None else [i]
        if members[0] == i:
            units.append(members)
    if not units:
        return df, None, {}
    if row_key is None:
        path = scratch_dir(spark, "rows-with-id")
        df.withColumn(ROW_ID, F.monotonically_increasing_id()).write.parquet(path)
        df = spark.read.parquet(path)
    key, parts = row_key or ROW_ID, []
    for members in units:
        rule, _, cond = built[members[0]]
        ctx = CheckContext(spark=spark, source=df, refs=refs or {}, filter=F.expr(rule["filter"]) if rule.get("filter") else None, tag=str(members[0]))
        if running is not None and cond.agg_spec is not None:
            ctx.running = partial(running.frame, members)
        if len(members) > 1 or ctx.running is not None:
            frame, results = attach_grouped_aggregates(df, ctx, [built[m][2].agg_spec for m in members])
        else:
            frame, *result = cond.attach(df, ctx)
            results = [result]
        issues = [F.when(fail, F.struct(F.lit(m).alias("rule"), message.cast("string").alias("message"))) for m, (fail, message) in zip(members, results)]
        parts.append(frame.select(name_col(key).alias(ROW_ID), F.explode(F.array_compact(F.array(*issues))).alias("issue")))
    verdicts = parts[0]
    for part in parts[1:]:
        verdicts = verdicts.unionByName(part)
    # as many entries as a row fails checks
    verdicts = verdicts.groupBy(ROW_ID).agg(F.map_from_entries(F.collect_list("issue")).alias(VERDICTS))
    told = F.col(VERDICTS)
    return df, verdicts, {m: (F.coalesce(F.map_contains_key(told, m), F.lit(False)), told[m]) for members in units for m in members}


def _with_verdicts(df: DataFrame, verdicts: DataFrame | None, key: str) -> DataFrame:
    if verdicts is None:
        return df
    verdicts = verdicts.withColumnRenamed(ROW_ID, f"{HELPER}of")
    return df.join(verdicts, name_col(key) == F.col(f"{HELPER}of"), "left")


def apply_checks(df: DataFrame, rules: Iterable[dict] | DataFrame, refs: dict[str, DataFrame] | None = None,
                 run_config_name: str | None = None, spark: SparkSession | None = None,
                 table_name: str | None = None, running=None, join_back: str = "each",
                 row_key: str | None = None) -> DataFrame:
    """Annotate every row of ``df`` with the rules it violates.

    ``join_back="once"`` is for several dataset checks over a wide input. Each
    check then judges a narrow frame (a row id and the columns it needs), and
    only the verdicts on failing rows are joined to the input, in one join,
    where otherwise every check shuffles the whole input. A row id that all of
    these see alike is needed: ``row_key``, a column with a different value in
    each row, or else the input is written once, with an id, to the shared
    folder (at once, not when the result is used).

    ``running`` (see ``streaming/running.py``) has the values of the checks' groups that a stream keeps; without
    it they are aggregated from ``df``.

    ``rules`` may be a stored rules table; ``table_name`` picks one table's rules and is required where it
    holds those of several.
    """
    if isinstance(rules, DataFrame):
        from .rules import rules_from_table
        rules = rules_from_table(rules, table_name)
    spark = spark or df.sparkSession
    selected = select_rules(rules, run_config_name)
    # issues from an earlier run on the same frame are kept and extended, not duplicated
    earlier = [c for c in (ERRORS, WARNINGS) if c in df.columns]
    original = [c for c in df.columns if c not in earlier]

    errors: list[tuple[Column, Column]] = []
    warnings: list[tuple[Column, Column]] = []
    built = [(rule, *build_condition(rule)) for rule in selected]
    # aggregate checks over the same groups and filter share one groupBy + join-back
    shared: dict[tuple, list[int]] = {}
    for i, (rule, kind, cond) in enumerate(built):
        if kind == "dataset" and cond.share_key is not None:
            shared.setdefault((cond.share_key, rule.get("filter") or ""), []).append(i)
    # uniqueness checks keep their own cheaper plan (only duplicate keys are joined back) unless an
    # aggregate check over the same keys and filter already needs the full per-key aggregate
    for key, members in [] if running is not None else list(shared.items()):
        if all(built[m][0]["function"] == "is_unique" for m in members):
            del shared[key]
    frozen: dict[int, tuple[Column, Column]] = {}

    def freeze(frame: DataFrame, i: int, fail: Column, message: Column) -> DataFrame:
        # keep the verdict in helper columns so later joins cannot disturb it
        flag, text = f"{HELPER}fail_{i}", f"{HELPER}msg_{i}"
        frozen[i] = (F.col(flag), F.col(text))
        return frame.withColumns({flag: F.coalesce(fail, F.lit(False)), text: F.when(fail, message)})

    if join_back not in ("each", "once"):
        raise ValueError("join_back must be each or once")
    if join_back == "once":
        df, verdicts, frozen = _judged_apart(spark, df, built, shared, refs, running, row_key)
        out = _with_verdicts(df, verdicts, row_key or ROW_ID)
    else:
        out = df
    judged: list[tuple[int, dict, Column, Column]] = []
    for i, (rule, kind, cond) in enumerate(built):
        filt = F.expr(rule["filter"]) if rule.get("filter") else None
        name = rule.get("name") or cond.name
        if kind == "row":
            fail = F.coalesce(cond.fail, F.lit(False))
            if filt is not None:
                fail = F.coalesce(filt, F.lit(False)) & fail
            message = cond.message
        else:
            if i not in frozen:
                ctx = CheckContext(spark=spark, source=df, refs=refs or {}, filter=filt, tag=str(i))
                members = shared.get((cond.share_key, rule.get("filter") or ""), [i]) \
                    if cond.share_key is not None else [i]
                if running is not None and cond.agg_spec is not None:
                    ctx.running = partial(running.frame, members)
                if len(members) > 1 or ctx.running is not None and cond.share_key is not None:
                    out, results = attach_grouped_aggregates(out, ctx, [built[m][2].agg_spec for m in members])
                    for m, (f, msg) in zip(members, results):
                        out = freeze(out, m, f, msg)
                else:
                    out, f, msg = cond.attach(out, ctx)
                    out = freeze(out, i, f, msg)
            fail, message = frozen[i]
        judged.append((i, rule, fail, _issue(name, message, rule)))

    # rows that a comparison appended are judged by that comparison alone
    appended = {i: f"{HELPER}missing_{i}" for i in range(len(built)) if f"{HELPER}missing_{i}" in out.columns}
    for i, rule, fail, issue in judged:
        for j, flag in appended.items():
            if j != i:
                fail = fail & ~F.coalesce(F.col(flag), F.lit(False))
        (errors if rule["criticality"] == "error" else warnings).append((fail, issue))

    keep = [c for c in out.columns if not c.startswith(HELPER) and c not in earlier]
    extra = [c for c in keep if c not in original]  # e.g. nothing today; kept for safety
    # two projections: the arrays are built once, then NULL-ed when empty (an alias used
    # twice is not inlined, so no message is evaluated for rows that pass)
    def combined(col: str, items: list) -> Column:
        new = _collect(items)
        if col not in earlier:
            return new
        return F.concat(F.coalesce(F.col(col), F.array().cast(T.ArrayType(ISSUE_TYPE))), new) if items \
            else F.coalesce(F.col(col), F.array().cast(T.ArrayType(ISSUE_TYPE)))

    arrays = out.select(*[name_col(c) for c in original + extra],
                        combined(ERRORS, errors).alias(f"{HELPER}e"), combined(WARNINGS, warnings).alias(f"{HELPER}w"))
    return arrays.select(*[name_col(c) for c in original + extra],
                         _null_if_empty(f"{HELPER}e").alias(ERRORS), _null_if_empty(f"{HELPER}w").alias(WARNINGS))


def split_valid_invalid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without errors (warnings allowed) and rows with errors or warnings."""
    valid = checked.where(F.col(ERRORS).isNull()).drop(ERRORS, WARNINGS)
    invalid = checked.where(F.col(ERRORS).isNotNull() | F.col(WARNINGS).isNotNull())
    return valid, invalid


def issue_names(col: str = ERRORS) -> Column:
    """Sorted, comma-joined check names of an issue array (NULL when none)."""
    return F.array_join(F.sort_array(F.col(f"{col}.name")), ",")


def summarize(checked: DataFrame, keys: list[str]) -> DataFrame:
    """Compact report form used by tests and queries: keys + error / warning names."""
    return checked.select(*keys, issue_names(ERRORS).alias("error_checks"),
                          issue_names(WARNINGS).alias("warning_checks"))


def issue_summary(checked: DataFrame) -> DataFrame:
    """Rows failing each rule: ``criticality, name, function, failing_rows`` (one aggregation)."""
    errs = checked.select(F.lit("error").alias("criticality"), F.explode(ERRORS).alias("i"))
    warns = checked.select(F.lit("warn").alias("criticality"), F.explode(WARNINGS).alias("i"))
    return (errs.unionByName(warns)
            .groupBy("criticality", F.col("i.name").alias("name"), F.col("i.function").alias("function"))
            .agg(F.count(F.lit(1)).alias("failing_rows")))


def validate_rules(rules: Iterable[dict]) -> list[str]:
    """Problems of a rule set, found without running a job: unknown functions, bad arguments or filters.

    Needs an active session (Column expressions are built, not executed).
    """
    from pyspark.errors import AnalysisException, ParseException

    from .rules import expand_for_each, normalize_rule

    spark = SparkSession.getActiveSession()

    def parses(text: str) -> None:
        # SQL syntax is checked eagerly; unknown columns are expected without the table
        try:
            spark.range(0).selectExpr(text)
        except ParseException:
            raise
        except AnalysisException:
            pass

    problems = []
    for i, raw in enumerate(rules):
        label = raw.get("name") or f"rule {i}"
        try:
            for r in expand_for_each(normalize_rule(raw)):
                build_condition(r)
                for text in (r.get("filter"), r["arguments"].get("expression")):
                    if text:
                        parses(text)
        except Exception as e:  # noqa: BLE001 - every problem is reported, none raised
            problems.append(f"{label}: {type(e).__name__}: {str(e).splitlines()[0]}")
    return problems
