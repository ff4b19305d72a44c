"""Dataset-level checks.

Each check aggregates (over all rows, or over groups / keys) and brings the
verdict back to every input row. Design rules, for scale:

* The side joined back is always unique per join key (a ``groupBy`` or a
  ``distinct``), so a join never multiplies input rows and never emits all
  pairs of a hot key.
* The input is the left (streamed) side of a LEFT join: AQE's skew-join split
  applies to it, so one key holding a third of all rows is cut into several
  tasks. Partial (map-side) aggregation shrinks a hot key before the shuffle.
* No broadcast hints: AQE turns a join into a broadcast only when the measured
  runtime size of the aggregated side is under ``autoBroadcastJoinThreshold``.
* Ungrouped aggregates use a scalar subquery (one value, computed once), never
  an ``OVER ()`` window (which would move all rows into one task).

A check returns a ``DatasetCondition``: ``attach(df, ctx)`` adds helper columns
(prefixed ``__rf_``) and returns the frame plus the fail/message Columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any, Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (all_of, any_of, as_list, column_label, current_ts, to_col,
                                 to_value)

HELPER = "__rf_"


@dataclass
class CheckContext:
    """What a dataset check may need besides its input."""

    spark: Any
    source: DataFrame | None = None  # the original input: aggregates read it, not the joined frame
    refs: dict[str, DataFrame] = field(default_factory=dict)
    filter: Column | None = None
    tag: str = "0"
    # values of the check's groups that a stream keeps (key names, value names -> frame); None: aggregate the source
    running: Callable[[list[str], list[str]], DataFrame] | None = None

    def ref(self, ref_df_name: str | None, ref_table: str | None) -> DataFrame:
        if bool(ref_df_name) == bool(ref_table):
            raise ValueError("give exactly one of ref_df_name or ref_table")
        if ref_df_name:
            if ref_df_name not in self.refs:
                raise KeyError(f"reference DataFrame {ref_df_name!r} not supplied")
            return self.refs[ref_df_name]
        return self.spark.table(ref_table)

    def col(self, what: str) -> str:
        return f"{HELPER}{what}_{self.tag}"


@dataclass
class DatasetCondition:
    name: str
    attach: Callable[[DataFrame, CheckContext], tuple[DataFrame, Column, Column]]
    # Aggregate checks with the same grouping may share one groupBy (see apply.py).
    share_key: tuple | None = None
    agg_spec: Any = None


def _judged(ctx: CheckContext) -> Column:
    return F.lit(True) if ctx.filter is None else F.coalesce(ctx.filter, F.lit(False))


def _base(df: DataFrame, ctx: CheckContext) -> DataFrame:
    return df if ctx.filter is None else df.where(ctx.filter)


def _key_join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str],
              null_safe: bool, how: str = "left") -> DataFrame:
    """Join on key columns, always spelled null-safe (``<=>``).

    Spark plans ``<=>`` on ``coalesce(k, ·), isnull(k)``, which no aggregate's
    output partitioning satisfies, so both sides arrive through their own
    shuffle and AQE's skew-join split can cut a hot key of the input into
    several tasks (with plain ``=`` the aggregated side's partitioning is
    reused and the split does not apply). Plain equality semantics, when asked
    for, come from dropping NULL keys on the right first: a NULL then matches
    nothing, as with ``=``.
    """
    if not null_safe:
        right = right.where(all_of(F.col(r).isNotNull() for r in right_keys))
    conds = [F.col(l).eqNullSafe(F.col(r)) for l, r in zip(left_keys, right_keys)]
    return left.join(right, on=all_of(conds), how=how)


# --------------------------------------------------------------------------- G1
def is_unique(columns: Sequence[Any], nulls_distinct: bool = True) -> DatasetCondition:
    cols = as_list(columns)
    if not cols:
        raise ValueError("is_unique needs at least one column")
    label = column_label(cols)

    def attach(df: DataFrame, ctx: CheckContext):
        lk = [ctx.col(f"k{i}") for i in range(len(cols))]
        rk = [ctx.col(f"rk{i}") for i in range(len(cols))]
        cnt, flag = ctx.col("n"), ctx.col("dup")
        src = df.withColumns({k: to_col(c) for k, c in zip(lk, cols)})
        base = _base(ctx.source.withColumns({k: to_col(c) for k, c in zip(lk, cols)}), ctx)
        if nulls_distinct:
            # a key holding any null is never a duplicate
            base = base.where(all_of(F.col(k).isNotNull() for k in lk))
        dups = (base.groupBy(*lk).agg(F.count(F.lit(1)).alias(cnt))
                .where(F.col(cnt) > 1)
                .select(*[F.col(a).alias(b) for a, b in zip(lk, rk)], cnt, F.lit(True).alias(flag)))
        out = _key_join(src, dups, lk, rk, null_safe=not nulls_distinct).drop(*rk, *lk)
        fail = _judged(ctx) & F.coalesce(F.col(flag), F.lit(False))
        msg = F.concat(F.lit(f"Value of composite key ({label}) is not unique: "),
                       F.col(cnt).cast("string"), F.lit(" rows share it"))
        return out, fail, msg

    def unique_message(n: Column) -> Column:
        return F.concat(F.lit(f"Value of composite key ({label}) is not unique: "), n.cast("string"),
                        F.lit(" rows share it"))

    # alone: the cheaper form above (only duplicate keys are joined back); next to aggregate checks over
    # the same keys and filter it becomes one more aggregate of their shared groupBy: count > 1, and with
    # nulls_distinct no key column NULL
    spec = AggSpec(tuple(cols), lambda: F.count(F.lit(1)), lambda a, l: a > l, 1, "greater than", "count", label,
                   row_condition=(lambda: all_of(to_col(c).isNotNull() for c in cols)) if nulls_distinct else None,
                   message=unique_message, only_grows=True)
    return DatasetCondition(f"{label}_is_not_unique", attach, share_key=("aggr", tuple(str(c) for c in cols)),
                            agg_spec=spec)


# ------------------------------------------------------------------------ G2-G5
_AGGR = {
    "count": lambda c: F.count(c) if c is not None else F.count(F.lit(1)),
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
}

_CMP = {
    "not_greater_than": (lambda a, l: a > l, "greater than"),
    "not_less_than": (lambda a, l: a < l, "less than"),
    "equal": (lambda a, l: a != l, "not equal to"),
    "not_equal": (lambda a, l: a == l, "equal to"),
}


@dataclass(frozen=True)
class AggSpec:
    groups: tuple
    agg_expr: Callable[[], Column]
    compare: Callable[[Column, Column], Column]
    limit: Any
    words: str
    aggr_type: str
    label: str
    row_condition: Callable[[], Column] | None = None  # extra per-row requirement for failing
    message: Callable[[Column], Column] | None = None  # custom message from the aggregate value
    column: Any = None  # what is aggregated; None: rows are counted
    only_grows: bool = False  # a count that fails above one: never taken back, and single rows never fail


def aggregate_of(aggr_type: str, value: Column) -> Column:
    """The aggregate of one value column; NULLs don't count."""
    return _AGGR[aggr_type](value)


def _agg_message(spec: AggSpec, val: Column, lim: Column) -> Column:
    per = (" per group of " + column_label(list(spec.groups))) if spec.groups else ""
    return F.concat(F.lit(f"{spec.aggr_type.capitalize()} "), F.coalesce(val.cast("string"), F.lit("null")),
                    F.lit(f" in column '{spec.label}'{per} is {spec.words} limit: "),
                    F.coalesce(lim.cast("string"), F.lit("null")))


def attach_grouped_aggregates(df: DataFrame, ctx: CheckContext, specs: Sequence[AggSpec]
                              ) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """Aggregate checks sharing one ``group_by`` (and filter): one groupBy, one join-back.

    The aggregated side has one row per group, so the join never multiplies
    input rows; group keys may be NULL (``groupBy`` makes one group of them),
    so they are matched null-safely.
    """
    groups = list(specs[0].groups)
    gk = [ctx.col(f"g{i}") for i in range(len(groups))]
    rk = [ctx.col(f"rg{i}") for i in range(len(groups))]
    vals = [ctx.col(f"agg{j}") for j in range(len(specs))]
    keyed = {k: to_col(g) for k, g in zip(gk, groups)}
    agg = (_base(ctx.source.withColumns(keyed), ctx).groupBy(*gk)
           .agg(*[sp.agg_expr().alias(v) for sp, v in zip(specs, vals)])
           .select(*[F.col(a).alias(b) for a, b in zip(gk, rk)], *vals)) if ctx.running is None else ctx.running(rk, vals)
    if not any(isinstance(sp.limit, (str, Column)) for sp in specs):
        # no limit depends on the row: only groups that fail one of the checks are joined back
        agg = agg.where(any_of(F.coalesce(sp.compare(F.col(v), to_value(sp.limit)), F.lit(False))
                               for sp, v in zip(specs, vals)))
    out = _key_join(df.withColumns(keyed), agg, gk, rk, null_safe=True)
    results = []
    for sp, v in zip(specs, vals):
        lim = to_value(sp.limit)
        fail = _judged(ctx) & F.coalesce(sp.compare(F.col(v), lim), F.lit(False))
        if sp.row_condition is not None:
            fail = fail & F.coalesce(sp.row_condition(), F.lit(False))
        msg = sp.message(F.col(v)) if sp.message is not None else _agg_message(sp, F.col(v), lim)
        results.append((fail, msg))
    return out, results


def _aggr_check(kind: str, column: Any = None, limit: Any = None, aggr_type: str = "count",
                group_by: Sequence[Any] | None = None) -> DatasetCondition:
    if aggr_type not in _AGGR:
        raise ValueError(f"unsupported aggr_type {aggr_type!r}; use one of {sorted(_AGGR)}")
    if aggr_type != "count" and column is None:
        raise ValueError(f"aggr_type {aggr_type!r} needs a column")
    if limit is None:
        raise ValueError("limit is required")
    groups = as_list(group_by)
    compare, words = _CMP[kind]
    label = column_label(column) if column is not None else "count"
    gl = ("_group_by_" + column_label(groups)) if groups else ""
    name = f"{label}_{aggr_type}{gl}_{words.replace(' ', '_')}_limit"

    def agg_expr() -> Column:
        return _AGGR[aggr_type](to_col(column) if column is not None else None)

    spec = AggSpec(tuple(groups), agg_expr, compare, limit, words, aggr_type, label, column=column)

    def attach(df: DataFrame, ctx: CheckContext):
        if groups:
            out, [(fail, msg)] = attach_grouped_aggregates(df, ctx, [spec])
            return out, fail, msg
        # no grouping: one value for the whole (filtered) input, as a scalar subquery
        val = ctx.col("agg")
        whole = _base(ctx.source, ctx).select(agg_expr().alias(val)) if ctx.running is None else ctx.running([], [val])
        out = df.withColumn(val, whole.scalar())
        lim = to_value(limit)
        fail = _judged(ctx) & F.coalesce(compare(F.col(val), lim), F.lit(False))
        return out, fail, _agg_message(spec, F.col(val), lim)

    share = ("aggr", tuple(str(g) for g in groups)) if groups else None
    return DatasetCondition(name, attach, share_key=share, agg_spec=spec)


def is_aggr_not_greater_than(column: Any = None, limit: Any = None, aggr_type: str = "count",
                             group_by: Sequence[Any] | None = None) -> DatasetCondition:
    return _aggr_check("not_greater_than", column, limit, aggr_type, group_by)


def is_aggr_not_less_than(column: Any = None, limit: Any = None, aggr_type: str = "count",
                          group_by: Sequence[Any] | None = None) -> DatasetCondition:
    return _aggr_check("not_less_than", column, limit, aggr_type, group_by)


def is_aggr_equal(column: Any = None, limit: Any = None, aggr_type: str = "count",
                  group_by: Sequence[Any] | None = None) -> DatasetCondition:
    return _aggr_check("equal", column, limit, aggr_type, group_by)


def is_aggr_not_equal(column: Any = None, limit: Any = None, aggr_type: str = "count",
                      group_by: Sequence[Any] | None = None) -> DatasetCondition:
    return _aggr_check("not_equal", column, limit, aggr_type, group_by)


# --------------------------------------------------------------------------- G6
def foreign_key(columns: Sequence[Any], ref_columns: Sequence[Any], ref_df_name: str | None = None,
                ref_table: str | None = None, negate: bool = False) -> DatasetCondition:
    cols, rcols = as_list(columns), as_list(ref_columns)
    if not cols or len(cols) != len(rcols):
        raise ValueError("columns and ref_columns must be non-empty and of equal length")
    label = column_label(cols)
    ref_label = ref_df_name or ref_table

    def attach(df: DataFrame, ctx: CheckContext):
        lk = [ctx.col(f"k{i}") for i in range(len(cols))]
        rk = [ctx.col(f"rk{i}") for i in range(len(cols))]
        flag = ctx.col("found")
        src = df.withColumns({k: to_col(c) for k, c in zip(lk, cols)})
        ref = ctx.ref(ref_df_name, ref_table)
        # distinct keys: the annotation never multiplies input rows
        keys = (ref.select(*[to_col(c).alias(k) for c, k in zip(rcols, rk)])
                .where(all_of(F.col(k).isNotNull() for k in rk))
                .distinct()
                .withColumn(flag, F.lit(True)))
        out = _key_join(src, keys, lk, rk, null_safe=False)
        has_null = any_of(F.col(k).isNull() for k in lk)
        found = F.coalesce(F.col(flag), F.lit(False))
        fail = _judged(ctx) & ~has_null & (found if negate else ~found)
        msg = F.concat(F.lit(f"Value of ({label}) "),
                       F.lit("exists" if negate else "does not exist"),
                       F.lit(f" in the reference {ref_label}"))
        return out, fail, msg

    return DatasetCondition(f"{label}_{'' if negate else 'not_'}exists_in_ref_{column_label(ref_label)}", attach)


# --------------------------------------------------------------------------- G7
_PLACEHOLDER = re.compile(r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}")


def render_query(query: str) -> tuple[str, list[str]]:
    """``{{ name }}`` → ``{name}`` for ``spark.sql(query, **frames)``; other braces are doubled."""
    names: list[str] = []
    parts = []
    last = 0
    for m in _PLACEHOLDER.finditer(query):
        parts.append(query[last:m.start()].replace("{", "{{").replace("}", "}}"))
        parts.append("{" + m.group(1) + "}")
        names.append(m.group(1))
        last = m.end()
    parts.append(query[last:].replace("{", "{{").replace("}", "}}"))
    return "".join(parts), names


def sql_query(query: str, merge_columns: Sequence[str], condition_column: str,
              input_placeholder: str = "input_view", msg: str | None = None, name: str | None = None,
              negate: bool = False) -> DatasetCondition:
    merge = as_list(merge_columns)
    if not merge:
        raise ValueError("merge_columns must not be empty")

    def attach(df: DataFrame, ctx: CheckContext):
        text, names = render_query(query)
        frames = {}
        for n in names:
            if n == input_placeholder:
                frames[n] = _base(ctx.source, ctx)
            elif n in ctx.refs:
                frames[n] = ctx.refs[n]
            else:
                raise KeyError(f"placeholder {{{{ {n} }}}} has no DataFrame")
        res = ctx.spark.sql(text, **frames)
        rk = [ctx.col(f"m{i}") for i in range(len(merge))]
        flag = ctx.col("cond")
        cond = F.col(condition_column).cast("boolean")
        if negate:
            cond = ~cond
        # one verdict per merge key: no row of the input multiplies
        verdict = (res.groupBy(*[F.col(m).alias(r) for m, r in zip(merge, rk)])
                   .agg(F.bool_or(cond).alias(flag))
                   .where(F.col(flag)))  # only failing keys are joined back
        out = _key_join(df, verdict, merge, rk, null_safe=True).drop(*rk)
        fail = _judged(ctx) & F.coalesce(F.col(flag), F.lit(False))
        text_msg = msg or f"Value is {'not ' if negate else ''}matching query condition column '{condition_column}'"
        return out, fail, F.lit(text_msg)

    return DatasetCondition(name or f"{column_label(merge)}_sql_query_{column_label(condition_column)}", attach)


# --------------------------------------------------------------------------- G8
def _name_in(frame: DataFrame, col: Any) -> str:
    """Name of a column given as text or as a simple Column (``F.col("x")``)."""
    if isinstance(col, str):
        return col
    names = frame.select(col).columns
    if len(names) != 1 or names[0] not in frame.columns:
        raise ValueError(f"only plain column references can match rows, got {col!r}")
    return names[0]


def _comparable(t: T.DataType) -> bool:
    """Types whose values Spark can order and compare: none that holds a map or a variant."""
    if isinstance(t, T.ArrayType):
        return _comparable(t.elementType)
    if isinstance(t, T.StructType):
        return all(_comparable(f.dataType) for f in t.fields)
    return not isinstance(t, (T.MapType, T.VariantType))


def _common_type(spark, a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type in which Spark compares values of two simple types; None where a fingerprint can't follow it."""
    if a == b:
        return a
    plain = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
    if not (isinstance(a, plain) and isinstance(b, plain)) or isinstance(a, T.NumericType) != isinstance(b, T.NumericType):
        return None
    both = spark.createDataFrame([], T.StructType([T.StructField("a", a), T.StructField("b", b)]))
    return both.select(F.coalesce("a", "b")).schema.fields[0].dataType


def _hashable(c: Column, t: T.DataType) -> list[Column]:
    """What a value gives to its row's fingerprint; hashes pass over NULLs, so each says whether it is one."""
    value = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}) if isinstance(t, (T.ArrayType, T.StructType)) \
        else c + F.lit(0).cast(t) if isinstance(t, (T.DoubleType, T.FloatType)) else c   # -0.0 equals 0.0
    return [c.isNull(), value]


def compare_report(df: DataFrame, ref: DataFrame, columns: Sequence[Any], ref_columns: Sequence[Any],
                   exclude_columns: Sequence[Any] | None = None, check_missing_records: bool = False,
                   null_safe_row_matching: bool = True, null_safe_column_value_matching: bool = True,
                   status_col: str = "_compare_status", changed_col: str = "_changed_columns",
                   tag: str = "cmp", source: DataFrame | None = None) -> DataFrame:
    """Row-level comparison of ``df`` against ``ref`` by key.

    Adds ``status_col`` (``matched``, ``changed``, ``extra`` = key absent from
    the reference, ``missing`` = reference key absent from the input, only with
    ``check_missing_records``, ``ambiguous`` = the reference holds several
    different rows for the key) and ``changed_col`` (sorted, comma-joined
    names of differing columns). Only columns present on both sides are
    compared; columns that hold a map are skipped; key columns are not compared.

    Plan: both sides are reduced to keys and two 64-bit fingerprints a row, and
    one hash aggregation over all of them tells for each key whether its rows
    are the same on both sides, and which keys one side lacks. Only keys that
    aren't clean are joined back to the input, with the reference's columns
    fetched for those that differ. The input is the left side of that join, so
    it is never multiplied and its hot keys can be split by AQE. Keys that the
    input lacks come out of the same aggregation, appended with ``unionByName``.
    """
    keys = [_name_in(df, c) for c in as_list(columns)]
    rkeys = [_name_in(ref, c) for c in as_list(ref_columns)]
    if not keys or len(keys) != len(rkeys):
        raise ValueError("columns and ref_columns must be non-empty and of equal length")
    source = df if source is None else source
    excl = {_name_in(df, c) for c in as_list(exclude_columns)}
    types, ref_types = ({f.name: f.dataType for f in frame.schema.fields} for frame in (df, ref))
    compared = [f.name for f in df.schema.fields
                if f.name in ref_types and f.name not in keys and f.name not in excl
                and _comparable(f.dataType) and _comparable(ref_types[f.name])]
    common = {c: _common_type(df.sparkSession, types[c], ref_types[c]) for c in compared}
    key_types = [_common_type(df.sparkSession, types[k], ref_types[r]) or types[k] for k, r in zip(keys, rkeys)]

    rk = [f"{HELPER}rk{i}_{tag}" for i in range(len(keys))]
    rv = [f"{HELPER}rv{j}_{tag}" for j in range(len(compared))]
    state = f"{HELPER}state_{tag}"

    # ------------------------------------------------------------ fingerprints
    def prints(frame: DataFrame, names: Sequence[str], of_input: bool) -> DataFrame:
        parts = [p for c in compared if common[c] is not None for p in _hashable(F.col(c).cast(common[c]), common[c])]
        # a NULL never equals a NULL when values are matched strictly; types without a common one are compared value by value
        doubt = any_of(F.col(c).isNull() for c in compared) if compared and not null_safe_column_value_matching else F.lit(False)
        if any(t is None for t in common.values()):
            doubt = F.lit(True)
        null_key = any_of(F.col(c).isNull() for c in names)
        return frame.select(*[F.col(c).cast(t).alias(k) for c, k, t in zip(names, rk, key_types)],
                            F.xxhash64(F.lit(1), *parts).alias("p"), F.xxhash64(F.lit(2), *parts).alias("q"), doubt.alias("doubt"),
                            F.lit(of_input).alias("mine"),
                            # NULL keys match nothing, unless row matching is null-safe
                            (F.when(null_key, F.lit(1 + of_input)).otherwise(0) if not null_safe_row_matching else F.lit(0)).alias("apart"))

    mine = F.col("mine")
    ends = [F.expr(f"{f}({c}) FILTER (WHERE {'' if side else 'NOT '}mine)").alias(f"{f}_{c}{int(side)}")
            for side in (True, False) for c in ("p", "q") for f in ("min", "max")]
    by_key = (prints(source, keys, True).unionByName(prints(ref, rkeys, False)).groupBy(*rk, "apart")
              .agg(F.count_if(mine).alias("in_rows"), F.count_if(~mine).alias("ref_rows"), F.bool_or("doubt").alias("doubt"), *ends))
    several = (F.col("min_p0") != F.col("max_p0")) | (F.col("min_q0") != F.col("max_q0"))
    clean = ~F.col("doubt") & all_of(F.col(f"{f}_{c}1") == F.col(f"min_{c}0") for c in ("p", "q") for f in ("min", "max"))
    states = by_key.withColumn(state, F.when(F.col("ref_rows") == 0, F.lit("extra")).when(F.col("in_rows") == 0, F.lit("missing"))
                               .when(several, F.lit("ambiguous")).when(clean, F.lit("matched")).otherwise(F.lit("differs")))

    # ------------------------------------------------------------ back to the rows
    odd = states.where((F.col(state) != "matched") & (F.col(state) != "missing") & (F.col("apart") == 0)).select(*rk, state)
    fetched = [f"{k}_v" for k in rk]
    # rows of a differing key are all alike in the reference (else it is ambiguous): one version a key
    versions = (_key_join(ref.select(*[F.col(c).alias(k) for c, k in zip(rkeys, fetched)], *[F.col(c).alias(v) for c, v in zip(compared, rv)]),
                          odd.where(F.col(state) == "differs"), fetched, rk, null_safe=True, how="inner")
                .select(*rk, state, *rv).distinct())
    right = odd.where(F.col(state) != "differs").unionByName(versions, allowMissingColumns=True)
    joined = _key_join(df, right, keys, rk, null_safe=null_safe_row_matching)

    diffs = []
    for c, v in sorted(zip(compared, rv)):
        a, b = F.col(c), F.col(v)
        differ = ~a.eqNullSafe(b) if null_safe_column_value_matching else ~F.coalesce(a == b, F.lit(False))
        diffs.append(F.when(differ, F.lit(c)))
    changed_text = F.concat_ws(",", *diffs) if diffs else F.lit("")  # sorted names, '' when none
    is_changed = (F.col(state) == "differs") & (changed_text != F.lit(""))
    status = (F.when(is_changed, F.lit("changed")).when(F.col(state).isNull() | (F.col(state) == "differs"), F.lit("matched"))
              .otherwise(F.col(state)))
    if not null_safe_row_matching:
        status = F.when(any_of(F.col(k).isNull() for k in keys), F.lit("extra")).otherwise(status)
    out = joined.withColumns({status_col: status, changed_col: F.when(is_changed, changed_text)}).drop(*rk, *rv, state)

    if check_missing_records:
        fill = []
        for f in df.schema.fields:
            if f.name in keys:
                fill.append(F.col(rk[keys.index(f.name)]).cast(f.dataType).alias(f.name))
            else:
                fill.append(F.lit(None).cast(types[f.name]).alias(f.name))
        missing_rows = states.where(F.col(state) == "missing").select(
            *fill, F.lit("missing").alias(status_col), F.lit(None).cast("string").alias(changed_col))
        out = out.unionByName(missing_rows)
    return out


def compare_datasets(columns: Sequence[Any], ref_columns: Sequence[Any], exclude_columns: Sequence[Any] | None = None,
                     ref_df_name: str | None = None, ref_table: str | None = None,
                     check_missing_records: bool = False, null_safe_row_matching: bool = True,
                     null_safe_column_value_matching: bool = True) -> DatasetCondition:
    label = column_label(as_list(columns))

    def attach(df: DataFrame, ctx: CheckContext):
        st, ch = ctx.col("status"), ctx.col("changed")
        ref = ctx.ref(ref_df_name, ref_table)
        out = compare_report(df, ref, columns, ref_columns, exclude_columns, check_missing_records,
                             null_safe_row_matching, null_safe_column_value_matching,
                             status_col=st, changed_col=ch, tag=ctx.tag, source=ctx.source)
        if check_missing_records:  # marks the appended rows, which no other rule judges (see apply.py)
            out = out.withColumn(ctx.col("missing"), F.col(st) == "missing")
        judged = F.lit(True) if ctx.filter is None else (F.coalesce(ctx.filter, F.lit(False))
                                                       | (F.col(st) == "missing"))
        fail = judged & (F.col(st) != F.lit("matched"))
        msg = (F.when(F.col(st) == "changed", F.concat(F.lit("Changed columns: "), F.col(ch)))
               .when(F.col(st) == "extra", F.lit("Row not found in the reference"))
               .when(F.col(st) == "missing", F.lit("Reference row missing from the input"))
               .otherwise(F.lit("Reference holds several different rows for this key")))
        return out, fail, msg

    return DatasetCondition(f"{label}_dataset_mismatch", attach)


# --------------------------------------------------------------------------- G9
def _window_start(ts: Column, window_minutes: int, type_name: str = "timestamp_ntz") -> Column:
    """Start of the epoch-aligned tumbling window of ``ts``; NULL when ``ts`` is NULL.

    Spark filters out every row whose time is NULL wherever ``window()`` is
    used, so it gets a time that is never NULL and the NULL is put back:
    no input row is dropped.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast(type_name)
    return F.when(ts.isNotNull(), F.window(F.coalesce(ts, epoch), f"{int(window_minutes)} minutes").start)


def _time_type(df: DataFrame, ts: Column) -> str:
    t = df.select(ts).schema.fields[0].dataType
    return "timestamp_ntz" if isinstance(t, T.TimestampNTZType) else "timestamp"


def is_data_fresh_per_time_window(column: Any, window_minutes: int, min_records_per_window: int,
                                  lookback_windows: int | None = None, curr_timestamp: Any = None
                                  ) -> DatasetCondition:
    label = column_label(column)

    def attach(df: DataFrame, ctx: CheckContext):
        wk, rwk, cnt = ctx.col("w"), ctx.col("rw"), ctx.col("wn")
        ts = to_col(column)
        scope = ts.isNotNull()
        if lookback_windows is not None:
            now = current_ts(curr_timestamp)
            start = now - F.make_dt_interval(mins=F.lit(int(lookback_windows) * int(window_minutes)))
            scope = scope & (ts >= start) & (ts <= now)
        tt = _time_type(ctx.source, ts)
        src = df.withColumn(wk, F.when(scope, _window_start(ts, window_minutes, tt)))
        counts = (_base(ctx.source.withColumn(wk, F.when(scope, _window_start(ts, window_minutes, tt))), ctx)
                  .where(F.col(wk).isNotNull())
                  .groupBy(F.col(wk).alias(rwk)).agg(F.count(F.lit(1)).alias(cnt))
                  # only windows that fail are joined back; a judged row's window counts at least that row
                  .where(F.col(cnt) < int(min_records_per_window)))
        out = _key_join(src, counts, [wk], [rwk], null_safe=False).drop(rwk)
        fail = _judged(ctx) & F.col(cnt).isNotNull()
        msg = F.concat(F.lit("Window starting "), F.col(wk).cast("string"), F.lit(" holds "),
                       F.col(cnt).cast("string"),
                       F.lit(f" records, fewer than {int(min_records_per_window)}"))
        return out, fail, msg

    return DatasetCondition(f"{label}_is_not_fresh_per_time_window", attach)


def freshness_windows(df: DataFrame, column: Any, window_minutes: int,
                      min_records_per_window: int | None = None, grid_rows_per_partition: int = 100_000) -> DataFrame:
    """Report of every tumbling window between the first and last record, empty ones included.

    Per-window counts come from one ``groupBy``; the window grid is a
    ``spark.range`` over the number of windows (read from the one-row
    min/max aggregate), spread over partitions, then LEFT-joined to the
    counts. Its size grows with the time span, not with the rows.
    """
    spark = df.sparkSession
    ts = to_col(column)
    minutes = int(window_minutes)
    counts = (df.where(ts.isNotNull()).groupBy(_window_start(ts, minutes, _time_type(df, ts)).alias("window_start"))
              .agg(F.count(F.lit(1)).alias("records")))
    epoch = F.col("window_start").cast("timestamp").cast("long")
    lo, hi = counts.agg(F.min(epoch), F.max(epoch)).collect()[0]  # one row: the span
    ntz = dict(counts.dtypes)["window_start"] == "timestamp_ntz"
    if lo is None:
        schema = f"window_start timestamp{'_ntz' if ntz else ''}, window_end timestamp{'_ntz' if ntz else ''}, records bigint"
        rep = spark.createDataFrame([], schema)
    else:
        n = (hi - lo) // (60 * minutes) + 1
        start = F.timestamp_seconds(F.lit(lo) + F.col("id") * F.lit(60 * minutes))
        grid = spark.range(0, n, numPartitions=max(1, n // grid_rows_per_partition)).select(
            (start.cast("timestamp_ntz") if ntz else start).alias("window_start"))
        step = F.expr(f"INTERVAL {minutes} MINUTES")
        rep = (grid.join(counts, "window_start", "left")
               .select("window_start", (F.col("window_start") + step).alias("window_end"),
                       F.coalesce(F.col("records"), F.lit(0)).cast("bigint").alias("records")))
    if min_records_per_window is not None:
        rep = rep.withColumn("fresh", F.col("records") >= int(min_records_per_window))
    return rep


DATASET_CHECKS = {
    "is_unique": is_unique,
    "is_aggr_not_greater_than": is_aggr_not_greater_than,
    "is_aggr_not_less_than": is_aggr_not_less_than,
    "is_aggr_equal": is_aggr_equal,
    "is_aggr_not_equal": is_aggr_not_equal,
    "foreign_key": foreign_key,
    "sql_query": sql_query,
    "compare_datasets": compare_datasets,
    "is_data_fresh_per_time_window": is_data_fresh_per_time_window,
}
