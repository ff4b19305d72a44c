"""Uniqueness and aggregate checks over a whole stream (T1 with G1-G5).

A verdict on a group of rows can change with every batch: a key seen once
becomes a duplicate, a sum passes its limit, a minimum sinks below it. So the
groups' values are kept as streaming state, and every change is written:

* Each row is dealt to the groups of all rules at once (one narrow row for
  each different grouping: keys and measured columns only), and one stateful
  aggregation in update mode holds the running values: one scan of the source
  and one shuffle, however many rules there are.
* Each batch writes the values that changed to ``values/epoch=<n>``; a batch
  that is run again after a failure overwrites its own folder. Of groups that
  only uniqueness needs, those with one row aren't written.
* ``annotate`` joins the last value of each group to the rows through the same
  code as batch checks, so a drained stream gives the batch answer.
* ``corrections`` tells which verdicts a batch turned, in either direction:
  what a consumer of earlier verdicts has to take back.

State grows with the number of groups, not of rows, and the default provider
keeps it in the executors' heaps. A task holds the groups of its part of a
batch and of its state partition: where there are many, bound both by ``conf``
(``spark.sql.shuffle.partitions`` is the number of state partitions, fixed by
a stream's first run), or set
``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider.
"""

from __future__ import annotations

from contextlib import contextmanager
from typing import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import all_of, any_of, to_col, to_value
from ..operators.dataset_checks import AggSpec, aggregate_of
from ..plans.apply import apply_checks, build_condition
from ..plans.rules import select_rules
from ..session import child_folders, delete_folder


class RunningChecks:
    """The running values of a rule set's groups, in ``folder`` (a shared one); ``conf`` are settings of the stream's queries."""

    def __init__(self, spark: SparkSession, rules: Iterable[dict], folder: str,
                 refs: dict[str, DataFrame] | None = None, run_config_name: str | None = None, conf: dict[str, str] | None = None):
        self.spark, self.refs, self.run_config_name = spark, refs, run_config_name
        # one version of the state in memory beside the one that a batch makes; older ones are read from files
        self.conf = {"spark.sql.streaming.maxBatchesToRetainInMemory": "1"} | (conf or {})
        self.rules = list(rules)
        self.folder = folder.rstrip("/")
        self.specs: dict[int, AggSpec] = {}
        self.names: dict[int, str] = {}
        families: dict[tuple, list[int]] = {}
        for i, rule in enumerate(select_rules(self.rules, run_config_name)):
            kind, cond = build_condition(rule)
            if kind == "row" or rule["function"] == "foreign_key":
                continue
            if cond.agg_spec is None:
                raise ValueError(f"{rule['function']} has no running form: judge finished tables with it")
            self.specs[i], self.names[i] = cond.agg_spec, rule.get("name") or cond.name
            families.setdefault((tuple(str(g) for g in cond.agg_spec.groups), rule.get("filter") or ""), []).append(i)
        # rules of one grouping and filter share their groups
        self.families = [(filter_text, members) for (_, filter_text), members in families.items()]

    # ------------------------------------------------------------ the stream
    def _groups(self, family: int) -> tuple:
        return self.specs[self.families[family][1][0]].groups

    def _keys(self, family: int) -> list[str]:
        return [f"f{family}_k{j}" for j in range(len(self._groups(family)))]

    def values(self, stream: DataFrame) -> DataFrame:
        """The groups' running values, as a stream in update mode."""
        types = {k: stream.select(to_col(g)).schema.fields[0].dataType
                 for f in range(len(self.families)) for k, g in zip(self._keys(f), self._groups(f))}
        dealt = []
        for f, (filter_text, _) in enumerate(self.families):
            own = dict(zip(self._keys(f), self._groups(f)))
            place = F.struct(F.lit(f).alias("family"), *[
                (to_col(own[k]) if k in own else F.lit(None)).cast(t).alias(k) for k, t in types.items()])
            dealt.append(F.when(F.expr(filter_text), place) if filter_text else place)
        # no more than the measured columns are kept beside the keys
        measured = {i: f"m{i}" for i, spec in self.specs.items() if spec.column is not None}
        rows = (stream.select(F.explode(F.array_compact(F.array(*dealt))).alias("g"),
                              *[to_col(self.specs[i].column).alias(m) for i, m in measured.items()])
                .select("g.*", *measured.values()))
        here = {i: f for f, (_, members) in enumerate(self.families) for i in members}
        grouped = rows.groupBy("family", *types).agg(*[
            aggregate_of(spec.aggr_type, F.when(F.col("family") == here[i],
                                                F.col(measured[i]) if i in measured else F.lit(1))).alias(f"v{i}")
            for i, spec in self.specs.items()])
        wanted = [F.col("family") == f if not all(self.specs[i].only_grows for i in members)
                  else (F.col("family") == f) & any_of(F.col(f"v{i}") > 1 for i in members)
                  for f, (_, members) in enumerate(self.families)]
        return grouped.where(any_of(wanted))

    def start(self, stream: DataFrame, **trigger) -> list:
        """Start the queries: the rows as they are, and the groups' values. ``trigger`` as for ``writeStream.trigger``."""
        with self._settings():  # a query keeps the settings it was started with, but for those of reading files
            return self._start(stream, trigger)

    @contextmanager
    def _settings(self):
        before = {k: self.spark.conf.get(k, None) for k in self.conf}
        for k, v in self.conf.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def _start(self, stream: DataFrame, trigger: dict) -> list:
        rows = (stream.writeStream.format("parquet").option("checkpointLocation", f"{self.folder}/_rows")
                .trigger(**trigger).start(f"{self.folder}/rows"))
        if not self.specs:
            return [rows]

        def sink(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.folder}/values/epoch={epoch}")

        values = (self.values(stream).writeStream.outputMode("update").foreachBatch(sink)
                  .option("checkpointLocation", f"{self.folder}/_values").trigger(**trigger).start())
        return [rows, values]

    def drain(self, stream: DataFrame) -> "RunningChecks":
        """Take in all that is available now."""
        with self._settings():
            for q in self.start(stream, availableNow=True):
                q.awaitTermination()
                if q.exception() is not None:
                    raise RuntimeError(str(q.exception()))
        return self

    # ------------------------------------------------------------ what it gave
    def history(self) -> DataFrame:
        """All values kept: those folded by ``compact`` and those of later batches."""
        folded = max((int(n.split("=")[1]) for n in child_folders(self.spark, f"{self.folder}/folded", finished=True)), default=None)
        parts = []
        if folded is not None:
            parts.append(self.spark.read.parquet(f"{self.folder}/folded/upto={folded}"))
        if child_folders(self.spark, f"{self.folder}/values"):
            later = self.spark.read.parquet(f"{self.folder}/values").withColumn("epoch", F.col("epoch").cast("long"))
            parts.append(later if folded is None else later.where(F.col("epoch") > folded))
        if not parts:
            raise ValueError(f"no batch has been taken in yet: {self.folder}")
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _last(self, rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
        return (rows.groupBy(*keys).agg(F.max_by(F.struct(*values, "epoch"), "epoch").alias("last"))
                .select(*keys, *[F.col(f"last.{v}").alias(v) for v in [*values, "epoch"]]))

    def frame(self, members: list[int], key_names: list[str], value_names: list[str]) -> DataFrame:
        """Last values of one grouping, under the names a check asks for."""
        family = next(f for f, (_, all_members) in enumerate(self.families) if members[0] in all_members)
        keys = self._keys(family)
        last = self._last(self.history().where(F.col("family") == family), keys, [f"v{i}" for i in members])
        return last.select(*[F.col(k).alias(n) for k, n in zip(keys, key_names)],
                           *[F.col(f"v{i}").alias(n) for i, n in zip(members, value_names)])

    def annotate(self, rows: DataFrame | None = None) -> DataFrame:
        """The stream's rows (or other rows) with ``_errors`` and ``_warnings`` by the last values."""
        rows = self.spark.read.parquet(f"{self.folder}/rows") if rows is None else rows
        return apply_checks(rows, self.rules, self.refs, self.run_config_name, running=self if self.specs else None)

    def corrections(self) -> DataFrame:
        """Verdicts on groups that a batch turned: ``epoch, name, key, failing, value``.

        ``key`` is JSON of the group's key values. Rules whose limit depends on
        the row have no verdict of their own for a group and are left out.
        After ``compact`` the folded batches count as one.
        """
        history, out = self.history(), []
        for f, (_, members) in enumerate(self.families):
            keys = self._keys(f)
            for i in members:
                spec = self.specs[i]
                if isinstance(spec.limit, (str, Column)):
                    continue
                failing = F.coalesce(spec.compare(F.col(f"v{i}"), to_value(spec.limit)), F.lit(False))
                if spec.row_condition is not None:   # uniqueness: a key with a NULL is no duplicate
                    failing = failing & all_of(F.col(k).isNotNull() for k in keys)
                order = Window.partitionBy(*keys).orderBy("epoch") if keys else Window.partitionBy("family").orderBy("epoch")
                named = F.struct(*[F.col(k).alias(str(g)) for k, g in zip(keys, spec.groups)]) if keys else F.struct()
                out.append(history.where(F.col("family") == f).withColumn("failing", failing)
                           .withColumn("before", F.coalesce(F.lag("failing").over(order), F.lit(False)))
                           .where(F.col("failing") != F.col("before"))
                           .select("epoch", F.lit(self.names[i]).alias("name"),
                                   F.to_json(named, {"ignoreNullFields": "false"}).alias("key") if keys else F.lit("{}").alias("key"),
                                   "failing", F.col(f"v{i}").cast("string").alias("value")))
        if not out:
            return self.spark.createDataFrame([], "epoch long, name string, key string, failing boolean, value string")
        whole = out[0]
        for part in out[1:]:
            whole = whole.unionByName(part)
        return whole

    def compact(self) -> None:
        """Fold the values of all batches so far into the last one of each group, while no query runs."""
        history = self.history()
        keys = ["family", *[k for f in range(len(self.families)) for k in self._keys(f)]]
        newest = history.agg(F.max("epoch")).first()[0]
        if newest is None:
            return
        self._last(history, keys, [f"v{i}" for i in self.specs]).write.mode("overwrite").parquet(f"{self.folder}/folded/upto={newest}")
        # readers take the newest finished folder from here on
        for name in child_folders(self.spark, f"{self.folder}/folded"):
            if name != f"upto={newest}":
                delete_folder(self.spark, f"{self.folder}/folded/{name}")
        for name in child_folders(self.spark, f"{self.folder}/values"):
            if name.startswith("epoch=") and int(name.split("=")[1]) <= newest:
                delete_folder(self.spark, f"{self.folder}/values/{name}")
