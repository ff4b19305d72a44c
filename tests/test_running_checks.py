"""Uniqueness and aggregate checks over several batches of a stream."""

import pytest

from ruleforge.plans.apply import apply_checks, summarize
from ruleforge.session import child_folders
from ruleforge.streaming.checks import file_stream
from ruleforge.streaming.running import RunningChecks

SCHEMA = "id long, k string, g int, v int"


def rule(function, name, criticality="error", filter=None, **arguments):
    return {"name": name, "criticality": criticality, "filter": filter, "check": {"function": function, "arguments": arguments}}


RULES = [rule("is_unique", "k_unique", columns=["k"]),
         rule("is_unique", "k_unique_with_nulls", columns=["k"], nulls_distinct=False),
         rule("is_unique", "kg_unique", "warn", columns=["k", "g"]),
         rule("is_aggr_not_greater_than", "sum_cap", column="v", aggr_type="sum", group_by=["g"], limit=10),
         rule("is_aggr_not_less_than", "min_floor", "warn", column="v", aggr_type="min", group_by=["g"], limit=0),
         rule("is_aggr_equal", "two_rows", aggr_type="count", group_by=["g"], limit=2, filter="v > 0"),
         rule("is_aggr_not_equal", "not_the_max", "warn", column="v", aggr_type="max", group_by=["k"], limit="v"),
         rule("is_aggr_not_greater_than", "total_cap", "warn", column="v", aggr_type="sum", limit=20),
         rule("is_not_null", "v_given", column="v"),
         rule("foreign_key", "k_known", columns=["k"], ref_columns=["k"], ref_df_name="known")]
BATCHES = [[(1, "a", 1, 4), (2, "b", 1, 7), (3, None, 2, 1)],
           [(4, "a", 2, 2), (5, None, 3, None), (6, "c", None, 5)],
           [(7, "a", 1, -8), (8, "d", None, 3), (9, "d", None, 3)]]


def add_file(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def plain(df):
    """Names of errors and warnings by id; messages too."""
    return sorted((r["id"], sorted((i["name"], i["message"]) for i in r["_errors"] or []), sorted((i["name"], i["message"]) for i in r["_warnings"] or []))
                  for r in df.collect())


@pytest.fixture(scope="module")
def taken_in(spark, tmp_path_factory):
    """A stream drained after each new file, so that later runs go on from kept state; the compaction test, the last, changes it."""
    refs = {"known": spark.createDataFrame([("a",), ("d",)], "k string")}
    tmp_path = tmp_path_factory.mktemp("stream")
    folder, checks = str(tmp_path / "in"), RunningChecks(spark, RULES, str(tmp_path / "out"), refs)
    for rows in BATCHES:
        add_file(spark, folder, rows)
        checks.drain(file_stream(spark, folder, "*.parquet", SCHEMA, files_per_batch=1))
    return checks, refs, folder


def test_last_verdicts_are_the_batch_answer(spark, taken_in):
    checks, refs, folder = taken_in
    want = plain(apply_checks(spark.read.schema(SCHEMA).parquet(folder), RULES, refs))
    assert plain(checks.annotate()) == want
    assert any("k_unique" in [n for n, _ in e] for _, e, _ in want) and len(child_folders(spark, checks.folder + "/values")) == 3


def test_corrections_go_both_ways(taken_in):
    checks, _, _ = taken_in
    got = {(r["epoch"], r["name"], r["key"], r["failing"]) for r in checks.corrections().collect()}
    assert {(1, "k_unique", '{"k":"a"}', True), (0, "sum_cap", '{"g":1}', True), (2, "sum_cap", '{"g":1}', False),
            (2, "min_floor", '{"g":1}', True), (2, "kg_unique", '{"k":"a","g":1}', True), (1, "k_unique_with_nulls", '{"k":null}', True),
            (1, "two_rows", '{"g":null}', True), (2, "two_rows", '{"g":null}', True)} - got == {(2, "two_rows", '{"g":null}', True)}
    assert not [x for x in got if x[1] == "k_unique" and "null" in x[2]] and not [x for x in got if x[1] == "not_the_max"]


def test_batch_run_again_overwrites_its_values(spark, taken_in):
    checks, refs, folder = taken_in
    before = plain(checks.annotate())
    spark.read.parquet(f"{checks.folder}/values/epoch=2").write.mode("overwrite").parquet(str(checks.folder) + "/copy")
    spark.read.parquet(str(checks.folder) + "/copy").write.mode("overwrite").parquet(f"{checks.folder}/values/epoch=2")
    assert plain(checks.annotate()) == before


def test_rules_without_a_running_form_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        RunningChecks(spark, [rule("compare_datasets", "c", columns=["id"], ref_columns=["id"], ref_df_name="r")], str(tmp_path))


def test_one_stateful_aggregation_reads_the_source_once(spark, tmp_path, taken_in):
    checks, _, folder = taken_in
    plan = checks.values(file_stream(spark, folder, "*.parquet", SCHEMA))._jdf.queryExecution().analyzed().toString()
    assert plan.count("Aggregate") == 1 and plan.count("FileSource") == 1


def test_only_row_rules_need_no_values(spark, tmp_path):
    add_file(spark, str(tmp_path / "in"), BATCHES[1])
    checks = RunningChecks(spark, [RULES[8]], str(tmp_path / "out")).drain(file_stream(spark, str(tmp_path / "in"), "*.parquet", SCHEMA))
    assert [r["error_checks"] for r in summarize(checks.annotate(), ["id"]).sort("id").collect()] == [None, "v_given", None]


def test_compaction_keeps_verdicts_and_lets_the_stream_go_on(spark, taken_in):
    checks, refs, folder = taken_in
    before = plain(checks.annotate())
    checks.compact()
    assert child_folders(spark, checks.folder + "/values") == [] and plain(checks.annotate()) == before
    add_file(spark, folder, [(10, "b", 1, 1)])
    checks.drain(file_stream(spark, folder, "*.parquet", SCHEMA, files_per_batch=1))
    assert plain(checks.annotate()) == plain(apply_checks(spark.read.schema(SCHEMA).parquet(folder), RULES, refs))
    checks.compact()
    assert child_folders(spark, checks.folder + "/folded", finished=True) == ["upto=3"]


def test_files_and_state_partitions_grow_with_the_events(spark, monkeypatch, tmp_path):
    from pyspark.sql import functions as F
    from ruleforge.plans.suite import streams
    made = spark.range(1000).selectExpr("if(id % 97 = 0, null, id % 900) AS event_id", "id % 60 AS user_id", "concat('t', id % 7) AS event_type")
    made.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    events = spark.read.parquet(f"{tmp_path}/events.parquet")
    most, seen = events.count() // 20, []
    start = RunningChecks.start
    monkeypatch.setattr(RunningChecks, "start", lambda self, stream, **t: seen.append((self, start(self, stream, **t))) or seen[-1][1])
    rules = [rule("is_unique", "user_type", columns=["user_id", "event_type"])]
    got = streams._running(spark, str(tmp_path), rules, file_rows=most)
    checks, (_, values) = seen[0]
    want = summarize(apply_checks(events, rules), ["event_id"])
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    sizes = [r["n"] for r in spark.read.parquet(f"{checks.folder}/rows").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == events.count() and max(sizes) <= 2 * most, sizes
    assert values.recentProgress[0]["stateOperators"][0]["numShufflePartitions"] >= 20 and len(values.recentProgress) >= 3
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
