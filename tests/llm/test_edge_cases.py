"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator and stage."""

import pytest

import corpus_pipeline
from ruleforge.llm import bpe, classifier, decontaminate, jaccard_join, line_dedup, pii, quality_rules, queries, secrets, token_counts, urls

#: columns that have the operators' own names as well
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, line string, n long, gram long, h long, kept boolean, lk long, cols long"
LONG = "the long text goes on and on with its words " * 3000


def row(i, text, lang="en"):
    return (i, text, lang, None, None, "x", 1, None, 2, None, 3, 4)


ROWS = [row(1, "a few words of text\nand a second line"), row(1, "a few words of text\nand a second line"), row(2, None), row(3, ""), row(None, "no id here"),
        row(None, None, None), row(4, LONG, None), row(5, " \n\t\n"), row(6, "x" * 20000), row(7, "a few words of text\nand a second line")]


def operators(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, 1, None), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "a few words of text"), (None, None), (2, "")], "item_id long, text string")
    return {"pii": lambda d: pii.digest(pii.find_table(d, pii.fit(d)), pii.KINDS), "secrets": lambda d: pii.digest(secrets.find_table(d, secrets.fit(d)), secrets.KINDS),
            "urls": lambda d: urls.judge(d, urls.fit(urls.labelled_by_rules(d, "text")), "doc_id", "text"), "classifier": lambda d: classifier.classify(d, labels),
            "lines": line_dedup.report, "cut": line_dedup.deduplicate, "quality": quality_rules.judge, "jaccard": jaccard_join.components, "bpe": bpe.encode_table,
            "counts": lambda d: token_counts.update(token_counts.build(token_counts.redactions(d), text_col="_text", edits_col="edits")),
            "leaks": lambda d: decontaminate.leaks(d, bench)}


NAMES = ["pii", "secrets", "urls", "classifier", "lines", "cut", "quality", "jaccard", "bpe", "counts", "leaks"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, name):
    got = operators(spark)[name](spark.createDataFrame(ROWS, SCHEMA)).collect()
    if name == "leaks":
        assert {r.doc_id for r in got} == {1, 7}
    else:
        assert sorted((str(r.doc_id) for r in got)) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert operators(spark)[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_defined_results(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.components(df).collect()]
    assert (2, 0, 2) in got and (3, 0, 3) in got and (7, 6, 1) in got and got.count((1, 6, 1)) == 2 and (None, 1, None) in got
    kept = {r.doc_id: r.kept for r in quality_rules.judge(df).collect()}
    assert not kept[2] and not kept[3] and not kept[5]
    lines = {r.doc_id: r.n_dropped for r in line_dedup.report(df).collect()}
    assert lines[7] == 2 and lines[1] == 0 and lines[2] == 0


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, k):
    step = corpus_pipeline.STAGES[k][1]
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = step(spark, docs, "/root/testdata/sf0.001")
    if k < 4:
        assert got.columns == docs.columns
    got.collect()
    assert step(spark, spark.createDataFrame([], SCHEMA), "/root/testdata/sf0.001").collect() == []


def test_pipeline(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert 0 < len(got) < len(docs) and len({r.doc_id for r in got}) == len(got) and {r.doc_id for r in got} <= set(docs)
    coder = bpe.BacktrackingBpe(bpe.tokenizer_spec())
    for r in got[:20]:  # what is encoded is the text as the stages left it: lines of the original
        assert set(coder.decode(r.ids).split("\n")) <= set(docs[r.doc_id].text.split("\n"))


def test_queries_are_registered():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {x.split("_")[0] + "_" for x in queries.QUERIES} and set(queries.QUERIES) | {"pipeline"} <= names
