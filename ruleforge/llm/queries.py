"""Queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (bpe, classifier, decontaminate, jaccard_join, line_dedup, pii, quality_rules, secrets, segment_bpe, source_audit, spelling,
               token_counts, urls)
from .common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digest(pii.find_table(docs, pii.fit(docs)), pii.KINDS)


@query
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digest(secrets.find_table(docs, secrets.fit(docs)), secrets.KINDS)


@query
def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.fit(urls.labelled_by_rules(pages)))


@query
def op4_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_table(table(spark, sf_dir, "documents"), with_ids=False)


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"))


SQL["op7_jaccard"] = jaccard_join.SQL


@query
def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = token_counts.redactions(table(spark, sf_dir, "documents"))
    return token_counts.update(token_counts.build(edited, text_col="_text", edits_col="edits"), keep_tree=False)


@query
def op11_segment_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_bpe.encode_table(table(spark, sf_dir, "documents"), with_ids=False)


@query
def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


SQL["op12_source_audit"] = source_audit.SQL


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))
