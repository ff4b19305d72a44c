"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ruleforge.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_rules
from ruleforge.llm.common import col, free_name, stage, table

#: None: perplexity, MinHash and merges can't be expressed in SQL; tests/llm/test_pipeline_stages.py compares each stage with a plain version.
ORACLE_SQL = None


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a key of their own, since ids may be null or repeat, and the key's name, which no column of theirs has.

    Rows with the same id and text have the same key: what holds of one holds of the other.
    """
    name = free_name(docs, "_row_key")
    return docs.withColumn(name, F.xxhash64("doc_id", "text")), name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts, and those without words, fail and go; long texts are judged whole; rows that are the
    same stay or go together; an empty table stays empty.
    """
    rows, key = keyed(docs)
    kept = quality_rules.judge(rows, id_col=key).filter("kept").select(col(key)).distinct()
    return rows.join(kept, key, "left_semi").select(*map(col, docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines; a document of which nothing is left goes.

    A line stays where it comes first (by id, then by place in the text). Null and empty texts, which have no
    line to lose, stay as they are; long texts lose lines anywhere; of rows that are the same the lines stay in
    each; an empty table stays empty. ``n_chars``, where there is such a column, counts anew.
    """
    lost = free_name(docs, "_lost")
    rows = line_dedup.deduplicate(docs, lost_col=lost).filter(~F.col(lost)).drop(lost)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*map(col, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingles alike by 0.8 or more: the one with the smallest id.

    Texts without words, null ones too, are like no other and stay; a null id comes before all others; of rows that
    are the same, and of equal ids in a group, one row stays; long texts are compared whole; an empty table
    stays empty.
    """
    rows, key = keyed(docs)
    groups = jaccard_join.components(rows, id_col=key, size=5, percent=80).select(col(key).alias("k"), "component_id")
    best = (groups.join(rows.select("doc_id", col(key).alias("own")), F.col("k").eqNullSafe(F.col("own")))
            .groupBy("component_id").agg(F.min(F.struct("doc_id", "k"))["k"].alias(key)))
    return rows.join(best.select(col(key)), key, "left_semi").dropDuplicates([key]).select(*map(col, docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; long texts are searched whole; rows that are the same stay or go
    together; null and empty items are in no text; an empty table stays empty.
    """
    rows, key = keyed(docs)
    found = decontaminate.leaks(rows, table(spark, sf_dir, "benchmark"), id_col=key).select(col(key)).distinct()
    return rows.join(found, key, "left_anti").select(*map(col, docs.columns))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with their number and digests.

    A null text counts as empty (no tokens); long texts are encoded whole; each row gives one, equal ones too; an
    empty table stays empty.
    """
    return bpe.encode_table(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontaminated), ("BPE encoding and decoding", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"stage{k}")
    return docs
