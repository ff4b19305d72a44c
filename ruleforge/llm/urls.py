"""URL filter: host and path rules, and logistic regression on hashed character n-grams.

Everything is a DataFrame or SQL expression. Rules are matched by lookup: the
suffixes of the host that name a rule's host, then the longest rule whose
path begins the url's path. Where no rule fits, a linear model on hashed
character n-grams of host and path decides: ``pyspark.ml``'s hashing and logistic
regression, trained on a small labelled url table and applied row by row in
the JVM; its ``2**bits`` weights are of a fixed size.

Cases: a null url, or one without ``://``, has an empty host and path, no
rule, and the model's verdict for the empty text; repeated rows give a row
each; empty tables give no rows; other columns are left aside. Without both
labels in the labelled table there is nothing to learn: the model allows.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpoint, col

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS = 14                 # 2**BITS hashed features
SIZES = (3, 4, 5)         # n-gram lengths
LABEL_BOUND = 4000        # labelled urls that are fitted at most, the first by hash
#: the rules of the registered query, as (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Longest fitting rule as text and its verdict; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def ngrams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, which have spaces of their own."""

    def grams(tag: str, text: Column, n: int) -> Column:
        def of(raw: Column) -> Column:
            last = (F.octet_length(raw) / 2 - n).cast("int")
            places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda i: F.concat(F.lit(tag), F.hex(F.substring(raw, i * 2 + 1, F.lit(2 * n)))))

        # two bytes a character, so that a substring is reached in constant time; bound once by the outer function
        return F.flatten(F.transform(F.array(F.encode(text, "UTF-16BE")), of))

    return F.concat(*[grams(tag, F.concat(F.lit("^"), text, F.lit("$")), n) for tag, text in (("h", host), ("p", path)) for n in SIZES])


def featured(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows of host and path with the hashed n-grams as a sparse vector ``features``."""
    return (HashingTF(numFeatures=1 << bits, binary=True, inputCol="_grams", outputCol="features")
            .transform(rows.withColumn("_grams", ngrams(F.col("host"), F.col("path")))).drop("_grams"))


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "label", bits: int = BITS,
        bound: int = LABEL_BOUND) -> LogisticRegressionModel | None:
    """The model, label 1 standing for block; None without both labels."""
    host, path = host_path(col(url_col).cast("string"))
    rows = (labelled.select(host.alias("host"), path.alias("path"), col(label_col).cast("double").alias("label"))
            .filter(F.col("label").isNotNull()).distinct().orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(bound))
    rows = checkpoint(rows)
    if rows.select("label").distinct().count() < 2:
        return None
    return LogisticRegression(maxIter=30, regParam=0.01, standardization=False).fit(featured(rows, bits).select("features", "label"))


def judge(df: DataFrame, model: LogisticRegressionModel | None, id_col: str = "page_id", url_col: str = "url",
          rules=RULES, bits: int = BITS) -> DataFrame:
    """Id, host, path, rule, verdict and the model's log-odds of block (null where a rule decides, or without a model)."""
    host, path = host_path(col(url_col).cast("string"))
    rows = df.select(col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_ruled", verdict)
    odds = F.lit(None).cast("double")
    if model is not None:
        rows = model.transform(featured(rows, bits))
        odds = F.when(F.col("_ruled").isNull(), F.get(vector_to_array("rawPrediction"), F.lit(1)))
    rows = rows.withColumn("log_odds", odds)
    return rows.select(F.col("_id").alias(id_col), "host", "path", "rule",
                       F.coalesce("_ruled", F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"), "log_odds")


def labelled_by_rules(df: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """A labelled url table: the urls that rules decide, with label 1 for block."""
    host, path = host_path(col(url_col).cast("string"))
    _, verdict = rule_of(F.col("_h"), F.col("_p"), rules)
    return (df.select(col(url_col).alias("url"), host.alias("_h"), path.alias("_p")).withColumn("_v", verdict)
            .filter(F.col("_v").isNotNull()).select("url", (F.col("_v") == "block").cast("int").alias("label")))
