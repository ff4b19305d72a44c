"""Quality rules: counted text statistics, and perplexity bands by language.

The perplexity is that of a modified Kneser-Ney model which Spark counts over
all texts that aren't full of symbols (``kneser_ney``). Its levels are kept as arrays sorted by hash; they
are broadcast when their checked size is under ``BROADCAST_ENTRIES``, and
beyond it the scores come from the sharded joins of ``classifier``, with the
same values. A language's band runs from its lower to its upper fence:
quantiles of the documents that pass the counted rules, widened by a multiple
of their distance. Scores of short texts are drawn towards their language's
median, since a few bytes say little.

Cases: null text counts as empty: no words, failed, not kept; a null language
is a language of its own; a language without passing documents has no band
and rejects by the counted rules only; repeated rows give a row each; an
empty table gives no rows; only id, text and language are read.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from .classifier import sharded_scores, shrunk
from .common import col, id_type, map_batches, stage, texts_of
from .kneser_ney import HashArray, count_ngrams, estimate, log_probs, text_scores

BROADCAST_ENTRIES = 8_000_000   # 12 bytes each
FENCE_LOW, FENCE_HIGH = 10.0, 6.0  # quartile distances below and above the quartiles
SYMBOL_SHARE = 0.05             # texts with more symbols than this part of their characters don't teach the model
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
WINDOW = 8


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    window = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        window = (window ^ h[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        window ^= window >> np.uint64(29)
    by = np.argsort(window, kind="stable")
    same = window[by[1:]] == window[by[:-1]]
    if not same.any():
        return 0
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    starts = by[np.r_[same, False] | np.r_[False, same]]
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def statistics(text: str) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows."""
    words = text.encode("utf-8", "replace").split()
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(SPACES):
            seen.add(line)
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), again, repeated_words(words))


def hash_arrays(levels: list[tuple[DataFrame, DataFrame]]) -> list[tuple[HashArray, HashArray]] | None:
    """The model's levels as arrays; None if they are larger than may be broadcast."""
    if sum(t.count() for pair in levels for t in pair) > BROADCAST_ENTRIES:
        return None

    def held(t: DataFrame, key: str) -> HashArray:
        rows = t.select(key, F.col("v").cast("float").alias("v")).toArrow()
        return HashArray(rows.column(0).to_numpy().astype(np.int64), rows.column(1).to_numpy())

    return [(held(p, "gram"), held(w, "ctx")) for p, w in levels]


def scored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Statistics and perplexity of every whole text: id, lang, n_words, ..., n_bytes, score (null for an empty text)."""
    rows = df.select(col(id_col).alias("_id"), col(text_col).cast("string").alias("_text"), col(lang_col).cast("string").alias("_lang"))
    symbols = F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))
    levels = estimate(count_ngrams(rows.filter(symbols <= SYMBOL_SHARE * F.length("_text"))))
    arrays = hash_arrays(levels)
    if arrays is None:
        scores = sharded_scores(rows, levels, keep=("_text",))
        schema_extra, model = ", n_bytes bigint, score double", None
    else:
        scores, schema_extra, model = rows, ", n_bytes bigint, score double", df.sparkSession.sparkContext.broadcast(arrays)
    schema = (f"_id {id_type(rows, '_id')}, _lang string, n_words bigint, word_chars bigint, n_symbols bigint, "
              f"n_dup_lines bigint, n_repeat_words bigint{schema_extra}")

    def run(batch):
        texts = texts_of(batch)
        stats = list(zip(*map(statistics, texts))) or [[]] * 5
        out = {"_id": batch.column("_id"), "_lang": batch.column("_lang")}
        out |= dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), stats))
        if model is None:
            return out | {"n_bytes": batch.column("n_bytes"), "score": batch.column("score")}
        values, sizes = text_scores(texts, lambda g: log_probs(g, model.value))
        return out | {"n_bytes": sizes, "score": [None if np.isnan(v) else float(v) for v in values]}

    return map_batches(scores, schema, run)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          below: float = FENCE_LOW, above: float = FENCE_HIGH) -> DataFrame:
    """Counted statistics, ``base_failed``, ``log_ppl`` with its language's band, and ``kept``."""
    rows = stage(scored(df, id_col, text_col, lang_col), "quality")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    middle = rows.filter(~F.col("base_failed")).groupBy("_lang").agg(F.percentile_approx("score", 0.5, 10000).alias("_mid"))
    rows = rows.join(middle.select(F.col("_lang").alias("_l0"), "_mid"), F.col("_lang").eqNullSafe(F.col("_l0")), "left")
    rows = rows.withColumn("log_ppl", shrunk(F.col("score"), F.col("n_bytes"), F.col("_mid")))
    bands = rows.filter(~F.col("base_failed")).groupBy("_lang").agg(F.percentile_approx("log_ppl", [0.25, 0.75], 10000).alias("_q"))
    low, high = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    bands = bands.select(F.col("_lang").alias("_l1"), (low - below * (high - low)).alias("band_low"), (high + above * (high - low)).alias("band_high"))
    rows = rows.join(bands, F.col("_lang").eqNullSafe(F.col("_l1")), "left")
    fits = F.col("band_low").isNull() | F.col("log_ppl").between(F.col("band_low"), F.col("band_high"))
    return rows.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       (~F.col("base_failed") & F.coalesce(fits, F.lit(False))).alias("kept"), "log_ppl", "band_low", "band_high")
