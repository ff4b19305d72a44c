"""Quality classifier: perplexity under a Kneser-Ney model of trusted text, with limits by language.

The model is counted over the trusted texts only. Scoring joins counts
shard-wise: documents are dealt into blocks of a bounded number of bytes, each
block names its different n-grams once, those are joined with the model's
tables (hash-sharded by n-gram), and the values return to their block, where
every document is scored. No table of the model is ever held whole. A
document is kept when its score is at most its language's limit: the upper
quantile of the trusted documents' scores plus a multiple of the distance
between quantiles, so that trusted-like documents stay.

Cases: null or empty text has no score and is not kept; a null language is a
language of its own; a language without trusted documents takes the limit
over all languages; without any trusted text nothing is judged: all with text
are kept; repeated rows give a row each, repeated labels count once; an empty
table gives no rows; only id, text, language and the label columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpoint, col, id_type
from .kneser_ney import LOWEST, ORDER, buffer_of, count_ngrams, estimate, packed, text_scores

BLOCK_BYTES = 48_000_000   # texts of a block
PRIOR_BYTES = 60           # weight of the language's median in a document's score
BROADCAST_IDS = 4_000_000  # trusted ids are broadcast up to so many, and joined by shuffle beyond
UPPER, SPREAD = 0.75, 5.0  # limit: this quantile plus so many distances to the lower quartile


def shrunk(score: Column, size: Column, middle: Column) -> Column:
    """A score drawn towards the middle, as by ``PRIOR_BYTES`` more bytes that score like it."""
    return F.coalesce((score * size + middle * PRIOR_BYTES) / (size + PRIOR_BYTES), score)


def resolve(grams: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``gram``, ``v``: log probability of each different n-gram's last byte, by joins with the model's tables."""
    order = len(levels)
    done, todo = None, grams.select("gram", F.col("gram").alias("_key"), F.lit(0.0).alias("_sum"))
    for k in range(order, 0, -1):
        probs, weights = levels[k - 1]
        todo = todo.withColumn("_key", F.col("_key").bitwiseAND(F.lit((1 << 8 * k) - 1)))
        todo = checkpoint(todo.join(probs.select(F.col("gram").alias("_key"), F.col("v").alias("_p")), "_key", "left"))
        hit = todo.filter(F.col("_p").isNotNull()).select("gram", (F.col("_sum") + F.col("_p")).alias("v"))
        done = hit if done is None else done.unionByName(hit)
        todo = (todo.filter(F.col("_p").isNull()).drop("_p").withColumn("_ctx", F.shiftright("_key", 8))
                .join(weights.select(F.col("ctx").alias("_ctx"), F.col("v").alias("_w")), "_ctx", "left")
                .select("gram", "_key", (F.col("_sum") + F.coalesce("_w", F.lit(0.0))).alias("_sum")))
    return done.unionByName(todo.select("gram", (F.col("_sum") + LOWEST).alias("v")))


def sharded_scores(rows: DataFrame, levels: list[tuple[DataFrame, DataFrame]], keep: tuple[str, ...] = (),
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``_id``, ``_lang``, the columns of ``keep``, ``n_bytes`` and ``score`` of each row of ``_id``, ``_text``, ``_lang``."""
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks)).cast("int")).repartition(blocks, "_block")

    def names(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for b in np.unique(ids):
                    grams = packed(buffer_of([texts[i] for i in np.flatnonzero(ids == b)])[0])
                    own = held.setdefault(int(b), [])
                    own.append(np.unique(grams[(grams & 255) != 0]))
                    if len(own) > 1 and sum(map(len, own)) > 4_000_000:
                        held[int(b)] = [np.unique(np.concatenate(own))]
        for b, own in held.items():
            grams = np.unique(np.concatenate(own))
            for k in range(0, len(grams), 200_000):
                part = grams[k:k + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), b, dtype=np.int32)), pa.array(part)], names=["_block", "gram"])

    needed = checkpoint(dealt.select("_block", "_text").mapInArrow(names, "_block int, gram bigint"))
    values = needed.join(resolve(needed.select("gram").distinct(), levels), "gram").select("_block", "gram", F.col("v").cast("float").alias("v"))
    fields = ["_id", "_lang", *keep]
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{f} {kinds[f]}" for f in fields) + ", n_bytes bigint, score double"

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, v = right.column("gram").to_numpy(), right.column("v").to_numpy().astype(np.float64)
        by = np.argsort(keys)
        keys, v = keys[by], v[by]

        def value_of(grams):
            if not len(keys):
                return np.zeros(len(grams))
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            return np.where(keys[at] == grams, v[at], 0.0)  # only n-grams that end in padding have none

        out, sizes = [], []
        for k in range(0, left.num_rows, 256):
            s, n = text_scores([t or "" for t in left.column("_text").slice(k, 256).to_pylist()], value_of)
            out += [None if np.isnan(x) else float(x) for x in s]
            sizes += n.tolist()
        return pa.table([left.column(f) for f in fields] + [pa.array(sizes, pa.int64()), pa.array(out, pa.float64())], names=[*fields, "n_bytes", "score"])

    return dealt.groupBy("_block").cogroup(values.groupBy("_block")).applyInArrow(score, schema)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids labelled good and not toxic; an id with contrary labels isn't trusted."""
    return (labels.groupBy(col(id_col).alias("_tid")).agg(F.min("quality").alias("_q"), F.max("toxic").alias("_t"))
            .filter("_tid is not null and _q = 1 and coalesce(_t, 0) = 0").select("_tid"))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Id, ``lang``, ``n_bytes``, ``log_ppl``, ``ppl_limit``, ``trusted`` and ``kept``."""
    from .common import stage

    rows = df.select(col(id_col).alias("_id"), col(text_col).cast("string").alias("_text"), col(lang_col).cast("string").alias("_lang"))
    ids = checkpoint(trusted_ids(labels, id_col))
    small = ids.count() <= BROADCAST_IDS
    known = F.broadcast(ids) if small else ids
    good = rows.join(known, F.col("_id") == F.col("_tid"), "left_semi")
    levels = estimate(count_ngrams(good))
    scores = stage(sharded_scores(rows, levels, block_bytes=block_bytes), "classifier")
    scores = scores.join(known, F.col("_id") == F.col("_tid"), "left").withColumn("trusted", F.col("_tid").isNotNull()).drop("_tid")
    mid = scores.filter("trusted").groupBy("_lang").agg(F.percentile_approx("score", 0.5, 10000).alias("_mid"))
    scores = scores.join(mid.select(F.col("_lang").alias("_l0"), "_mid"), F.col("_lang").eqNullSafe(F.col("_l0")), "left")
    scores = scores.withColumn("log_ppl", shrunk(F.col("score"), F.col("n_bytes"), F.col("_mid"))).drop("_l0", "_mid")

    def limit(q: Column) -> Column:
        return F.get(q, F.lit(1)) + SPREAD * (F.get(q, F.lit(1)) - F.get(q, F.lit(0)))

    own = scores.filter("trusted").groupBy("_lang").agg(F.percentile_approx("log_ppl", [1 - UPPER, UPPER], 10000).alias("_q"))
    whole = scores.filter("trusted").agg(F.percentile_approx("log_ppl", [1 - UPPER, UPPER], 10000).alias("_q")).first()[0]
    scores = scores.join(own.select(F.col("_lang").alias("_l1"), limit(F.col("_q")).alias("_limit")), F.col("_lang").eqNullSafe(F.col("_l1")), "left")
    rest = F.lit(float(whole[1] + SPREAD * (whole[1] - whole[0])) if whole else None).cast("double")
    scores = scores.withColumn("ppl_limit", F.coalesce("_limit", rest))
    return scores.select(F.col("_id").alias(id_col), F.col("_lang").alias("lang"), "n_bytes", "log_ppl", "ppl_limit", "trusted",
                         (F.col("log_ppl").isNotNull() & F.coalesce(F.col("log_ppl") <= F.col("ppl_limit"), F.lit(True))).alias("kept"))
