"""Interpolated modified Kneser-Ney over byte n-grams, counted and normalised by Spark.

An n-gram of up to ``ORDER`` bytes packs into one long, exactly, so suffix
and context are bit operations and every statistic is a DataFrame aggregate.
A text is read with ``ORDER - 1`` zero bytes before it; zero bytes of the text
itself count as byte 1.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpoint, col, ship, slices

ORDER = 5
CHUNK = 1 << 17    # n-grams of a text that are looked up at once
FLUSH = 1_000_000  # n-grams that a counting task holds before it merges them


def buffer_of(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each after its padding, with the place of each text's first byte and its length."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    pad = b"\0" * (order - 1)
    if any(b"\0" in r for r in raw):
        raw = [r.replace(b"\0", b"\1") for r in raw]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    starts = np.cumsum(sizes + len(pad)) - sizes
    return np.frombuffer(pad + pad.join(raw) if raw else b"", dtype=np.uint8), starts, sizes


def packed(data: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The packed n-gram that ends at each byte from the ``order``-th on; those ending in padding have a last byte 0."""
    if len(data) < order:
        return np.empty(0, dtype=np.int64)
    out = data[: len(data) - order + 1].astype(np.int64)
    for k in range(1, order):
        out <<= 8
        out |= data[k: len(data) - order + 1 + k]
    return out


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys together."""
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def count_ngrams(texts: DataFrame, text_col: str = "_text", order: int = ORDER) -> DataFrame:
    """``gram``, ``n`` over all whole texts; each task adds up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def add(texts):
            nonlocal size
            grams = packed(buffer_of(texts, order)[0], order)
            grams = np.sort(grams[(grams & 255) != 0])
            if len(grams):
                first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
                held.append((grams[first], np.diff(np.r_[first, len(grams)])))
                size += len(first)
            if size > FLUSH:
                held[:] = [merged(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])

        def out():
            keys, counts = merged(*map(np.concatenate, zip(*held)))
            for k in range(0, len(keys), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k:k + 200_000]), pa.array(counts[k:k + 200_000].astype(np.int64))], names=["gram", "n"])

        for batch in batches:
            for part in slices(batch):
                add([t or "" for t in part.column(0).to_pylist()])
            if size > FLUSH:  # so many different n-grams in one task: pass them on and start again
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    ship(texts.sparkSession)
    return texts.select(col(text_col)).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of a level, from its counts of counts."""
    n1, n2, n3, n4 = (float(x or 0) for x in counts.agg(*[F.sum((F.col("n") == k).cast("long")) for k in (1, 2, 3, 4)]).collect()[0])
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else 1.5
    return tuple(min(max(d, 0.05), top) for d, top in ((d1, 0.95), (d2, 1.9), (d3, 2.85)))


def estimate(counts: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """Per level from 1 to ``order``: log probabilities (``gram``, ``v``) and log back-off weights (``ctx``, ``v``).

    Below the top level the counts are numbers of different left neighbours.
    """
    levels = {order: checkpoint(counts)}
    for k in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        levels[k] = checkpoint(levels[k + 1].groupBy(suffix.alias("gram")).agg(F.count("*").alias("n")))
    out, lower = [], None
    for k in range(1, order + 1):
        d1, d2, d3 = discounts(levels[k])
        n = F.col("n")
        rows = levels[k].withColumn("ctx", F.shiftright("gram", 8))
        contexts = rows.groupBy("ctx").agg(F.sum("n").alias("total"), *[F.sum((n == j).cast("long")).alias(f"n{j}") for j in (1, 2)],
                                           F.sum((n >= 3).cast("long")).alias("n3"))
        contexts = contexts.select("ctx", "total", ((d1 * F.col("n1") + d2 * F.col("n2") + d3 * F.col("n3")) / F.col("total")).alias("gamma"))
        own = F.greatest(n - F.when(n == 1, d1).when(n == 2, d2).otherwise(d3), F.lit(0.0)) / F.col("total")
        rows = rows.join(contexts, "ctx")
        if lower is None:
            probs = rows.select("gram", (own + F.col("gamma") / 256).alias("p"))
        else:
            rows = rows.withColumn("low", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)))
            rows = rows.join(lower.select(F.col("gram").alias("low"), F.col("p").alias("p_low")), "low")
            probs = rows.select("gram", (own + F.col("gamma") * F.col("p_low")).alias("p"))
        lower = checkpoint(probs)
        out.append((lower.select("gram", F.log("p").alias("v")), checkpoint(contexts.select("ctx", F.log("gamma").alias("v")))))
    return out


LOWEST = float(np.log(1 / 256))  # below level 1: all bytes alike


class HashArray:
    """Values by key in arrays sorted by a 64-bit hash of the key, with an index on the hash's top bits."""

    MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, so that different keys keep different hashes

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = self.mix(keys)
        by = np.argsort(hashes)
        self.hashes, self.values = hashes[by], values[by].astype(np.float32)
        bits = max(1, int(np.ceil(np.log2(max(2, len(keys))))) + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.longest = int(np.diff(self.first).max())

    @classmethod
    def mix(cls, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * cls.MIX
        h ^= h >> np.uint64(32)
        return h * cls.MIX

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of each key and where one was found."""
        values, found = np.zeros(len(keys), dtype=np.float32), np.zeros(len(keys), dtype=bool)
        if not len(self.hashes) or not len(keys):
            return values, found
        h = self.mix(keys)
        slot = (h >> self.shift).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        todo = np.flatnonzero(at < end)
        at, end, h = at[todo], end[todo], h[todo]
        while len(todo):
            hit = self.hashes[at] == h
            found[todo[hit]] = True
            values[todo[hit]] = self.values[at[hit]]
            at = at + 1
            on = ~hit & (at < end)
            todo, at, end, h = todo[on], at[on], end[on], h[on]
        return values, found


def log_probs(grams: np.ndarray, levels: list[tuple[HashArray, HashArray]]) -> np.ndarray:
    """Log probability of the last byte of each packed n-gram, backing off where one was never seen."""
    out = np.zeros(len(grams), dtype=np.float64)
    todo = np.arange(len(grams))
    for k in range(len(levels), 0, -1):
        probs, weights = levels[k - 1]
        keys = grams[todo] & ((1 << 8 * k) - 1)
        values, found = probs.get(keys)
        out[todo[found]] += values[found]
        todo, keys = todo[~found], keys[~found]
        out[todo] += weights.get(keys >> 8)[0]  # a context never seen passes all of its weight on: log 1
    out[todo] += LOWEST
    return out


def text_scores(texts: list[str], value_of, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Mean negative log probability per byte of each text (nan for an empty one), and its bytes."""
    data, starts, sizes = buffer_of(texts, order)
    count = max(0, len(data) - order + 1)
    if not count:
        return np.full(len(texts), np.nan), sizes
    sums = np.zeros(count + 1)
    for k in range(0, count, CHUNK):  # a very long text is looked up in parts
        end = min(k + CHUNK, count)
        sums[k + 1:end + 1] = value_of(packed(data[k:end + order - 1], order))
    np.cumsum(sums, out=sums)
    first = starts - (order - 1)  # the n-gram that ends at a text's first byte
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(sizes > 0, -(sums[np.minimum(first + sizes, count)] - sums[np.minimum(first, count)]) / np.maximum(sizes, 1), np.nan), sizes
