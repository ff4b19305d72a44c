"""Spelling variants: words one edit apart, and the commoner word that a rarer one stands for.

A word is a vector of letter counts. One replaced letter changes that vector by
a squared distance of 2, one inserted or deleted letter by 1, so words one edit
apart are at most 2 apart, in the same or the next length. Letters fall into
three classes; words with the same number of letters of each class form a cell
(all of one length), and one edit leads to the same cell or to one of a few
fixed neighbours. A cell is cut by hash into blocks of bounded bytes. For each
pair of blocks of neighbouring cells one task multiplies the count matrices
(squared distance = |a|^2 + |b|^2 - 2ab), keeps pairs at most 2 apart and
verifies the edit on the letters. No pair is missed: cells and distance are
necessary conditions, and all pairs of blocks are looked at.

Forms are followed to the last by doubling: each round a word's target is
replaced by its target's target. Counts at least double from word to form, so
chains are short and without cycles.

Cases: null text has no words, a null id counts as ''; texts and words of any
length are taken whole; repeated rows count again; of several nearest words
with the same count the smallest in code-point order is the form; an empty
table gives no rows; only the id and text columns are read, so other columns
may have any names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import combinations
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import col, release, ship, stage

ENTRIES = 500_000        # different words that a task counts before it hands them on
MODULUS = 97             # a run loses a letter where this divides its hash
BLOCK_BYTES = 4096 * 96  # of count vectors and letters in a block: 4096 words, fewer where they are long
STRIP = 512              # rows of a product at a time
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))  # Latin-1
ALPHABET = [*range(97, 123), *range(192, 256)]
CLASSES = ["".join(map(chr, ALPHABET[k::3])) for k in range(3)]
#: What one edit adds to the class counts, seen from the left word of a pair: nothing, a letter of another class, or one letter more.
STEPS = [(0, 0, 0)] + [tuple((k == i) - (k == j) for k in range(3)) for i, j in combinations(range(3), 2)] + \
        [tuple(int(k == i) for k in range(3)) for i in range(3)]


def count_words(uses: Counter, doc_id: str, text: str, least: int) -> None:
    """Add a text's words, in Latin-1 (one byte a letter); runs that lose a letter are rare, and moved afterwards."""
    runs = [r for r in text.encode("latin-1", "replace").translate(LOWERED).split() if len(r) >= least]
    uses.update(runs)
    start = zlib.crc32(f"{doc_id}:".encode())
    for run in set(runs):
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % MODULUS == 0:
            at, times = h % len(run), runs.count(run)
            uses[run] -= times
            if len(run) > least:
                uses[run[:at] + run[at + 1:]] += times


def words(df: DataFrame, id_col: str, text_col: str, least_letters: int, least_uses: int) -> DataFrame:
    """The different words with their number of uses, ``word, n``."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: Counter = Counter()

        def handed() -> pa.RecordBatch:
            kept = [(w.decode("latin-1"), n) for w, n in uses.items() if n]
            uses.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                if (whole := text.as_py()) is not None:
                    count_words(uses, doc_id.as_py() or "", whole, least_letters)
                if len(uses) >= ENTRIES:
                    yield handed()
        yield handed()

    rows = df.select(col(id_col).cast("string").alias("id"), col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_uses)


def letters(found: list[str]) -> np.ndarray:
    """Words of one length as rows of Latin-1 codes."""
    return np.frombuffer("".join(found).encode("latin-1"), dtype=np.uint8).reshape(len(found), -1)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Count vectors; squares and products of counts are exact in the type chosen."""
    place = np.zeros(256, dtype=np.int64)
    place[ALPHABET] = np.arange(len(ALPHABET))
    flat = place[codes] + np.arange(len(codes))[:, None] * len(ALPHABET)
    table = np.bincount(flat.ravel(), minlength=len(codes) * len(ALPHABET)).reshape(len(codes), -1)
    return table.astype(np.float32 if codes.shape[1] < 2048 else np.float64)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` and ``b`` differ by exactly one letter replaced, or inserted in ``b``."""
    size = a.shape[1]
    if b.shape[1] == size:
        return (a != b).sum(axis=1) == 1
    head = np.cumprod(a == b[:, :size], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    tail = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    return head + tail >= size


def near_in_blocks(left: list[str], right: list[str], same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words one edit apart, strip by strip; of a block with itself each pair once."""
    a, b = letters(left), letters(right)
    ca, cb = letter_counts(a), letter_counts(b)
    na, nb = (ca * ca).sum(axis=1), (cb * cb).sum(axis=1)
    for top in range(0, len(left), STRIP):
        apart = na[top:top + STRIP, None] + nb[None, :] - 2 * (ca[top:top + STRIP] @ cb.T)
        i, j = np.nonzero((apart > 0) & (apart <= 2))   # 0: the same letters in another order, never one edit
        i += top
        if same:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), 1 << 16):
            x, y = i[part:part + (1 << 16)], j[part:part + (1 << 16)]
            good = one_edit(a[x], b[y])
            yield x[good], y[good]


def near_pairs(found: DataFrame) -> DataFrame:
    """Every pair of words one edit apart once: ``a, na, b, nb``."""
    def class_count(k: int) -> Column:
        return F.length("word") - F.length(F.translate("word", CLASSES[k], ""))

    rows = found.select("word", "n", *[class_count(k).alias(f"c{k}") for k in range(3)])
    cell = ["c0", "c1", "c2"]
    cells = stage(rows.groupBy(*cell).count().select(
        *cell, F.ceil(F.col("count") * F.greatest(F.col("c0") + F.col("c1") + F.col("c2"), F.lit(96)) / F.lit(BLOCK_BYTES))
        .cast("int").alias("blocks")), "spelling-cells")
    step = F.explode(F.array(*[F.struct(F.lit(k).alias("step"), *[F.lit(v).alias(f"d{i}") for i, v in enumerate(s)])
                               for k, s in enumerate(STEPS)]))
    # neighbouring cells that both exist: the left one's name, the step, and the blocks of both
    meet = (cells.withColumn("s", step).select(*[F.col(c).alias(f"l{c}") for c in cell], F.col("blocks").alias("left_blocks"), "s.step",
                                               *[(F.col(f"c{i}") + F.col(f"s.d{i}")).alias(f"c{i}") for i in range(3)])
            .join(cells.withColumnRenamed("blocks", "right_blocks"), cell))
    place = ["lc0", "lc1", "lc2", "step", "i", "j"]

    def own(blocks: str) -> Column:
        return F.pmod(F.xxhash64("word"), F.col(blocks)).cast("int")

    def upto(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(first, last))

    same = F.col("step") == 0   # of a cell with itself, blocks i <= j
    left = (rows.join(meet.select(*[F.col(f"l{c}").alias(c) for c in cell], "step", "left_blocks", "right_blocks"), cell)
            .select(*[F.col(c).alias(f"l{c}") for c in cell], "step", own("left_blocks").alias("i"), "right_blocks", "word", "n")
            .select("*", upto(F.when(same, F.col("i")).otherwise(0), F.col("right_blocks") - 1).alias("j")))
    right = (rows.join(meet, cell)
             .select(*place[:4], own("right_blocks").alias("j"), "left_blocks", "word", "n")
             .select("*", upto(F.lit(0), F.when(same, F.col("j")).otherwise(F.col("left_blocks") - 1)).alias("i")))

    def compare(both: pa.Table) -> pa.Table:
        a, b = (both.filter(pc.equal(both.column("side"), side)) for side in (0, 1))
        out: list[tuple] = []
        if a.num_rows and b.num_rows:
            first = a.slice(0, 1).to_pylist()[0]
            itself = first["step"] == 0 and first["i"] == first["j"]
            a, b = a.sort_by("word") if itself else a, b.sort_by("word") if itself else b
            x, y, nx, ny = (t.column(c).to_pylist() for c in ("word", "n") for t in (a, b))
            for i, j in near_in_blocks(x, y, itself):
                out += [(x[p], nx[p], y[q], ny[q]) for p, q in zip(i.tolist(), j.tolist())]
        return pa.table({name: pa.array([o[k] for o in out], kind) for k, (name, kind) in enumerate(
            [("a", pa.string()), ("na", pa.int64()), ("b", pa.string()), ("nb", pa.int64())])})

    sides = [t.select(*place, F.lit(side).alias("side"), "word", "n") for side, t in enumerate((left, right))]
    return (sides[0].unionByName(sides[1]).groupBy(*place).applyInArrow(
        compare, "a string, na bigint, b string, nb bigint"))


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the last word that forms lead to, by doubling."""
    known = stage(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("last"))
        if known.join(further, "root", "left_semi").isEmpty():
            return known
        known, old = stage(known.join(further, "root", "left").select("word", F.coalesce("last", "root").alias("root")), "spelling-roots"), known
        release(old)


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 5, least_uses: int = 3) -> DataFrame:
    """One row a word: ``word, form, root, n, n_near, form_n``."""
    found = stage(words(df, id_col, text_col, least_letters, least_uses), "spelling-words")
    pairs = stage(near_pairs(found), "spelling-pairs")
    best = (pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("other"), F.col("nb").alias("times")),
                                          F.struct(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("other"), F.col("na").alias("times")))))
            .groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("times")).alias("rank"), "other")).alias("top"))
            .withColumn("is_form", -F.col("top.rank") >= 2 * F.col("n"))
            .select("word", "n_near", F.when(F.col("is_form"), F.col("top.other")).alias("form"),
                    F.when(F.col("is_form"), -F.col("top.rank")).alias("form_n")))
    best = stage(best, "spelling-forms")
    last = roots(best.filter("form IS NOT NULL"))
    return (found.join(best, "word", "left").join(last, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
