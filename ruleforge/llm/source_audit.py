"""How far each source's use of words lies from other sources and from its whole language.

Terms are counted by language and source. What is shuffled for that is of
fixed width: a term travels as a 64-bit digest with its counts, never as text.
Each task also writes every term once beside its digest; from those rows the
least and the greatest text of each kept digest are taken. Where they differ,
texts collide: the documents' terms of such digests are counted once more by
text, and the digest is split. Texts are joined back only for the rows that
can reach the report.

The pairs of sources are compared block by block of terms: a block holds a
table of terms by sources of bounded size, and gives one partial sum for each
pair of sources, so no row is ever made for a pair and a term.

Cases: null text, language and source count as ''; texts of any length are
read whole; repeated rows count as documents of their own; ties are ordered by
the item's UTF-8 bytes; an empty table gives no rows, a source without kept
terms still has its pairs (value 0 where the language keeps no term); only the
three columns named are read, so other columns may have any names.
"""

from __future__ import annotations

from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import col, release, ship, stage

ENTRIES = 500_000      # terms by group that a task counts before it hands them on
CELLS = 1 << 17        # terms x sources of one block
SCALE_STEPS = (1000, 1000, 1000)   # their product is 1,000,000,000: shares in billionths, divided digit by digit
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and of characters above U+007F in UTF-8, A-Z in lower case."""
    return text.translate(LETTERS).split()


def counts(df: DataFrame, lang_col: str, source_col: str, text_col: str, bits: int, with_text: bool) -> DataFrame:
    """Partial counts by language, source and term digest; ``term`` on every row, or only once for each digest handed on."""
    ship(df.sparkSession)
    mask = (1 << bits) - 1
    target = pa.schema([("lang", pa.string()), ("source", pa.string()), ("digest", pa.int64()), ("n", pa.int64()),
                        ("df", pa.int64()), ("term", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        uses: dict[tuple[str, str], Counter] = {}
        docs: dict[tuple[str, str], Counter] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            digests: dict[bytes, int] = {}
            for group, found in uses.items():
                texts: list[str | None] = []
                for term in found:
                    if (new := term not in digests):
                        d = xxhash.xxh64_intdigest(term) & mask
                        digests[term] = d - (1 << 64) if d >> 63 else d
                    texts.append(term.decode("utf-8", "replace") if new or with_text else None)
                size, seen = len(found), docs[group]
                yield pa.RecordBatch.from_arrays([
                    pa.array([group[0]] * size, pa.string()), pa.array([group[1]] * size, pa.string()),
                    pa.array([digests[t] for t in found], pa.int64()), pa.array(list(found.values()), pa.int64()),
                    pa.array([seen[t] for t in found], pa.int64()), pa.array(texts, pa.string())], schema=target)
            uses.clear()
            docs.clear()

        entries = 0
        for batch in batches:
            groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for group, text in zip(groups, batch.column(2)):
                words = terms_of(text.as_py() or b"")
                if group not in uses:
                    uses[group], docs[group] = Counter(), Counter()
                entries -= len(uses[group])
                uses[group].update(words)
                docs[group].update(set(words))
                entries += len(uses[group])
                if entries >= ENTRIES:
                    yield from handed()
                    entries = 0
        yield from handed()

    rows = df.select(named(lang_col).alias("lang"), named(source_col).alias("source"),
                     F.encode(named(text_col), "UTF-8").alias("text"))
    return rows.mapInArrow(run, "lang string, source string, digest bigint, n bigint, df bigint, term string")


def named(name: str) -> Column:
    return F.coalesce(col(name).cast("string"), F.lit(""))


def share(n, total, floor_div):
    """1 + floor(1,000,000,000 * n / total) for 0 <= n <= total, without a product above 1000 * total."""
    out, rest = 0, n
    for step in SCALE_STEPS:
        rest = rest * step
        digit = floor_div(rest, total)
        out, rest = out * step + digit, rest - digit * total
    return out + 1


def column_div(a: Column, b: Column) -> Column:
    """Whole-number division of non-negative longs."""
    return F.call_function("div", a, b)


def share_column(n: Column, terms: Column, total: Column) -> Column:
    return share(n + 2, total + 2 * terms, column_div)


def divergence(p, q, floor_div):
    return floor_div((p - q) * (p - q), p + q)


def by_term(partial: DataFrame, keys: list[str], least_docs: int) -> DataFrame:
    """Kept terms, one row each: total uses, and uses by source (an array as long as the language has sources)."""
    once = (partial.repartition("lang", *keys).groupBy("lang", *keys, "source")
            .agg(F.sum("n").alias("n"), F.sum("df").alias("df")))
    return (once.groupBy("lang", *keys).agg(F.sum("n").alias("total"), F.sum("df").alias("df"),
                                            F.collect_list(F.struct("source", "n")).alias("uses"))
            .filter(F.col("df") >= least_docs).drop("df"))


def pair_sums(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """Sum of the divergence over all kept terms, for each pair of sources of a language (each pair once)."""
    sizes = (groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("terms").alias("terms"))
             .withColumn("width", F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.col("sources")).cast("long")))
             .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / F.col("width")).cast("long"))))
    blocked = (terms.join(sizes.select("lang", "blocks"), "lang")
               .withColumn("block", F.pmod(F.xxhash64("digest", "split"), "blocks"))
               .select("lang", "block", F.col("uses.source").alias("sources"), F.col("uses.n").alias("n")))
    known = groups.join(sizes.select("lang", "blocks"), "lang").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "total", "terms")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        names = sorted(right.column("source").to_pylist())
        at = {s: i for i, s in enumerate(names)}
        order = np.array([at[s] for s in right.column("source").to_pylist()])
        base = np.zeros(len(names), dtype=np.int64)
        base[order] = right.column("total").to_numpy() + 2 * right.column("terms").to_numpy()
        table = np.zeros((left.num_rows, len(names)), dtype=np.int64)
        lists = left.column("sources").combine_chunks() if left.num_rows else pa.array([], pa.list_(pa.string()))
        row = np.repeat(np.arange(left.num_rows), np.asarray(lists.value_lengths(), dtype=np.int64))
        place = np.array([at[s] for s in lists.flatten().to_pylist()], dtype=np.int64)
        if left.num_rows:
            table[row, place] = left.column("n").combine_chunks().flatten().to_numpy()
        divide = np.floor_divide
        table = share(table + 2, np.maximum(base, 1)[None, :], divide) if left.num_rows else table
        lang = right.column("lang")[0].as_py()
        first, second, value = [], [], []
        for i in range(len(names) - 1):
            rest = divergence(table[:, i:i + 1], table[:, i + 1:], divide).sum(axis=0) if left.num_rows else np.zeros(len(names) - 1 - i, np.int64)
            first += [names[i]] * len(rest)
            second += names[i + 1:]
            value.append(rest)
        return pa.table({"lang": pa.array([lang] * len(first), pa.string()), "a": pa.array(first, pa.string()),
                         "b": pa.array(second, pa.string()),
                         "value": pa.array(np.concatenate(value) if value else [], pa.int64())})

    partial = (blocked.groupBy("lang", "block").cogroup(known.groupBy("lang", "block"))
               .applyInArrow(compare, "lang string, a string, b string, value bigint"))
    return partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
          least_docs: int = 10, top: int = 10, bits: int = 64) -> DataFrame:
    """The report: ``lang, source, part, item, value, rank``.

    Part ``pair`` has every other source of the language, part ``term`` the
    ``top`` kept terms that the source uses more than its language does.
    ``bits`` is the width of the digests; fewer only make collisions common.
    """
    groups = df.select(named(lang_col).alias("lang"), named(source_col).alias("source")).distinct()
    partial = stage(counts(df, lang_col, source_col, text_col, bits, with_text=False), "audit-counts")
    kept = stage(by_term(partial.drop("term"), ["digest"], least_docs), "audit-kept")
    ends = stage(partial.filter("term IS NOT NULL").select("digest", "term")
                 .join(kept.select("digest").distinct(), "digest", "left_semi")
                 .groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high")), "audit-ends")
    release(partial)
    whole = F.lit(None).cast("string").alias("split")
    terms = kept.select("lang", "digest", whole, "total", "uses")
    collided = ends.filter("low <> high").select("digest")
    if not collided.isEmpty():
        again = counts(df, lang_col, source_col, text_col, bits, with_text=True).join(collided, "digest", "left_semi")
        split = by_term(again.withColumnRenamed("term", "split"), ["digest", "split"], least_docs)
        terms = stage(terms.join(collided, "digest", "left_anti").unionByName(split.select(*terms.columns)), "audit-terms")

    uses = terms.select("lang", "digest", "split", "total", F.explode("uses").alias("use")).select(
        "lang", "digest", "split", F.col("total").alias("lang_n"), "use.source", "use.n")
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    sums = stage(groups.join(langs, "lang", "left")
                 .join(uses.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
                 .na.fill(0, ["terms", "lang_total", "total"]), "audit-groups")

    once = pair_sums(terms, sums)
    pairs = once.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), "value"),
                                                 F.struct(F.col("b").alias("source"), F.col("a").alias("item"), "value"))))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value",
                         F.row_number().over(order).alias("rank"))

    p, q = F.col("p"), F.col("q")
    scored = (uses.join(sums, ["lang", "source"])
              .withColumn("p", share_column(F.col("n"), F.col("terms"), F.col("total")))
              .withColumn("q", share_column(F.col("lang_n"), F.col("terms"), F.col("lang_total")))
              .filter(p > q).withColumn("value", divergence(p, q, column_div)))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    near_top = scored.withColumn("place", F.rank().over(by_value)).filter(F.col("place") <= top)
    texts = near_top.join(ends, "digest", "left").select("lang", "source", F.lit("term").alias("part"),
                                                         F.coalesce("split", "low").alias("item"), "value")
    top_terms = texts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.unionByName(top_terms)


#: The whole report in DuckDB's SQL.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
grp AS (SELECT DISTINCT lang, source FROM d),
tok AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM tok GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
sized AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
uses AS (SELECT lang, source, term, count(*) AS n FROM tok SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (
  SELECT grp.lang, grp.source, coalesce(sum(uses.n), 0)::HUGEINT AS total FROM grp LEFT JOIN uses USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT t.lang, t.source, k.term, coalesce(u.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 2)) // (t.total + 2 * s.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 2)) // (s.total + 2 * s.v) AS q
  FROM totals t JOIN kept k USING (lang) JOIN sized s USING (lang) LEFT JOIN uses u USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item,
    coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) FROM shares x JOIN shares y USING (lang, term)
              WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source),
terms AS (
  SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms
  QUALIFY rank <= 10)
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked
"""
