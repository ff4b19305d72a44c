"""Fuzzy line deduplication by MinHash, in DataFrame expressions only.

Lines are similar by their character shingles. A line's signature holds the
least hashes, for ``BANDS * ROWS`` hash functions, of all its overlapping
shingles of ``GRAM`` characters, those that verification compares. Lines that
agree in a whole band meet in its bucket. In a bucket all are first paired with
its most central line; then each that is still apart from the bucket's largest
component is paired with all of the bucket's lines in other components, in
blocks. So no bucket leaves out a pair that could join two components, and a
family of near copies, in however many buckets, makes no square of pairs.

Buckets are kept as keys and numbers of shingles only, which leave out pairs
that differ too much in size; bitmaps are made once, for the lines that share a
bucket, and brought to pairs of keys, but in larger buckets to the lines. Texts
are read again, for the lines of the pairs that are left. Pairs are screened by
parity bitmaps of their different shingles: each flips a bit, those of both lines cancel, and a bit in which they
differ takes a shingle that only one has, so that lines whose bitmaps differ in
more bits than similar lines may in shingles are not similar. What is left is
verified by the exact Jaccard similarity of those shingles. Verified pairs, and
equal lines, form components by distributed union-find, and each component
keeps its first line by id and line number.

Equal lines are brought together before anything else, with map-side
aggregation, so a line that a third of the documents hold is one row.

Cases: null or empty text has no lines; lines without a visible character are
left as they are and belong to no component; a line without letters or digits
is compared as a whole; the order among ids puts null first; rows repeated
with the same id and text are decided alike; an empty table gives no rows;
only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import checkpoint, col, free_name, release
from .components import connected

BANDS, ROWS = 12, 4       # at a similarity of 0.8 a pair meets in some band with probability 0.998, at 0.7 with 0.96
GRAM = 5                  # characters of a shingle
FEW = 2                   # lines of a bucket that are paired each with each
SMALL = 16                # lines of a bucket whose pairs are made of keys, and get their bitmaps by join
BLOCK = 1024              # lines of a larger bucket that a task pairs with the rest of it at once
WORDS = 16                # longs of a line's bitmap
SIMILARITY = 0.8
BROADCAST_KEYS = 4_000_000  # line keys are broadcast up to so many

_VISIBLE = r"[^\x20\x09-\x0D]"


def lines_of(rows: DataFrame) -> DataFrame:
    """``_id``, ``rk`` (row key), ``no``, ``line``, ``lk`` (line key) of every line with a visible character."""
    lines = rows.select("_id", "rk", F.posexplode(F.split("_text", "\n", -1)).alias("no", "line"))
    return lines.filter(F.col("line").rlike(_VISIBLE)).withColumn("lk", F.xxhash64("line"))


def gram_hashes(line: Column) -> Column:
    """Hashes of the different overlapping shingles; the whole line if it is shorter."""
    def hashes(raw: Column) -> Column:
        last = F.greatest((F.octet_length(raw) / 2 - GRAM).cast("int"), F.lit(0))
        return F.transform(F.sequence(F.lit(1), last * 2 + 1, F.lit(2)), lambda i: F.xxhash64(F.substring(raw, i, F.lit(2 * GRAM))))

    # two bytes a character, so that a substring is reached in constant time; bound once by the outer function
    return F.array_distinct(F.flatten(F.transform(F.array(F.encode(line, "UTF-16BE")), hashes)))


def signed(lines: DataFrame) -> DataFrame:
    """``lk`` and ``bks`` (bucket in each band) of every different line."""
    different = lines.groupBy("lk").agg(F.min("line").alias("line")).select("lk", F.encode("line", "UTF-16BE").alias("raw"))
    last = F.greatest((F.octet_length("raw") / 2 - GRAM).cast("int"), F.lit(0))
    places = different.select("lk", "raw", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    shingles = places.select("lk", F.xxhash64(F.substring("raw", F.col("i") * 2 + 1, F.lit(2 * GRAM))).alias("h"))
    made = []
    for k in range(BANDS * ROWS // 2):  # two 32-bit hash functions from each 64-bit one
        x = F.xxhash64(F.col("h").bitwiseXOR(F.lit(0x5851F42D4C957F2D * (k + 1) % (1 << 62))))
        made += [F.min(x.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"m{2 * k}"), F.min(F.shiftrightunsigned(x, 32)).alias(f"m{2 * k + 1}")]
    bands = [F.xxhash64(F.lit(b), *[f"m{b * ROWS + r}" for r in range(ROWS)]) for b in range(BANDS)]
    return shingles.groupBy("lk").agg(*made).select("lk", F.array(*bands).alias("bks"))


def mapped(texts: DataFrame) -> DataFrame:
    """``lk``, ``n`` (different shingles) and ``bits`` (parity bitmap: each of them flips a bit) of different lines."""
    shingles = texts.select("lk", F.explode(gram_hashes(F.col("line"))).alias("h"))
    word, bit = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(WORDS - 1)), F.expr("shiftleft(1L, cast(h & 63L AS int))")
    made = [F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"b{k}") for k in range(WORDS)]
    return shingles.groupBy("lk").agg(F.count("*").alias("n"), *made).select("lk", "n", F.array(*[f"b{k}" for k in range(WORDS)]).alias("bits"))


def bucketed(marks: DataFrame) -> DataFrame:
    """``bk``, its ``size``, and ``lk`` of every line that shares the bucket ``bk`` with another."""
    # written first, so that the shuffles of sizes and of lines are not on disk together
    sizes = checkpoint(marks.select(F.explode("bks").alias("bk")).groupBy("bk").agg(F.count("*").alias("size")).filter("size > 1"))
    members = checkpoint(marks.select("lk", F.explode("bks").alias("bk")).join(sizes, "bk"))
    release(sizes)
    return members


def only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose ``lk`` is among the different ``keys``."""
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return rows.join(keys, "lk", "left_semi")


def texts_of(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """``lk`` and ``line`` of the different lines with these keys."""
    return only(lines.select("lk", "line"), keys).groupBy("lk").agg(F.min("line").alias("line"))


def alike(a: Column, b: Column, similarity: float) -> Column:
    """Whether two lines with so many different shingles may be similar."""
    return F.abs(a - b) <= (a + b) * ((1 - similarity) / (1 + similarity)) + 1e-6


def near(a: str, b: str, similarity: float) -> Column:
    """Whether the bitmaps of two rows differ in no more bits than similar lines may in shingles."""
    apart = sum((F.bit_count(F.col(a + ".bits")[k].bitwiseXOR(F.col(b + ".bits")[k])) for k in range(1, WORDS)),
                F.bit_count(F.col(a + ".bits")[0].bitwiseXOR(F.col(b + ".bits")[0])))
    return apart <= (F.col(a + ".n") + F.col(b + ".n")) * ((1 - similarity) / (1 + similarity)) + 1e-6


def unordered(pairs: DataFrame) -> DataFrame:
    """The different pairs ``u`` < ``v``."""
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct()


def paired(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``u`` < ``v`` of lines that share a bucket, have different ``root``s and may be similar by their numbers of shingles."""
    one, two = (members.select("bk", *[F.col(c).alias(s + c) for c in ("lk", "n", "root")]) for s in "uv")
    pairs = one.join(two, "bk").filter("ulk < vlk and uroot <> vroot").filter(alike(F.col("un"), F.col("vn"), similarity))
    return pairs.select(F.col("ulk").alias("u"), F.col("vlk").alias("v"))


def blocked(split: DataFrame, marks: DataFrame, maps: DataFrame, similarity: float) -> DataFrame:
    """Screened pairs ``u``, ``v`` of larger buckets: each line apart from the bucket's ``main`` component with all in other components, in blocks."""
    keys = checkpoint(split.select("lk").distinct())
    held = checkpoint(only(maps, keys).join(marks, "lk"))
    split = split.drop("n")
    rest = split.filter("root <> main").withColumn("block", F.pmod(F.xxhash64("lk"), F.col("blocks")).cast("int")).join(held, "lk")
    whole = split.join(held, "lk").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # of two lines that are both apart from the largest component, one order is enough
    apart = whole.alias("a").join(rest.alias("b"), ["bk", "block"]).filter(F.col("a.root") != F.col("b.root")).filter((F.col("a.root") == F.col("a.main")) | (F.col("a.lk") < F.col("b.lk")))
    # screened before they are brought together, since they may be many, and each in the first of the buckets that both share:
    # lines of different components are paired in all of these, here or among the smaller ones
    first = F.array_intersect("a.bks", "b.bks")[0] == F.col("bk")
    close = alike(F.col("a.n"), F.col("b.n"), similarity) & near("a", "b", similarity)
    pairs = checkpoint(unordered(apart.filter(close & first).select(F.col("a.lk").alias("u"), F.col("b.lk").alias("v"))))
    release(keys, held)
    return pairs


def screened(pairs: DataFrame, maps: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``u``, ``v`` that their bitmaps leave open."""
    for k, s in (("a", "u"), ("b", "v")):
        pairs = pairs.join(maps.select(F.col("lk").alias(s), F.struct("n", "bits").alias(k)), s)
    return pairs.filter(near("a", "b", similarity)).select("u", "v")


def verified(pairs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``u``, ``v`` of line keys that are similar."""
    asked = pairs = checkpoint(pairs)
    wanted = checkpoint(pairs.select(F.col("u").alias("lk")).union(pairs.select("v")).distinct())
    texts = checkpoint(texts_of(lines, wanted))
    for s in ("u", "v"):
        pairs = pairs.join(texts.select(F.col("lk").alias(s), F.col("line").alias("line_" + s)), s)
    # exploded, so that the hashes are made once and not in every condition anew
    sets = F.struct(gram_hashes(F.col("line_u")).alias("a"), gram_hashes(F.col("line_v")).alias("b"))
    pairs = pairs.select("u", "v", F.explode(F.array(sets)).alias("x")).select("u", "v", F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    pairs = pairs.select("u", "v", F.size("a").alias("a"), F.size("b").alias("b"), F.size(F.array_intersect("a", "b")).alias("both"))
    found = checkpoint(pairs.filter(F.col("both") >= similarity * (F.col("a") + F.col("b") - F.col("both"))).select("u", "v"))
    release(asked, wanted, texts)
    return found


def similar(lines: DataFrame, similarity: float = SIMILARITY, few: int = FEW, block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """Verified pairs of line keys: those that join the components of all similar lines that share a bucket.

    Central is the line whose buckets have the most members in all: where
    near copies come from one line, that line, or the closest to it.
    """
    marks = checkpoint(signed(lines))
    found = bucketed(marks)
    keys = checkpoint(found.select("lk").distinct())
    maps = checkpoint(mapped(texts_of(lines, keys)))
    members = checkpoint(found.join(maps.select("lk", F.col("n").cast("int")), "lk"))
    release(found, keys)
    large = members.filter(F.col("size") > few)
    pairs = paired(members.filter(F.col("size") <= few).withColumn("root", F.col("lk")), similarity)
    if large.isEmpty():
        links = verified(screened(unordered(pairs), maps, similarity), lines, similarity)
        release(marks, members, maps)
        return links
    weight = members.groupBy("lk").agg(F.sum("size").alias("weight"))
    centre = large.join(weight, "lk").groupBy("bk").agg(F.max(F.struct("weight", "lk", "n")).alias("c")).select("bk", F.col("c.lk").alias("v"), F.col("c.n").alias("vn"))
    star = large.join(centre, "bk").filter(alike(F.col("n"), F.col("vn"), similarity)).select(F.col("lk").alias("u"), "v")
    asked = checkpoint(unordered(pairs.union(star)))
    links = verified(screened(asked, maps, similarity), lines, similarity)
    release(asked)
    roots = connected(links).select(F.col("node").alias("lk"), "root")
    rooted = checkpoint(large.join(roots, "lk", "left").select("bk", "lk", "n", "size", F.coalesce("root", "lk").alias("root")))
    release(members)
    parts = rooted.groupBy("bk", "root").agg(F.count("*").alias("m")).groupBy("bk").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.max("m").alias("m"))
    split = checkpoint(rooted.join(parts, "bk").filter("size > m").withColumn("blocks", F.ceil((F.col("size") - F.col("m")) / block).cast("int")).drop("m"))
    release(rooted)
    asked = checkpoint(unordered(paired(split.filter(F.col("size") <= small), similarity)))
    more = screened(asked, maps, similarity)
    large = split.filter(F.col("size") > small)
    if not large.isEmpty():
        more = more.union(blocked(large, marks, maps, similarity)).distinct()
    links = links.union(verified(more, lines, similarity))
    release(marks, maps, split, asked)
    return links


def dropped_lines(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``rk`` and ``dropped``, the numbers of the row's lines that go, for rows that lose any."""
    lines = lines_of(rows)
    roots = connected(similar(lines, similarity)).select(F.col("node").alias("lk"), "root")
    places = lines.select("lk", F.struct("_id", "no", "rk").alias("place"))
    first = places.groupBy("lk").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    first = first.join(roots, "lk", "left").filter("n > 1 or root is not null")
    first = checkpoint(first.select("lk", F.coalesce("root", "lk").alias("root"), "first"))
    kept = first.groupBy("root").agg(F.min("first").alias("kept"))
    kept = first.join(kept, "root").select("lk", "kept")
    gone = places.join(kept, "lk").filter(~((F.col("place.no") == F.col("kept.no")) & (F.col("place.rk") == F.col("kept.rk"))))
    return gone.groupBy(F.col("place.rk").alias("rk")).agg(F.array_sort(F.collect_set("place.no")).alias("dropped"))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    return df.withColumns({"_id": col(id_col), "_text": text}).withColumn("rk", F.xxhash64("_id", "_text"))


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Id, ``n_lines`` (with a visible character), ``n_dropped`` and ``dropped`` (line numbers from 0) of every row."""
    rows = keyed(df.select(col(id_col), col(text_col)), id_col, text_col).select("_id", "_text", "rk")
    gone = dropped_lines(rows, similarity)
    sizes = rows.select("_id", "rk", F.size(F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(_VISIBLE))).alias("n_lines"))
    empty = F.array().cast("array<int>")
    return (sizes.join(gone, "rk", "left").withColumn("dropped", F.coalesce("dropped", empty))
            .select(F.col("_id").alias(id_col), "n_lines", F.size("dropped").alias("n_dropped"), "dropped"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, lost_col: str = "_lost") -> DataFrame:
    """The table with the repeated lines cut out of its texts; other columns, whatever their names, and the number of rows stay.

    ``lost_col``, which the table must not have, tells whether a row lost all its visible lines.
    """
    if lost_col in df.columns:
        raise ValueError(f"the table has a column {lost_col!r}: name another for what was lost")
    key, cut = free_name(df, "_line_key"), free_name(df, "_line_cut")
    whole = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = df.withColumn(key, F.xxhash64(col(id_col), whole))
    gone = dropped_lines(rows.select(col(id_col).alias("_id"), whole.alias("_text"), col(key).alias("rk")), similarity)
    rows = rows.join(gone.select(F.col("rk").alias(key), F.col("dropped").alias(cut)), key, "left")
    parts = F.split(whole, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(cut))
    text = F.when(F.col(cut).isNull(), col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    # told by counts, not by the new text: Spark may evaluate a second copy of an expression with a lambda wrongly
    seen = F.size(F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(_VISIBLE)))
    lost = F.col(cut).isNotNull() & (F.size(F.col(cut)) == seen)
    plain = [col(c) if c != text_col else text.alias(text_col) for c in df.columns]
    return rows.select(*plain, lost.alias(lost_col))
