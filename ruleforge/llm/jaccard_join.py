"""N-gram Jaccard join: documents linked by the similarity of their word shingles.

Documents are rows of a sparse matrix, shingles its columns, and the overlap
of two documents is an entry of its product with its transpose. The product
is taken blocked, and only where size-derived bounds leave it open:

* Documents with equal sets are one class, represented once.
* With the columns in any fixed order, two documents that link share a column
  among the first ``n - ceil(t n) + 1`` of each. Columns are ordered by hash.
  Overlaps of these prefixes are accumulated by a join on the column; a pair
  is dropped when its sizes differ too much, or when the prefixes alone
  already differ in more columns than linked sets of these sizes may.
* Of what is left, a pair is dropped when the parity bitmaps of its sets (a bit
  for each hash value, flipped by each column that has it) differ in more bits
  than linked sets may in columns: shared columns cancel, and each other one
  flips one bit at most. So nearly all whole sets that are compared do link.
* Columns with more than ``HOT`` prefixes are moved to the end of the order,
  which is exact since any order will do, and the documents that had one take
  their prefix anew, round by round. What a document shares with very many
  others so never makes pairs.
* Documents that consist of hot columns nearly wholly are members of large
  families of near copies. There, each family's most central document is
  compared with all; what it links needs no pairs among itself, and the rest
  is multiplied with the whole family in blocks of bounded size.

Remaining pairs are verified on their whole sets, and the links make
components. No cap drops a pair, so the components are exact (up to 64-bit
hash collisions of shingles or of sets).

Cases: null or empty text, or text without words, has an empty set and is
linked with nothing; fewer words than a shingle make one shingle; repeated
rows are members of one class and give a row each; a null id is ignored when a
component's smallest id is taken; an empty table gives no rows; only the id
and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import checkpoint, col, id_type, map_batches, release, ship, slices, stage, texts_of
from .components import connected

HOT = 256                    # documents with a column in their prefix beyond which it is moved to the end
HOT_COLUMNS = 2_000_000      # columns moved per round at most: the limit above rises with the input to keep this
BROADCAST_KEYS = 4_000_000   # keys of wanted texts are broadcast up to so many
BLOCK, MEMBERS = 256, 4096   # rows of a block of the product, and of the family it is multiplied with


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted different hashes of the word shingles; ASCII case doesn't count."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, dtype=np.int64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64).view(np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    out = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for k in range(size):
        out = (out ^ h[k:k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def set_key(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes(), seed=len(own))).view(np.int64))


def prefix_length(n: int, percent: int) -> int:
    """So many first columns, in any order, of which linked sets share one."""
    return n - -(-percent * n // 100) + 1


def parity(own: np.ndarray) -> np.ndarray:
    """Bitmap of a set in longs, a power of two of them and a bit a column or more: each column flips a bit."""
    words = 1 << max(0, (len(own) - 1) // 64).bit_length()
    bits = np.bincount(own & (words * 64 - 1), minlength=words * 64) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def parity_difference(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two bitmaps differ, at most the columns in which the sets do; the longer one is folded to the other's length."""
    size = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, size), axis=0) for x in (a, b))
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())


class Join:
    """One run: the input rows, the shingle size and the threshold in percent."""

    def __init__(self, rows: DataFrame, size: int, percent: int, hot: int, block: int, members: int):
        self.rows, self.size, self.percent, self.hot, self.block, self.members = rows, size, percent, hot, block, members
        self.spark = rows.sparkSession

    # -- bounds -----------------------------------------------------------
    def allowed(self, a, b):
        """Columns in which linked sets of sizes a and b differ at most."""
        return a + b - 2 * F.ceil((a + b) * self.percent / F.lit(100.0 + self.percent) - 1e-9)

    def fits(self, a, b):
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent

    def linked(self, overlap, a, b):
        return overlap * 100 >= (a + b - overlap) * self.percent

    # -- sets -------------------------------------------------------------
    def classes(self) -> DataFrame:
        """A row per input row: ``_id``, ``rk`` (its key), ``n``, ``cid`` (class); once a class and task, ``cols``, the prefix by hash, and ``bits``."""
        size, percent = self.size, self.percent
        schema = pa.schema([("_id", to_arrow_type(self.rows.schema["_id"].dataType)), ("rk", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()),
                            ("cols", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])

        def run(batches):
            seen: set[int] = set()  # of one task
            for batch in batches:
                for part in slices(batch):
                    out = {k: [] for k in ("n", "cid", "cols", "bits")}
                    for text in texts_of(part):
                        own = shingles(text, size)
                        cid = set_key(own) if len(own) else None
                        new = cid is not None and cid not in seen
                        seen.add(cid)
                        row = (len(own), cid, own[:prefix_length(len(own), percent)] if new else None, parity(own) if new else None)
                        for k, v in zip(out, row):
                            out[k].append(v)
                    columns = [part.column("_id"), part.column("rk")] + [pa.array(out[k], schema.field(k).type) for k in out]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

        ship(self.spark)
        return self.rows.mapInArrow(run, f"_id {id_type(self.rows, '_id')}, rk bigint, n bigint, cid bigint, cols array<bigint>, bits array<bigint>")

    def sets(self, wanted: DataFrame, reps: DataFrame, hot: np.ndarray | None = None) -> DataFrame:
        """Classes of ``wanted`` with their columns, read from the representatives' texts again.

        Without ``hot``: ``cols``, the whole set. With it: ``cols``, the prefix
        outside of the hot columns, ``rest``, the hot columns that complete
        it, and ``spent``, whether there are any.
        """
        keys = checkpoint(reps.join(wanted.select("cid").distinct(), "cid").select("rk"))
        if keys.count() <= BROADCAST_KEYS:
            keys = F.broadcast(keys)
        size, percent = self.size, self.percent
        sent = self.spark.sparkContext.broadcast(hot) if hot is not None else None

        def run(batch):
            out = {"cid": [], "n": [], "cols": [], "rest": [], "spent": []}
            for text in texts_of(batch):
                own = shingles(text, size)
                cid, n = set_key(own), len(own)
                cols, rest = own, []
                if sent is not None:
                    at = np.minimum(np.searchsorted(sent.value, own), len(sent.value) - 1)
                    is_hot = sent.value[at] == own
                    p = prefix_length(n, percent)
                    cols = own[~is_hot][:p]
                    rest = own[is_hot][:p - len(cols)]
                for name, v in (("cid", cid), ("n", n), ("cols", cols), ("rest", rest), ("spent", len(rest) > 0)):
                    out[name].append(v)
            return out

        found = map_batches(self.rows.join(keys, "rk", "left_semi").select("_text"),
                            "cid bigint, n bigint, cols array<bigint>, rest array<bigint>, spent boolean", run)
        return found.dropDuplicates(["cid"]) if self.repeated else found

    # -- the product ------------------------------------------------------
    def having(self, now: DataFrame, found: np.ndarray) -> DataFrame:
        """``cid`` of the classes with one of the columns in their prefix, a row each."""
        if not len(found):
            return now.select("cid").limit(0)
        sent = self.spark.sparkContext.broadcast(found)

        def run(batch):
            cols = batch.column("cols")
            flat = cols.flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(cols)), cols.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(sent.value, flat), len(sent.value) - 1)
            hit = np.unique(owner[sent.value[at] == flat])
            return {"cid": batch.column("cid").to_numpy()[hit]}

        return map_batches(now.select("cid", "cols"), "cid bigint", run)

    def candidates(self, now: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
        """Pairs that one round leaves open, the classes that go on, and the columns found hot."""
        ends = F.when(F.size("cols") > 0, F.element_at("cols", -1))
        cells = now.select("cid", "n", F.size("cols").alias("p"), ends.alias("last"), F.posexplode("cols").alias("at", "h"))
        counts = checkpoint(cells.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1"))
        limit = max(self.hot, -(-(counts.agg(F.sum("c")).first()[0] or 0) // HOT_COLUMNS))
        hot = counts.filter(F.col("c") > limit).select("h")
        found = np.sort(hot.toArrow().column(0).to_numpy().astype(np.int64))  # HOT_COLUMNS at most
        shared = checkpoint(cells.join(counts.filter(F.col("c") <= limit).select("h"), "h"))
        on = checkpoint(self.having(now, found))
        a, b = (shared.select("h", *[F.col(x).alias(x + s) for x in ("cid", "n", "p", "last", "at")]) for s in ("_a", "_b"))
        # the columns up to h that are not shared stand before the pair's first shared one, at least
        pairs = a.join(b, "h").filter((F.col("cid_a") < F.col("cid_b")) & self.fits(F.col("n_a"), F.col("n_b")))
        pairs = pairs.groupBy("cid_a", "cid_b").agg(F.count("*").alias("both"), *[F.max(x + s).alias(x + s) for s in ("_a", "_b") for x in ("n", "p", "last", "at")])
        seen_a = F.when(F.col("last_a") <= F.col("last_b"), F.col("p_a")).otherwise(F.col("at_a") + 1)
        seen_b = F.when(F.col("last_b") <= F.col("last_a"), F.col("p_b")).otherwise(F.col("at_b") + 1)
        for s in ("_a", "_b"):  # a pair that goes on whole is judged in the next round
            pairs = pairs.join(on.select(F.col("cid").alias("cid" + s), F.lit(True).alias("on" + s)), "cid" + s, "left")
        pairs = pairs.filter(F.col("on_a").isNull() | F.col("on_b").isNull())
        pairs = pairs.filter(seen_a + seen_b - 2 * F.col("both") <= self.allowed(F.col("n_a"), F.col("n_b")))
        pairs = checkpoint(pairs.select("cid_a", "cid_b"))
        release(counts, shared)
        return pairs, on, found

    def near(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """The pairs whose parity bitmaps differ in no more bits than linked sets may in columns."""
        for s in ("_a", "_b"):
            pairs = pairs.join(reps.select(F.col("cid").alias("cid" + s), F.col("n").alias("n" + s), F.col("bits").alias("bits" + s)), "cid" + s)
        pairs = pairs.select("cid_a", "cid_b", "bits_a", "bits_b", self.allowed(F.col("n_a"), F.col("n_b")).cast("bigint").alias("most"))

        def run(batch):
            a, b = batch.column("bits_a"), batch.column("bits_b")
            apart = np.array([parity_difference(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(a, b)], dtype=np.int64)
            fits = apart <= batch.column("most").to_numpy()
            return {c: batch.column(c).to_numpy()[fits] for c in ("cid_a", "cid_b")}

        return map_batches(pairs, "cid_a bigint, cid_b bigint", run, rows=4096)

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs that link, by their whole sets."""
        for s in ("_a", "_b"):
            pairs = pairs.join(sets.select(F.col("cid").alias("cid" + s), F.col("n").alias("n" + s), F.col("cols").alias("cols" + s)), "cid" + s)
        overlap = F.size(F.array_intersect("cols_a", "cols_b"))
        return pairs.filter(self.linked(overlap, F.col("n_a"), F.col("n_b"))).select("cid_a", "cid_b")

    def families(self, spent: DataFrame, sets: DataFrame) -> DataFrame:
        """Links among classes that are made of hot columns, so that their components are right."""
        cells = checkpoint(spent.select("cid", (F.size("cols") / F.col("n")).alias("own"), F.explode("rest").alias("h")))
        heads = cells.groupBy("h").agg(F.min(F.struct("own", "cid"))["cid"].alias("head"))
        edges = cells.join(heads, "h").filter("cid <> head").select("cid", "head").distinct()
        family = checkpoint(connected(edges, "cid", "head").select(F.col("node").alias("cid"), F.col("root").alias("fam")))
        whole = stage(sets.join(family, "cid").join(spent.select("cid", F.size("cols").alias("own")), "cid"), "families")
        centre = whole.groupBy("fam").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("own"), F.col("cid").alias("cid")))["cid"].alias("centre"))
        centre = centre.join(whole.select(F.col("cid").alias("centre"), F.col("cols").alias("cols_c"), F.col("n").alias("n_c")), "centre")
        overlap = F.size(F.array_intersect("cols", "cols_c"))
        star = checkpoint(whole.join(centre.select("fam", "centre", "cols_c", "n_c"), "fam")
                          .select("cid", "fam", "centre", self.linked(overlap, F.col("n"), F.col("n_c")).alias("linked")))
        links = star.filter("linked and cid <> centre").select(F.col("cid").alias("cid_a"), F.col("centre").alias("cid_b"))
        # what the centre doesn't link, against the whole family, in blocks
        rest = star.filter("not linked").select("cid", "fam")
        blocks = rest.groupBy("fam").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / self.block).cast("int"))
        chunks = whole.groupBy("fam").agg(F.ceil(F.count("*") / self.members).cast("int").alias("chunks"))
        shape = blocks.select("fam", "blocks").join(chunks, "fam")
        rows = whole.join(shape, "fam").withColumn("i", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")) \
                    .withColumn("j", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("chunks")).cast("int"))
        left = (rows.join(rest.select("cid"), "cid", "left_semi")
                .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("fam", "i", "j", "cid", "n", "cols"))
        right = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
                    .select(*[F.col(x).alias(x + "_m") for x in ("fam", "i", "j", "cid", "n", "cols")])
        percent = self.percent

        def product(few: pa.Table, many: pa.Table) -> pa.Table:
            ids, sizes = few.column("cid").to_numpy(), few.column("n").to_numpy()
            if not len(ids) or not many.num_rows:
                return pa.table({"cid_a": pa.array([], pa.int64()), "cid_b": pa.array([], pa.int64())})
            cols = few.column("cols").combine_chunks()
            flat, owner = cols.flatten().to_numpy(), np.repeat(np.arange(len(ids)), sizes)
            by = np.argsort(flat, kind="stable")
            flat, owner = flat[by], owner[by]
            out_a, out_b = [], []
            for cid, n, own in zip(many.column("cid_m").to_pylist(), many.column("n_m").to_pylist(), many.column("cols_m")):
                own = own.values.to_numpy()
                first, end = np.searchsorted(flat, own), np.searchsorted(flat, own, "right")
                size = end - first
                at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
                overlap = np.bincount(owner[at], minlength=len(ids))
                for k in np.flatnonzero((overlap * 100 >= (sizes + n - overlap) * percent) & (ids != cid)):
                    out_a.append(int(ids[k]))
                    out_b.append(cid)
                if len(out_a) > 4 * (len(ids) + many.num_rows):  # links beyond a spanning forest add nothing
                    out_a, out_b = spanning(out_a, out_b)
            out_a, out_b = spanning(out_a, out_b)
            return pa.table({"cid_a": pa.array(out_a, pa.int64()), "cid_b": pa.array(out_b, pa.int64())})

        more = left.groupBy("fam", "i", "j").cogroup(right.groupBy("fam_m", "i_m", "j_m")).applyInArrow(product, "cid_a bigint, cid_b bigint")
        return checkpoint(links.union(more))

    def run(self) -> DataFrame:
        """``_id``, ``n``, ``component`` of each input row."""
        rows = stage(self.classes(), "shingles")
        reps = rows.filter("cid is not null").groupBy("cid").agg(F.min("rk").alias("rk"), F.min("n").alias("n"),
                                                                 *[F.any_value(c, F.lit(True)).alias(c) for c in ("cols", "bits")])
        now = reps = stage(reps, "classes")
        seen = rows.groupBy("rk").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0]
        self.repeated = bool(seen and seen > 1)
        hot, pairs, prefixes, links = np.empty(0, dtype=np.int64), [], [], []
        while True:
            open_pairs, on, found = self.candidates(now)
            pairs.append(open_pairs)
            if not len(found):
                break
            hot = np.union1d(hot, found)
            now = stage(self.sets(on, reps, hot), "prefixes")
            release(on)
            prefixes.append(now)
        rounds, pairs = pairs, checkpoint(self.near(_union(pairs).distinct(), reps))
        ends = checkpoint(_union([p.filter("spent").select("cid") for p in prefixes]).distinct()) if prefixes else None
        release(on, *rounds, *prefixes)
        ends = ends if ends is not None and not ends.isEmpty() else None
        wanted = pairs.select(F.col("cid_a").alias("cid")).union(pairs.select("cid_b"))
        sets = stage(self.sets(wanted if ends is None else wanted.union(ends), reps), "sets")
        links.append(self.verified(pairs, sets))
        if ends is not None:
            links.append(self.families(stage(self.sets(ends, reps, hot), "spent").filter("spent"), sets))
        links = checkpoint(_union(links))
        release(pairs, sets, reps)
        return self.labelled(rows, links)

    def labelled(self, rows: DataFrame, links: DataFrame) -> DataFrame:
        roots = connected(links, "cid_a", "cid_b").select(F.col("node").alias("cid"), "root")
        least = rows.filter("cid is not null").groupBy("cid").agg(F.min("_id").alias("first"))
        group = least.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        lowest = group.groupBy("root").agg(F.min("first").alias("component"))
        group = group.join(lowest, "root").select("cid", "component")
        return rows.select("_id", "n", "cid").join(group, "cid", "left").select("_id", "n", F.coalesce("component", "_id").alias("component"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def spanning(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """A spanning forest of the links: the same components with fewer links."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(a, b):
        p, q = root(x), root(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return [x for x, _ in out], [y for _, y in out]


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85,
               hot: int = HOT, block: int = BLOCK, members: int = MEMBERS) -> DataFrame:
    """Id, ``n_shingles`` and ``component_id``: the smallest id that links reach, a row's own included."""
    rows = df.select(col(id_col).alias("_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumn("rk", F.xxhash64("_id", "_text"))
    out = Join(rows, size, percent, hot, block, members).run()
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


#: ``components`` of ``documents`` in DuckDB's SQL: sets, overlaps, links by their definition, and what links reach.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) AS s FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
same AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM same JOIN size sx ON sx.doc_id = x JOIN size sy ON sy.doc_id = y WHERE 100 * n_both >= 85 * (sx.n + sy.n - n_both)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM reach r JOIN edge e ON e.x = r.other)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN size USING (doc_id) GROUP BY doc_id, n
"""
