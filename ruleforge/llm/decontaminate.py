"""Benchmark decontamination by latent semantic retrieval.

Every text is read in overlapping passages of words. Words are hashed to
``2**BITS`` terms, weighted by inverse document frequency counted over all
passages of the corpus. A randomised SVD, run as Spark jobs over all passages
of all texts, gives their leading latent directions. The benchmark is taken in
blocks of ``BLOCK`` item passages, few enough for the rank, and the passages'
decomposition merged with that of the block's items gives the block's latent
basis. Every passage of every text is projected on each, and a pair is a
candidate where its cosine with a benchmark item's latent vector reaches
``COSINE``, or the passage holds ``SHARE`` of the item's weight (in short items
even a whole copy has a low cosine; there its words must stand within twice the
item's length). A candidate is checked by the longest common subsequence of words between item and
passage, and by the item's answer, its last sentence: a copy is nearly the
whole item in order; a paraphrase is a good part of it together with the
answer.

The benchmark is a query set: ``PASS_BLOCKS`` blocks take a pass over the
texts. What is broadcast is the bases and items of one pass, of fixed size.

Cases: null or empty text, and items without words, match nothing; repeated
rows and items give rows each; items with the same text are all reported; an
empty benchmark or corpus gives no rows; only the id and text columns are
read, under names of our own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import col, id_type, map_batches, release, ship, stage

BITS = 14                # terms
RANK = 128               # latent dimensions
STEP, PASSAGE = 32, 64   # words from passage to passage, and in one
BALANCE = 4096           # all passages together weigh as much as so many in the fit
ITEM_WEIGHT = 6.0        # weight of benchmark passages in the fit
COSINE = 0.25            # candidates
SHARE = 0.5              # candidates, too: part of the item's weight that the passage holds
COPY, PARAPHRASE, ANSWER = 0.8, 0.55, 0.8  # parts of the item, or of its answer, in order
PIECE = 1 << 11          # words whose terms make a dense matrix at once
BLOCK, PASS_BLOCKS = 256, 8  # benchmark passages to a basis, and bases to a pass over the texts

_SEPARATORS = b"".join(bytes([b]) for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_CLEAN = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))


def words_of(text: str) -> list[bytes]:
    """Words in ASCII lower case without ASCII punctuation."""
    return text.encode("utf-8", "replace").translate(_CLEAN).split()


def terms_of(words: list[bytes]) -> np.ndarray:
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def survey(docs: DataFrame) -> DataFrame:
    """One pass over all texts: passages by term (``term``, ``n``), passages in all (term -1), and the ``terms`` of every text as 16-bit numbers."""

    def run(batches):
        counts, passages = np.zeros(1 << BITS, dtype=np.int64), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                texts = [words_of(t or "") for t in batch.column(0).slice(k, 256).to_pylist()]
                sizes = np.array([len(w) for w in texts], dtype=np.int64)
                if not sizes.sum():
                    continue
                terms = terms_of([w for ws in texts for w in ws])
                number, n = passages_of(sizes)
                different = np.unique(number << BITS | terms)
                counts += np.bincount(different & ((1 << BITS) - 1), minlength=1 << BITS)
                passages += n
                ends = np.cumsum(sizes)
                raw = [terms[a:b].astype("<u2").tobytes() for a, b in zip(ends - sizes, ends) if b > a]
                yield pa.record_batch({"term": pa.nulls(len(raw), pa.int32()), "n": pa.nulls(len(raw), pa.int64()), "terms": pa.array(raw, pa.binary())})
        used = np.flatnonzero(counts)
        yield pa.record_batch({"term": pa.array(np.r_[used, [-1]], pa.int32()), "n": pa.array(np.r_[counts[used], [passages]], pa.int64()),
                               "terms": pa.nulls(len(used) + 1, pa.binary())})

    ship(docs.sparkSession)
    return docs.select("_text").mapInArrow(run, "term int, n bigint, terms binary")


def passages_of(sizes: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of each word's passage, texts one after the other, and the number of passages."""
    per = -(-sizes // PASSAGE)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(np.cumsum(per) - per, sizes) + inside // PASSAGE, int(per.sum())


def pieces(number: np.ndarray, size: int = PIECE) -> list[tuple[int, int]]:
    """Bounds of runs of about ``size`` words that cut no passage; ``number`` rises."""
    ends = np.searchsorted(number, number[np.arange(size, len(number), size)], "right").tolist()
    bounds = sorted({0, *ends, len(number)})
    return list(zip(bounds, bounds[1:]))


def counted(row: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms used, and the row, place among these, and count of every different (row, term).

    For products as small dense matrices of only the terms used: much
    cheaper than gathering a row of the other factor for every word.
    """
    different, n = np.unique(row << BITS | terms, return_counts=True)
    t = different & ((1 << BITS) - 1)
    place = np.zeros(1 << BITS, dtype=np.int64)
    place[t] = 1
    used = np.flatnonzero(place)
    place[used] = np.arange(len(used))
    return used, different >> BITS, place[t], n


def idf_of(counts: dict[int, int], passages: int) -> np.ndarray:
    idf = np.full(1 << BITS, np.log((passages + 1) / 1.0) + 0.1)
    for t, n in counts.items():
        idf[t] = np.log((passages + 1) / (n + 1.0)) + 0.1
    return idf


def weighted(terms: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF vector of unit length as different terms and values."""
    t, n = np.unique(terms, return_counts=True)
    v = n * idf[t]
    return t, v / max(np.linalg.norm(v), 1e-12)


def latent_factor(texts: DataFrame, idf: np.ndarray, rank: int = RANK, rounds: int = 2, seed: int = 11) -> np.ndarray:
    """``factor`` (rank x terms), so that its transpose times itself is close to that of the TF-IDF matrix of all passages.

    ``texts`` has ``terms``. By randomised subspace iteration: each round
    multiplies the basis by the matrix and its transpose in Spark tasks; the
    products are summed by ranges of terms, and the driver orthonormalises a
    matrix of fixed size. The last product gives the factor (Nystrom).
    """
    size, spark = 1 << BITS, texts.sparkSession
    ranges = 64
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, rank)))[0].astype(np.float32)
    product = np.zeros((size, rank), dtype=np.float32)
    idf_sent = spark.sparkContext.broadcast(idf)
    for k in range(rounds):
        if k:
            basis = np.linalg.qr(product.astype(np.float64))[0].astype(np.float32)
        sent = spark.sparkContext.broadcast(basis)

        def multiply(batches, sent=sent):
            total, basis, idf = np.zeros((size, rank), dtype=np.float32), sent.value, idf_sent.value
            for batch in batches:
                for k in range(0, batch.num_rows, 64):
                    raw = batch.column(0).slice(k, 64).to_pylist()
                    number, _ = passages_of(np.array([len(r) // 2 for r in raw], dtype=np.int64))
                    terms = np.frombuffer(b"".join(raw), dtype="<u2").astype(np.int64)
                    for a, b in pieces(number):
                        used, at, slot, n = counted(number[a:b] - number[a], terms[a:b])
                        w = np.zeros((int(at[-1]) + 1, len(used)), dtype=np.float32)
                        w[at, slot] = n * idf[used][slot]
                        w /= np.sqrt(np.einsum("ij,ij->i", w, w))[:, None]
                        total[used] += w.T @ (w @ basis[used])
            if total.any():
                yield pa.record_batch({"part": pa.array(range(ranges), pa.int32()), "z": pa.array([z.tobytes() for z in np.split(total, ranges)], pa.binary())})

        def add(table: pa.Table) -> pa.Table:
            summed = np.zeros((size // ranges, rank))
            for z in table.column("z"):
                summed += np.frombuffer(z.as_buffer(), dtype=np.float32).reshape(-1, rank)
            return pa.table({"part": table.column("part").slice(0, 1).cast(pa.int32()), "z": pa.array([summed.astype(np.float32).tobytes()], pa.binary())})

        got = texts.select("terms").mapInArrow(multiply, "part int, z binary").groupBy("part").applyInArrow(add, "part int, z binary").toArrow()
        product = np.zeros((size, rank), dtype=np.float32)
        for part, z in zip(got.column("part").to_pylist(), got.column("z").to_pylist()):
            product[part * (size // ranges):(part + 1) * (size // ranges)] = np.frombuffer(z, dtype=np.float32).reshape(-1, rank)
        sent.unpersist()
    values, vectors = np.linalg.eigh(basis.T.astype(np.float64) @ product)
    good = values > 1e-6 * max(values[-1], 1e-12)
    return ((vectors[:, good] / np.sqrt(values[good])).T @ product.T).astype(np.float32)


def latent_basis(factor: np.ndarray, items: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Orthonormal basis (terms x rank): the leading directions of the passages' factor and the items' vectors together."""
    both = np.concatenate([factor, items])
    values, vectors = np.linalg.eigh((both @ both.T).astype(np.float64))
    best = np.argsort(-values)[:rank]
    best = best[values[best] > 1e-6 * max(values[best[0]], 1e-12)]
    return np.linalg.qr(both.T.astype(np.float64) @ (vectors[:, best] / np.sqrt(values[best])))[0].astype(np.float32)


def masks_of(item: list[bytes]) -> dict[bytes, int]:
    """Places of every word of the item as bits."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def common_places(size: int, places: list[int | None]) -> int:
    """Length of the longest common subsequence of an item of ``size`` words and words with these masks, none where the item lacks the word."""
    row = full = (1 << size) - 1
    for m in filter(None, places):
        u = row & m
        row = (row + u | row - u) & full
    return size - row.bit_count()


def common_length(item: list[bytes], words: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit vectors over the item."""
    return common_places(len(item), list(map(masks_of(item).get, words)))


def answer_of(text: str) -> list[bytes]:
    """Words of the last sentence that has four or more; else the last four words."""
    for sentence in reversed(text.replace("\n", " ").replace("?", ".").replace("!", ".").split(".")):
        words = words_of(sentence)
        if len(words) >= 4:
            return words
    return words_of(text)[-4:]


class Items:
    """A block of benchmark items with their latent vectors, in a basis merged from ``factor`` and the items."""

    def __init__(self, rows: list[tuple[object, str]], idf: np.ndarray, factor: np.ndarray, rank: int = RANK):
        self.ids, self.words, self.answers, owner, sparse, norms = [], [], [], [], [], []
        for key, text in rows:
            words = words_of(text or "")
            if not words:
                continue
            terms = terms_of(words)
            for s in range(0, max(1, len(words) - STEP), PASSAGE):
                sparse.append(weighted(terms[s:s + PASSAGE], idf))
                norms.append(np.sqrt((idf[terms[s:s + PASSAGE]] ** 2).sum()))
                owner.append(len(self.ids))
            self.ids.append(key)
            self.words.append(words)
            self.answers.append(answer_of(text))
        self.masks, self.answer_masks = list(map(masks_of, self.words)), list(map(masks_of, self.answers))
        self.owner = np.array(owner, dtype=np.int64)
        self.norms = np.array(norms, dtype=np.float32)
        dense = np.zeros((len(owner), 1 << BITS), dtype=np.float32)
        for k, (t, v) in enumerate(sparse):
            dense[k, t] = v
        if not len(owner):
            return
        basis = latent_basis(factor, ITEM_WEIGHT * dense, rank)
        vectors = dense @ basis
        self.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)
        self.projection = (basis * idf[:, None]).astype(np.float32)
        self.square = (idf * idf).astype(np.float32)


def search(texts: list[str], blocks: list[Items], cosine: float = COSINE) -> list[tuple[int, Items, int, float, float, float, int]]:
    """(text, block, item, cosine, part of the item in order, part of its answer in order, first word of the passage)."""
    words = [words_of(t) for t in texts]
    if not any(words):
        return []
    terms = terms_of([w for ws in words for w in ws])
    return [(f[0], items, *f[1:]) for items in blocks if len(items.owner) for f in search_block(words, terms, items, cosine)]


def search_block(words: list[list[bytes]], terms: np.ndarray, items: Items, cosine: float) -> list[tuple[int, int, float, float, float, int]]:
    texts, sizes = words, np.array([len(w) for w in words], dtype=np.int64)
    # sums over steps of words, then passages of neighbouring steps
    steps = -(-sizes // STEP)
    owner = np.repeat(np.arange(len(texts)), steps)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(steps) - steps, steps)
    first = np.repeat(np.cumsum(sizes) - sizes, steps) + nth * STEP
    hits: dict[tuple[int, int], tuple[float, int]] = {}
    width = PASSAGE // STEP
    chunk = PIECE // STEP
    for a in range(0, len(first), chunk):
        b = min(len(first), a + chunk)
        more = min(len(first), b + width - 1)  # the passages that begin before b reach into the next steps
        end = first[more] if more < len(first) else len(terms)
        rows = np.repeat(np.arange(more - a), np.diff(np.r_[first[a:more], end]))
        used, at, slot, n = counted(rows, terms[first[a]:end])
        w = np.zeros((more - a, len(used)), dtype=np.float32)
        w[at, slot] = n
        y, q = w @ items.projection[used], w @ items.square[used]
        total, norm = y[: b - a].copy(), q[: b - a].copy()
        for k in range(1, width):
            n = min(b - a, more - a - k)
            same = (owner[a:a + n] == owner[a + k:a + k + n]).astype(np.float32)
            total[:n] += y[k:k + n] * same[:, None]
            norm[:n] += q[k:k + n] * same
        norm = np.sqrt(np.maximum(norm, 1e-12))[:, None]
        score = total @ items.vectors.T / norm
        for i, j in zip(*np.nonzero(score >= np.minimum(cosine, SHARE * items.norms / norm))):
            key = (int(owner[a + i]), int(items.owner[j]))
            at = (int(nth[a + i]) * STEP)
            hits.setdefault(key, []).append((float(score[i, j]), at))
    out = []
    for (doc, item), found in hits.items():
        target, answer, best = items.words[item], items.answers[item], None
        for value, at in sorted(found, reverse=True):
            reach = len(target) + 8
            region = words[doc][max(0, at - reach): at + PASSAGE + reach]
            # below the limit the words stand close together, as common ones in order are in any passage
            size = len(region) if value >= cosine else 2 * len(target)
            places, said_masks = list(map(items.masks[item].get, region)), items.answer_masks[item]
            for s in range(0, max(1, len(region) - size // 2), max(1, size // 4)):
                part = common_places(len(target), places[s:s + size]) / len(target)
                if best is None or part >= best[1]:
                    said = common_places(len(answer), list(map(said_masks.get, region[s:s + size]))) / len(answer)
                    if best is None or (part, said) > best[1:3]:
                        best = (value, part, said, at)
                if part == 1.0 or size == len(region):
                    break
            if best[1] == 1.0:
                break
        out.append((doc, item, *best))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
          item_text: str = "text", copy: float = COPY, paraphrase: float = PARAPHRASE, answer: float = ANSWER,
          cosine: float = COSINE) -> DataFrame:
    """A row for each text and benchmark item found in it: ids, ``cosine``, ``lcs``, ``answer`` and ``word`` (where the passage begins)."""
    spark = docs.sparkSession
    rows = docs.select(col(id_col).alias("_id"), col(text_col).cast("string").alias("_text"))

    def sized(batch: pa.RecordBatch):
        return {"_item": batch.column(0), "_text": batch.column(1),
                "_n": [max(1, -(-(len(words_of(t or "")) - STEP) // PASSAGE)) for t in batch.column(1).to_pylist()]}

    items = benchmark.select(col(item_id).alias("_item"), col(item_text).cast("string").alias("_text"))
    items = stage(map_batches(items, f"_item {id_type(items, '_item')}, _text string, _n bigint", sized), "benchmark")
    seen = stage(survey(rows), "survey")
    counts = seen.filter("term is not null").groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_pydict()  # a number per term: of fixed size
    by_term = dict(zip(counts["term"], counts["n"]))
    passages = by_term.get(-1, 0)
    idf = idf_of({t: n for t, n in by_term.items() if t >= 0}, passages)
    factor = latent_factor(seen.filter("terms is not null"), idf) * np.float32(min(1.0, (BALANCE / max(1, passages)) ** 0.5))
    release(seen)
    name, key = id_col.replace("`", "``"), item_id.replace("`", "``")
    schema = f"`{name}` {id_type(rows, '_id')}, `{key}` {id_type(items, '_item')}, cosine double, lcs double, answer double, word bigint"
    out = None
    blocks = max(1, -(-(items.agg(F.sum("_n")).first()[0] or 0) // BLOCK))
    numbered = items.withColumn("_block", F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)))
    for first in range(0, blocks, PASS_BLOCKS):
        held: dict[int, list] = {}
        for r in numbered.filter(F.col("_block").between(first, first + PASS_BLOCKS - 1)).select("_item", "_text", "_block").collect():
            held.setdefault(r[2], []).append((r[0], r[1]))
        sent = spark.sparkContext.broadcast([Items(part, idf, factor) for part in held.values()])

        def run(batch, sent=sent):
            found = search([t or "" for t in batch.column("_text").to_pylist()], sent.value, cosine)
            found = [f for f in found if f[4] >= copy or (f[4] >= paraphrase and f[5] >= answer)]
            return {id_col: batch.column("_id").take(pa.array([f[0] for f in found], pa.int64())), item_id: [f[1].ids[f[2]] for f in found],
                    "cosine": [f[3] for f in found], "lcs": [f[4] for f in found], "answer": [f[5] for f in found], "word": [f[6] for f in found]}

        got = map_batches(rows, schema, run, rows=256)
        if blocks > PASS_BLOCKS:  # written, so that one pass's bases are held at a time
            got = stage(got, "found")
            sent.unpersist()
        out = got if out is None else out.unionByName(got)
    return out
