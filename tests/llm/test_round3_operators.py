"""Segment-tree BPE, the audit of sources and the grouping of spelling variants, against plain versions written from the definitions."""

import base64
import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from ruleforge.llm import segment_bpe, source_audit, spelling

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, digest long, word string, i int, ids string"
LONG = "the long text goes on and on with its words " * 3000


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, "x", 1, 2, "w", 3, "y")


ROWS = [row(1, "a few words of text\nand a second line"), row(1, "a few words of text\nand a second line"), row(2, None), row(3, ""), row(None, "no id here, no id"),
        row(None, None, None, None), row(4, LONG, None), row(5, " \n\t\n", "en", None), row(6, "x" * 20000), row(7, "Größe größe grosse " * 4, "", "")]


# -- segment-tree BPE ------------------------------------------------------
@pytest.fixture(scope="module")
def coders():
    import public_tokenizers as P
    import tiktoken

    raw = segment_bpe.rank_file()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return segment_bpe.SegmentTreeBpe(raw, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("letters", ["a", "ab", "aeinrst", "ßéü", "0123456789", " \n", "!?.", "日本語", "a1 é!\n"])
def test_merges_are_the_library_s(coders, letters):
    mine, library = coders
    rng = random.Random(letters)
    for size in [0, 1, 2, 3, 4, 5, 8, 9, 31, 32, 33, 500, 20000]:
        text = "".join(rng.choice(letters) for _ in range(size))
        assert mine.encode(text) == library.encode_ordinary(text)
        assert mine.decode(mine.encode(text)) == text.encode()


def test_encoded_table_is_the_library_s(spark, coders):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame(ROWS, SCHEMA).selectExpr("doc_id + 1000000 AS doc_id", "text"))
    want = Counter()
    for r in docs.collect():
        ids = coders[1].encode_ordinary(r.text or "")
        want[(r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in segment_bpe.encode_table(docs, with_ids=False).collect()) == want
    some = segment_bpe.encode_table(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(some) == len(ROWS) and all(len(r.ids) == r.n_tokens for r in some)


# -- audit of sources ------------------------------------------------------
def plain_audit(rows, least_docs, top=10):
    docs = [(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), g or "", s or "") for t, g, s in rows]
    df, uses = defaultdict(Counter), defaultdict(Counter)
    for words, g, s in docs:
        df[g].update(set(words))
        uses[g, s].update(words)
        uses[g, None].update(words)
    out = []
    for g in {g for g, _ in uses}:
        kept = [t for t, n in df[g].items() if n >= least_docs]
        share = {}
        for (lang, s), c in uses.items():
            if lang == g:
                total = sum(c[t] for t in kept)
                share[s] = {t: 1 + 10 ** 9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in share:
            if s is not None:
                pairs = [(o, sum(f(share[s][t], share[o][t]) for t in kept)) for o in share if o not in (s, None)]
                terms = [(t, f(share[s][t], share[None][t])) for t in kept if uses[g, s][t] and share[s][t] > share[None][t]]
                for part, found in (("pair", pairs), ("term", terms)):
                    ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                    out += [(g, s, part, item, v, k + 1) for k, (item, v) in enumerate(ranked) if part == "pair" or k < top]
    return sorted(out)


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


@pytest.mark.parametrize("bits", [64, 4])
@pytest.mark.parametrize("least", [1, 2, 10])
def test_audit_of_odd_rows(spark, bits, least):
    rng = random.Random(least)
    made = [row(i, " ".join(rng.choice(["Ähre", "ähre", "tie", "TIE", "x1y", "zed-zed", "q", "ω", "\U0001f600"]) for _ in range(rng.randrange(12))),
                rng.choice(["en", "de"]), rng.choice("abc")) for i in range(60)]
    rows = ROWS + made
    got = source_audit.audit(spark.createDataFrame(rows, SCHEMA), least_docs=least, bits=bits)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == plain_audit([(r[1], r[2], r[3]) for r in rows], least)
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"


def test_audit_blocks_are_summed(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "CELLS", 40)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert sorted(tuple(r[c] for c in COLUMNS) for r in source_audit.audit(docs).collect()) == plain_audit(rows, 10)


def test_audit_sql_is_the_definition():
    got = duckdb.connect().execute(source_audit.SQL.replace("documents", f"'{SF}/documents.parquet'")).fetchall()
    rows = duckdb.sql(f"SELECT text, lang, source FROM '{SF}/documents.parquet'").fetchall()
    assert sorted(got) == plain_audit(rows, 10)


def test_shares_are_exact_far_beyond_products_of_64_bits():
    rng = random.Random(3)
    for _ in range(2000):
        total = rng.randrange(1, 9 * 10 ** 15)
        n = rng.randrange(total + 1)
        assert source_audit.share(n, total, lambda a, b: a // b) == 1 + 10 ** 9 * n // total
    assert 999 * 9 * 10 ** 15 + 9 * 10 ** 15 < 2 ** 63   # the largest product


def test_audit_shuffles_no_text_of_terms(spark):
    rows = source_audit.counts(spark.createDataFrame(ROWS, SCHEMA), "lang", "source", "text", 64, with_text=False)
    kept = source_audit.by_term(rows.drop("term"), ["digest"], 1)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.split("\n") if "Exchange" in x]
    assert exchanges and "term" not in "".join(exchanges)


# -- spelling variants -----------------------------------------------------
def plain_variants(rows, least_letters=5, least_uses=3):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    n = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 97 == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            n[r] += 1
    words = {w: c for w, c in n.items() if len(w) >= least_letters and c >= least_uses}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    around = {w: [o for o in words if abs(len(o) - len(w)) <= 1 and near(w, o)] for w in words}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(around[w]), words[form[w]] if w in form else None))
    return Counter(out)


VARIANT = ["word", "form", "root", "n", "n_near", "form_n"]


def found_variants(df, **kw):
    return Counter(tuple(r[c] for c in VARIANT) for r in spelling.variants(df, **kw).collect())


@pytest.mark.parametrize("block", [spelling.BLOCK_BYTES, 96 * 20])
def test_variants_of_dense_words(spark, monkeypatch, block):
    """Random words over few letters: many pairs, ties, anagrams, chains of forms, and cells of many blocks."""
    monkeypatch.setattr(spelling, "BLOCK_BYTES", block)
    rng = random.Random(7)
    rows = [row(i, " ".join("".join(rng.choice("abÀ×÷ÿ" if rng.random() < 0.2 else "abc") for _ in range(rng.choice([4, 5, 5, 6, 7, 30])))
                            for _ in range(rng.randrange(120)))) for i in range(150)] + ROWS
    got = found_variants(spark.createDataFrame(rows, SCHEMA))
    assert got == plain_variants([(r[0], r[1]) for r in rows])
    assert sum(k[1] is not None and k[2] != k[1] for k in got) > 0   # some chains are longer than one step


def test_variants_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = plain_variants([tuple(r) for r in docs.collect()])
    assert found_variants(docs) == want and sum(k[4] for k in want) > 100


def test_forms_are_followed_to_the_last(spark):
    steps = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb"]
    links = spark.createDataFrame(list(zip(steps, steps[1:])) + [("z", "aaaaaaa"), ("k", "m")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(links).collect()} == {w: steps[-1] for w in steps[:-1]} | {"z": steps[-1], "k": "m"}


def test_very_long_words_are_counted_exactly(spark):
    a, b = "a" * 5000 + "b" * 5000, "a" * 5000 + "b" * 4999 + "c"
    rows = [row(i, w) for i in range(5) for w in (a, b, a[1:])] + [row(9, a)] * 9
    assert found_variants(spark.createDataFrame(rows, SCHEMA)) == plain_variants([(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("operator", [segment_bpe.encode_table, source_audit.audit, spelling.variants])
def test_empty_table_gives_no_rows(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_buckets_of_lines_leave_out_no_pair(spark, monkeypatch):
    """Lines of one template that share buckets without being alike, with pairs of near copies among them: the same components as all pairs in a bucket make."""
    import random
    from ruleforge.llm import components, line_dedup
    rng = random.Random(5)
    template = "the quick brown fox jumps over a lazy dog, then it runs back home by night "
    lines = []
    for k in range(80):  # pairs are alike by 0.82, other lines by 0.74, so that most of a pair's buckets are the template's
        own = "".join(rng.choice("abcdefghij") for _ in range(4))
        lines += [template + own + "".join(rng.choice("klmnopqrst") for _ in range(8)) for _ in range(2)]
    rng.shuffle(lines)
    df = spark.createDataFrame(list(enumerate(lines)), "lk long, line string")
    buckets = {}
    for r in line_dedup.bucketed(line_dedup.signed(df)).select("bk", "lk").collect():
        buckets.setdefault(r.bk, []).append(r.lk)
    assert max(map(len, buckets.values())) > 20

    def sets(t):
        return {t[i:i + 5] for i in range(len(t) - 4)}

    up = list(range(len(lines)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in {(a, b) for m in buckets.values() for a in m for b in m if a < b}:
        x, y = sets(lines[a]), sets(lines[b])
        if len(x & y) >= 0.8 * len(x | y):
            up[max(root(a), root(b))] = min(root(a), root(b))
    want = {k: root(k) for k in range(len(lines))}
    got = {r.node: r.root for r in components.connected(line_dedup.similar(df, few=3, block=7)).collect()}
    assert {k: got.get(k, k) for k in want} == want and len(set(want.values())) > 5


def test_line_families_ask_for_few_pairs(spark, monkeypatch):
    """Near copies of one line, in many buckets, and lines just below the limit to each other, make no square of pairs."""
    from ruleforge.llm import components, line_dedup

    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def changed(text, places):
        text = list(text)
        for i in rng.sample(range(0, len(text), 6), places):
            text[i] = rng.choice(letters)
        return "".join(text)

    base, other = ("".join(rng.choice(letters) for _ in range(480)) for _ in range(2))
    lines = sorted({changed(base, 4) for _ in range(150)} | {changed(other, 9) for _ in range(150)})
    df = spark.createDataFrame(list(enumerate(lines)), "lk long, line string")
    asked, verified = [], line_dedup.verified

    def counted(pairs, *more):
        asked.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(line_dedup, "verified", counted)
    got = {r.node: r.root for r in components.connected(line_dedup.similar(df)).collect()}
    grams = [{x[i:i + line_dedup.GRAM] for i in range(len(x) - line_dedup.GRAM + 1)} for x in lines]
    meet = defaultdict(set)
    for r in line_dedup.bucketed(line_dedup.signed(df)).select("bk", "lk").collect():
        meet[r.bk].add(r.lk)
    root = list(range(len(lines)))
    for a, b in sorted({p for rows in meet.values() for p in itertools.combinations(sorted(rows), 2)}):
        if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
            low, high = sorted((root[a], root[b]))
            root = [low if x == high else x for x in root]
    assert [got.get(k, k) for k in range(len(lines))] == root
    assert sum(asked) < 10 * len(lines), asked


@pytest.mark.parametrize("options", [{}, {"small": 0, "block": 7}])
def test_only_lines_of_like_sizes_meet_as_pairs(spark, monkeypatch, options):
    """Lines that share buckets without numbers of shingles that similar lines may have are left out before any bitmap is brought to their pair."""
    from ruleforge.llm import components, line_dedup

    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    lines = []
    for _ in range(12):
        base = "".join(rng.choice(letters) for _ in range(420))
        lines += [base[:n] for n in (100, 140, 200, 210, 290, 300, 420)]
    df = spark.createDataFrame(list(enumerate(lines)), "lk long, line string")
    grams = [{x[i:i + line_dedup.GRAM] for i in range(len(x) - line_dedup.GRAM + 1)} for x in lines]
    asked, screened = [], line_dedup.screened

    def seen(pairs, *more):
        asked.extend((r.u, r.v) for r in pairs.collect())
        return screened(pairs, *more)

    monkeypatch.setattr(line_dedup, "screened", seen)
    got = {r.node: r.root for r in components.connected(line_dedup.similar(df, **options)).collect()}
    assert asked and all(min(len(grams[a]), len(grams[b])) >= 0.8 * max(len(grams[a]), len(grams[b])) for a, b in asked)
    assert [got.get(k, k) for k in range(len(lines))] == [k - 1 if k % 7 in (3, 5) else k for k in range(len(lines))]


def test_passages_are_counted_in_pieces_that_cut_none():
    """Small dense matrices of the terms used hold every word of every passage once."""
    from ruleforge.llm import decontaminate

    rng = np.random.default_rng(4)
    sizes = np.array([10, 700, 0, 64, 1, 333], dtype=np.int64)
    number, passages = decontaminate.passages_of(sizes)
    terms = rng.integers(0, 50, sizes.sum()) * 300
    pieces = decontaminate.pieces(number, 100)
    assert [a for a, _ in pieces] == [0, *(b for _, b in pieces[:-1])] and pieces[-1][1] == len(terms) and len(pieces) > 4
    assert all(number[b - 1] != number[b] for _, b in pieces[:-1])
    got = np.zeros((passages, 1 << decontaminate.BITS), dtype=np.int64)
    for a, b in pieces:
        used, at, place, n = decontaminate.counted(number[a:b] - number[a], terms[a:b])
        got[at + number[a], used[place]] += n
    want = np.zeros_like(got)
    np.add.at(want, (number, terms), 1)
    assert (got == want).all()
