"""Operators over the whole corpus, against brute force on small tables."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from ruleforge.llm import classifier, components, decontaminate, jaccard_join, kneser_ney, line_dedup, quality_rules

DOCS = "doc_id long, text string, lang string"


def roots(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(300, 340)] + [(350, k) for k in range(351, 400)]
    want = roots(400, links)
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: want[x] for x in {y for a, b in links if a != b for y in (a, b)}}


# -- perplexity ------------------------------------------------------------
def plain_model(texts, order):
    """Modified Kneser-Ney from the definition, over dictionaries."""
    grams = Counter()
    for t in texts:
        b = b"\0" * (order - 1) + t.encode().replace(b"\0", b"\1")
        grams.update(b[i:i + order] for i in range(len(b) - order + 1))
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def d(k):
        c = Counter(levels[k].values())
        if not c[1] or not c[2]:
            return 0.5, 0.75, 0.9
        y = c[1] / (c[1] + 2 * c[2])
        raw = (1 - 2 * y * c[2] / c[1], 2 - 3 * y * c[3] / c[2], 3 - 4 * y * c[4] / c[3] if c[3] else 1.5)
        return [min(max(v, 0.05), top) for v, top in zip(raw, (0.95, 1.9, 2.85))]

    cuts = {k: d(k) for k in levels}

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        near = {h: n for h, n in levels[k].items() if h[:-1] == g[:-1]}
        if not near:
            return p(g[1:])
        total = sum(near.values())
        gamma = sum(cuts[k][min(n, 3) - 1] for n in near.values()) / total
        n = near.get(g, 0)
        return max(n - (cuts[k][min(n, 3) - 1] if n else 0), 0) / total + gamma * p(g[1:])

    return p


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["the ", "cat ", "é", "sat.", "\n"]) for _ in range(rng.randrange(30))) for _ in range(40)] + ["", None]
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "_id long, _text string, _lang string")
    return texts, rows, kneser_ney.estimate(kneser_ney.count_ngrams(rows))


def test_kneser_ney_is_the_definition(spark, model):
    texts, _, levels = model
    arrays = quality_rules.hash_arrays(levels)
    p = plain_model([t or "" for t in texts], kneser_ney.ORDER)
    for t in ["the cat", "zzz", "cat é\n", "a\0b"]:
        got, _ = kneser_ney.text_scores([t], lambda g: kneser_ney.log_probs(g, arrays))
        b = b"\0" * 4 + t.encode().replace(b"\0", b"\1")
        want = -sum(math.log(p(b[i:i + 5])) for i in range(len(b) - 4)) / (len(b) - 4)
        assert got[0] == pytest.approx(want, rel=1e-5)
    assert sum(p(b"the " + bytes([x])) for x in range(256)) == pytest.approx(1, rel=1e-6)


def test_sharded_scores_equal_broadcast_scores(spark, model):
    texts, rows, levels = model
    arrays = quality_rules.hash_arrays(levels)
    got = {r._id: r for r in classifier.sharded_scores(rows, levels, block_bytes=300).collect()}
    want, sizes = kneser_ney.text_scores([t or "" for t in texts], lambda g: kneser_ney.log_probs(g, arrays))
    for i in range(len(texts)):
        assert got[i].n_bytes == sizes[i]
        assert (got[i].score is None) if np.isnan(want[i]) else got[i].score == pytest.approx(want[i], rel=1e-5)


def test_hash_array_finds_all_and_nothing_else():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 40, 20000))
    table = kneser_ney.HashArray(keys, np.arange(len(keys)) % 997)
    v, found = table.get(keys)
    assert found.all() and (v == np.arange(len(keys)) % 997).all()
    other = np.setdiff1d(rng.integers(0, 1 << 40, 5000), keys)
    assert not table.get(other)[1].any() and not len(table.get(other[:0])[0])


def test_classifier_and_rules_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r for r in labels.collect()}
    got = classifier.classify(docs, labels).collect()
    good = [r.kept for r in got if r.doc_id in truth and truth[r.doc_id].quality == 1 and truth[r.doc_id].toxic == 0]
    bad = [r.kept for r in got if r.doc_id in truth and truth[r.doc_id].quality == 0]
    assert len(got) == docs.count() and sum(good) / len(good) >= 0.98 and sum(bad) / len(bad) <= 0.25
    got = quality_rules.judge(docs).collect()
    good = [r.kept for r in got if r.doc_id in truth and truth[r.doc_id].quality == 1 and not r.base_failed]
    bad = [r.kept for r in got if r.doc_id in truth and truth[r.doc_id].quality == 0]
    assert sum(good) / len(good) >= 0.98 and sum(bad) / len(bad) <= 0.25
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)


# -- Jaccard join ----------------------------------------------------------
def plain_components(rows, size, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    r = roots(len(rows), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[r[k]] = min(least.get(r[k], i), i)
    return {i: (len(sets[k]), least[r[k]]) for k, (i, _) in enumerate(rows)}


def family(rng, base, copies, most):
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(most + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("hot,block,members", [(256, 256, 4096), (4, 5, 7), (2, 2, 3)])
def test_jaccard_components_are_exact(spark, hot, block, members):
    rng = random.Random(hot)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(25)]
    texts = family(rng, [rng.choice(words) for _ in range(90)], 50, 5)
    texts += [" ".join([rng.choice(words) for _ in range(60)] + passage) for _ in range(25)]
    texts += family(rng, passage, 10, 1) + ["", None, "one", "One", "two words", "a b c d", " \n"] + [texts[0]] * 3
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 80))) for _ in range(25)]
    rows = list(enumerate(texts, 10))
    rng.shuffle(rows)
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot, block=block, members=members).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(rows, 4, 85)


# -- lines -----------------------------------------------------------------
def plain_drops(rows, similarity):
    places = {}
    for i, t in rows:
        for no, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\r\x0b\x0c"):
                places.setdefault(line, []).append((i, no))
    lines = list(places)
    sets = [{s[k:k + 5] for k in range(max(1, len(s) - 4))} for s in lines]
    links = [(a, b) for a in range(len(lines)) for b in range(a) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    r, first = roots(len(lines), links), {}
    for k, s in enumerate(lines):
        first[r[k]] = min(first.get(r[k], min(places[s])), min(places[s]))
    return {p for k, s in enumerate(lines) for p in places[s] if p != first[r[k]]}


def test_lines_recall_and_precision(spark):
    rng = random.Random(7)
    words = [f"word{k}" for k in range(800)]
    rows = []
    for i in range(120):
        own = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 30))) for _ in range(rng.randrange(6))]
        if rows and rng.random() < 0.6:
            near = rng.choice(rng.choice(rows)[1].split("\n")).split(" ")
            if len(near) > 8:
                near[rng.randrange(len(near))] = rng.choice(words)
            own.append(" ".join(near))
        rows.append((i, "\n".join(own + rng.choice([[], ["a common line"], [""], ["---"]]))))
    rows += [(500, None), (501, "漢字" * 40), (502, "漢字" * 40 + "仮"), (503, "\n \n\t")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, no) for r in line_dedup.report(df).collect() for no in r.dropped}
    want = plain_drops(rows, 0.8)
    assert not got - want and len(got & want) >= 0.95 * len(want)
    cut = {r.doc_id: r.text for r in line_dedup.deduplicate(df).collect()}
    for i, t in rows:
        keep = t and "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in got)
        assert cut[i] == keep


def test_lines_of_a_large_family_of_near_copies(spark):
    rng = random.Random(8)
    base = [f"tok{k}" for k in range(60)]
    rows = [(i, " ".join(w if rng.random() > 0.02 else f"y{rng.randrange(9**9)}" for w in base)) for i in range(400)]
    got = {(r.doc_id, no) for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect() for no in r.dropped}
    want = plain_drops(rows, 0.8)
    assert not got - want and len(got) >= 0.98 * len(want)


@pytest.mark.parametrize("least, most", [(6, 15), (16, 30), (31, 60), (61, 200)])
def test_similar_lines_by_length(spark, least, most):
    """Lines with one character changed or added, against all pairs that are alike by their 5-character shingles."""
    rng = random.Random(most)

    def shingles(t):
        return {t[i:i + 5] for i in range(max(1, len(t) - 4))}

    lines = ["Read more", "Read more.", "Page 12 of 100", "Page 12 of 101", "Subscribe now", "Subscribe now!", "All rights reserved", "All rights reserved."]
    want = {(0, 1), (2, 3), (4, 5), (6, 7)}
    assert all(len(shingles(lines[a]) & shingles(lines[b])) >= 0.8 * len(shingles(lines[a]) | shingles(lines[b])) for a, b in want)
    for _ in range(300):
        one = "".join(rng.choice("abcdefghijklmnop   ") for _ in range(rng.randint(least, most))).strip() + "x"
        at = rng.choice([0, len(one) - 1, len(one), rng.randrange(len(one))])
        other = one[:at] + "#" + one[at + rng.randint(0, 1):]
        a, b = shingles(one), shingles(other)
        if len(a & b) >= 0.8 * len(a | b):
            want.add((len(lines), len(lines) + 1))
        lines += [one, other]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "lk long, line string")
    got = {(min(r), max(r)) for r in line_dedup.similar(df).collect()}
    assert len(want) > 10 and len(want & got) >= 0.97 * len(want), (len(want), len(want & got))


# -- decontamination -------------------------------------------------------
def test_leaks(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3000)]

    def prose(n):
        return " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(n))

    items = [(k, prose(rng.randrange(18, 60))) for k in range(30)] + [(98, None), (99, " ")]
    docs, want = [], set()
    for i in range(200):
        t = prose(rng.randrange(5, 400))
        if i % 4 == 0:
            k = i % 30
            copy = items[k][1].split()
            if i % 8 == 0:  # a paraphrase: every eighth word replaced, the answer left whole
                copy = [w if j % 8 or j > len(copy) - 12 else rng.choice(words) for j, w in enumerate(copy)]
            t, at = t.split(), rng.randrange(len(t.split()) + 1)
            t = " ".join(t[:at] + [w.upper() for w in copy] + t[at:])
            want.add((i, k))
        elif i % 4 == 1:  # a short stretch of an item isn't a leak
            t += " " + " ".join(items[i % 30][1].split()[:7])
        docs.append((i, t))
    docs += [(900, None), (901, "")]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert not found - want and len(found) >= 0.95 * len(want)


@pytest.mark.parametrize("n, least, most", [(150, 5, 12), (2500, 15, 59)])
def test_leaks_of_short_and_of_many_items(spark, n, least, most):
    """Copies planted in texts of the corpus; the items are stretches of other texts."""
    rng = random.Random(n)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").collect() if r.text and len(r.text.split()) > 90]
    items = []
    for k in range(n):
        words, size = rng.choice(texts[:400]).split(), rng.randint(least, most)
        at = rng.randrange(len(words) - size)
        items.append((k, " ".join(words[at:at + size])))
    docs, want = [t.split() for t in texts[400:700]], set()
    for k, t in items:
        i = rng.randrange(len(docs))
        docs[i].insert(rng.randrange(len(docs[i]) + 1), t)  # one element, so that later ones don't split it
        want.add((i, k))
    got = decontaminate.leaks(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"),
                              spark.createDataFrame(items, "item_id long, text string"))
    assert len(want & {(r.doc_id, r.item_id) for r in got.collect()}) >= 0.98 * n


def test_common_length():
    rng = random.Random(10)
    for _ in range(300):
        a, b = [[rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(1, 20))] for _ in range(2)]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_length(a, b) == table[-1][-1]
