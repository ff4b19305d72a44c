"""Operators that work text by text, against plain versions written from the definitions."""

import hashlib
import random
import re

import pytest

from ruleforge.llm import bpe, pii, quality_rules, secrets, token_counts, urls

SF = "/root/testdata/sf0.001"
NASTY = ["", " ", "\n", "a", "x" * 5000, "1" * 3000, "+" * 500, "@" * 300, "a@" * 200, "1.2.3.4.5.6.7.8", "é中文😀 \x00 ñ", "token" + " " * 2000]


def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + NASTY


# -- personal data ---------------------------------------------------------
def plain_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        double = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and double % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base_spans(spark):
    rng = random.Random(1)
    made = ["".join(rng.choice(["a", "1", "12", ".", "@", "+", "-", " ", "255", "(", "4111 1111 1111 1111", "x.y"]) for _ in range(25)) for _ in range(3000)]
    for t in texts(spark) + made:
        assert sorted(pii.base_spans(t)) == sorted(plain_pii(t)), t[:200]


def test_pii_model_adds_what_base_misses_and_leaves_plain_numbers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.fit(docs)
    base, added = pii.find("call +1 (269) 555-3296 4524132264652876 now", model)
    assert base == [] and {k for k, _, _ in added} == {"phone", "card"}
    for clean in ("the year 1984 and 12 pages", "version 1.2.3.400", "4524132264652877", "in 2020 2021 2022 we met at noon"):
        assert pii.find(clean, model) == ([], [])


def test_pii_digest(spark):
    row = pii.digest(pii.find_table(spark.createDataFrame([(5, "a@b.co 1.2.3.4")], "doc_id long, text string"), {}), pii.KINDS).first()
    assert row.spans == "email:0:6,ip:7:14" and (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 0, 0)
    assert row.base_sha256 == hashlib.sha256(row.spans.encode()).hexdigest()


def test_semi_markov_gradient_is_likelihood_of_best_labelling():
    samples = [("mail bob@x.org today", [("email", 5, 14)]), ("see 10.0.0.300 ok", []), ("at 10.0.0.30 ok", [("ip", 3, 12)])] * 5
    model = pii.train(samples)
    for text, gold in samples:
        assert pii.viterbi(text, model) == gold


# -- secrets ---------------------------------------------------------------
def plain_secrets(text):
    kw = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    out = [("assign", *m.span()) for m in re.finditer(kw + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def test_secret_base_spans(spark):
    rng = random.Random(2)
    parts = ["token", "SECRET", "api_key", "apikey", "paſſword", "=", ":", " ", '"', "abcdefgh", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef" * 2, "x", "."]
    for t in texts(spark) + ["".join(rng.choice(parts) for _ in range(12)) for _ in range(4000)]:
        assert sorted(m[:3] for m in secrets.base_matches(t)) == sorted(plain_secrets(t)), t[:200]


WORDS = ["thereinandoutofthehouse", "internationalization-and-more", "____________________--", "information", "2024-01-01", "10.20.30.255", "4087441028983991", "self-evident"]
KEYS = {"hex": "0123456789abcdef", "assign": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"}


def keys(rng, kind, size):
    return "".join(rng.choice(KEYS[kind]) for _ in range(size))


def plain_runs(spark):
    return sorted({run for t in texts(spark) if not secrets.base_matches(t) for _, _, run in secrets.candidates(t)})


def test_automaton_merges_and_separates(spark):
    rng = random.Random(3)
    hexes = [keys(rng, "hex", 40) for _ in range(300)]
    merged, tree = secrets.Automaton(hexes), secrets.Automaton(hexes, merge=False)
    assert len(merged.states) < 10 < len(tree.total)
    held_out = [keys(rng, "hex", 40) for _ in range(100)]
    scorer = secrets.Scorer({"hex": hexes}, plain_runs(spark))
    assert sum(scorer.kind(h) == "hex" for h in held_out) >= 90
    assert all(scorer.kind(w) is None for w in WORDS)
    base, added = secrets.find(f"x {held_out[0][:30]} y", scorer)
    assert base == [] and added == [("hex", 2, 32)]


def test_keys_of_every_length_are_scored(spark):
    """Recall on keys held out, by length: no length, and no share of digits or letters, is left out beforehand."""
    rng = random.Random(8)
    scorer = secrets.Scorer({k: [keys(rng, k, rng.randrange(8, 65)) for _ in range(600)] for k in KEYS}, plain_runs(spark))
    for kind in KEYS:
        for size, least in ((8, 0.6), (12, 0.8), (16, 0.9), (24, 0.95), (40, 0.95), (3000, 1.0)):
            held_out = [keys(rng, kind, size) for _ in range(200 if size < 100 else 3)]
            assert sum(scorer.kind(k) is not None for k in held_out) >= least * len(held_out), (kind, size)
    digitless = [k for k in (keys(rng, "assign", 20) for _ in range(3000)) if not any(c.isdigit() for c in k)]
    assert len(digitless) > 40 and sum(scorer.kind(k) is not None for k in digitless) >= 0.9 * len(digitless)
    runs = plain_runs(spark)
    assert sum(scorer.kind(r) is not None for r in runs) <= 0.002 * len(runs) and all(scorer.kind(w) is None for w in WORDS)
    dotted = keys(rng, "assign", 24) + "." + keys(rng, "assign", 24)
    assert secrets.find(f"see ({dotted}). Then", scorer)[1][0][1:] == (5, 54)


def test_samples_are_bounded_whole_and_the_first_by_hash(spark):
    import zlib
    rows = [(i, f"token={'k%05d' % i * 30} and {'w%06d' % i}end.") for i in range(400)]
    drawn = secrets.samples(spark.createDataFrame(rows, "doc_id int, text string").repartition(7), "text", 50, 60)
    first = lambda values, n: sorted(values, key=lambda v: (zlib.crc32(v.encode()), v))[:n]
    assert drawn["assign"] == first(["k%05d" % i * 30 for i in range(400)], 50) and drawn["plain"] == first(["w%06dend" % i for i in range(400)], 60)
    assert drawn["hex"] == drawn["access"] == []
    assert secrets.fit(spark.createDataFrame([], "text string")).automata == {}


# -- urls ------------------------------------------------------------------
def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urls.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


def test_url_rules(spark):
    cases = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("url").collect()]
    cases += [None, "", "no scheme", "http://", "http://COM", "http://com/", "https://a.example.com/en/x?y#z", "x://www.example.com/en/", "http://badexample.com/en/",
              "http://EXAMPLE.com/en", "a://b.net/es/?q=/fr/", "a://net/fr/", "http://É.net/es/", "://h.com#f/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(df, None).collect()}
    for i, u in enumerate(cases):
        host, path, rule, verdict = plain_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and got[i].verdict == (verdict or "allow"), u


def test_url_model_held_out(spark):
    from pyspark.sql import functions as F
    labelled = urls.labelled_by_rules(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    part = F.pmod(F.xxhash64("url"), F.lit(4))
    model = urls.fit(labelled.filter(part != 0))
    rows = urls.judge(labelled.filter(part == 0), model, id_col="label", rules=[]).collect()
    assert len(rows) > 10 and sum((r.verdict == "block") == (r.label == 1) for r in rows) / len(rows) >= 0.85


# -- quality statistics ----------------------------------------------------
def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines, again = text.split("\n"), 0
    for i, line in enumerate(lines):
        again += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside)


def test_quality_statistics(spark):
    rng = random.Random(4)
    made = ["".join(rng.choice(["a ", "b ", "c\t", "\n", "é ", "# ", "\x85", " "]) for _ in range(rng.randrange(80))) for _ in range(500)]
    for t in [t for t in texts(spark) if len(t) < 6000] + made:
        assert quality_rules.statistics(t) == plain_statistics(t), t[:100]


# -- BPE -------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def coder():
    return bpe.BacktrackingBpe(bpe.tokenizer_spec())


def test_bpe_equals_library(spark, library, coder):
    rng = random.Random(5)
    parts = ["a", "the ", " ", "  ", "\n", "é", "中文", "😀", "'s", "'ll", "1", "23", "\x1c", "\x85", "\u3000", "<|endoftext|>", "aaaa", "!", "\x00", "ſ", "ing"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(4000)] + ["ab" * 4000]
    for t in texts(spark) + made:
        ids = library.encode(t, add_special_tokens=False).ids
        assert coder.encode(t) == ids, t[:100]
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False) == t


def test_bpe_table(spark, library):
    rows = spark.createDataFrame([(1, "The cat"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode_table(rows).collect()}
    assert got[1].ids == library.encode("The cat").ids and got[2].n_tokens == got[3].n_tokens == 0
    assert got[1].ids_sha256 == hashlib.sha256(",".join(map(str, got[1].ids)).encode()).hexdigest()
    assert got[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_bpe_memo_holds_four_bytes_an_id(library, coder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    coder.words.clear()
    for t in ["one two three four five one two", "é<|endoftext|>one" + "x" * 100, ""]:
        ids = library.encode(t, add_special_tokens=False).ids
        got = coder.ids(t)
        assert got.dtype == "int32" and got.tolist() == ids and coder.count(t) == len(ids) and coder.joined(got) == ",".join(map(str, ids))
        assert len(coder.words) <= 3 and all(len(e) == 4 * len(coder.encode_word(w)) for w, e in coder.words.items())


# -- token counts ----------------------------------------------------------
def test_edits_equal_a_full_recount(coder, monkeypatch):
    monkeypatch.setattr(token_counts, "LEAF", 3)
    rng = random.Random(6)
    parts = ["a", "bc ", "the ", "   ", "\n", "é", "'s", "'", "ll", "12", "!", "\t", " \n "]

    def recount(t):
        return sum(len(coder.encode_word(w)) for w in coder.split_words(t))

    for _ in range(2000):
        x = "".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        cuts = sorted(rng.randrange(len(x) + 1) for _ in range(2 * rng.randrange(4)))
        edits = [(s, e, "".join(rng.choice(parts) for _ in range(rng.randrange(4)))) for s, e in zip(cuts[::2], cuts[1::2])]
        tree, y = token_counts.CountTree.of(x, coder), x
        for s, e, t in sorted(edits, reverse=True):
            y = y[:s] + t + y[e:]
        assert tree.total() == recount(x) and tree.apply(edits, coder) == 0
        assert "".join(tree.leaves) == y and tree.total() == recount(y)


def test_an_edit_reads_little_of_a_long_text(coder):
    tree = token_counts.CountTree.of("some words in a long text. " * 5000, coder)
    tree.apply([(60000, 60004, "other")], coder)
    assert 0 < tree.encoded < 4 * token_counts.LEAF


def test_trees_go_through_tables(spark):
    rows = spark.createDataFrame([(1, "one two three", [(4, 7, "TWO and more"), (5, 6, "x")]), (2, None, None)],
                                 f"doc_id long, text string, edits {token_counts.EDITS}")
    got = {r.doc_id: r for r in token_counts.update(token_counts.build(rows, edits_col="edits")).collect()}
    assert "".join(got[1].leaves) == "one TWO and more three" and (got[1].n_edits, got[1].n_left_out) == (1, 1)
    assert (got[2].n_tokens, got[2].n_edits) == (0, 0)
