"""Secret scan: base patterns plus probabilistic automata learned from labelled credentials.

Grammar inference by state merging (ALERGIA): the labelled credentials of a
kind make a prefix tree with counts; going breadth first, a state is merged
into an accepted one when their stopping and next-symbol frequencies, and
those of all states after them, differ by less than the Hoeffding bound.
Merging folds subtrees, so the result is a deterministic probabilistic
automaton. Every run of at least eight credential characters is scored: the likelihood of
its characters under each kind's automaton against that under a plain-text
model, character pairs learned from the table's own other runs. The limit
depends on the run's length: a short run has less to tell by. It is the higher
of two figures for runs of about that length: a low quantile of the labelled
credentials by character, and a margin above all but the oddest plain runs the model has not seen.

Labels are the base matches of the table itself. Bounded samples, the first by
hash, of whole credentials and runs: at most ``TRAIN_BOUND`` different
credentials a kind and ``TRAIN_CHARS`` characters, ``PLAIN_BOUND`` plain runs.
One pass over the texts draws all of them, each task keeping no more than the
bound. Symbols of the automata are character classes, so that random characters
of one alphabet share their evidence.

Cases: null text counts as empty; texts and runs of any length are read and
scored whole; without labelled credentials of a kind the kind has no automaton
and adds nothing; of kinds with equal scores the last by name counts; repeated
rows give a row each; an empty table gives no rows; only the id and text
columns are read.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ruleforge.operators.topk import top_k

from .common import col, id_type, map_batches, release, ship, stage, texts_of

KINDS = ("assign", "access", "hex")
TRAIN_BOUND = 1500     # labelled credentials per kind
TRAIN_CHARS = 120_000  # and their characters: whole credentials up to this sum
PLAIN_BOUND = 6000     # plain runs: one half teaches the model, the other the limits
MIN_LENGTH = 8         # candidates are runs of at least so many credential characters
LENGTHS = (8, 10, 12, 16, 20, 24, 32, 40, 64)  # from where on a length has a limit of its own
ODD = 0.001            # share of plain runs that may be keys nobody labelled, or noise: no limit follows them
MARGIN = 5.0           # log odds above the other plain runs
MEMO = 200_000         # scored runs kept per Python worker; emptied when full
ALPHA = 0.05         # confidence of the compatibility test
QUANTILE = 0.02      # of the labelled credentials' scores: the limit for candidates

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")                 # 16 characters and more; a shorter match holds no longer one
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")           # whole runs of 32 and more
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_LENGTH)
_ENDS = ".-"                                               # not part of a run at its ends: punctuation of the sentence


def candidates(text: str):
    """Start, end and text of every run of credential characters that is long enough without the punctuation round it."""
    for m in _RUN.finditer(text):
        run = m[0].rstrip(_ENDS)
        end = m.start() + len(run)
        run = run.lstrip(_ENDS)
        if len(run) >= MIN_LENGTH:
            yield end - len(run), end, run


def base_matches(text: str) -> list[tuple[str, int, int, str]]:
    """Kind, start, end and credential of each base match."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span(), m[0]) for m in _ACCESS.finditer(text)]
    if max(map(len, text.split()), default=0) >= 32:  # without such a word there is no such run
        out += [("hex", *m.span(), m[0]) for m in _HEX.finditer(text)]
    return out


#: class of a character and the number of characters in its class
CLASSES = {"0-9": 10, "a-f": 6, "g-z": 20, "A-F": 6, "G-Z": 20}


def symbol(c: str) -> str:
    if "0" <= c <= "9":
        return "0-9"
    if "a" <= c <= "f":
        return "a-f"
    if "g" <= c <= "z":
        return "g-z"
    if "A" <= c <= "F":
        return "A-F"
    return "G-Z" if "G" <= c <= "Z" else c


class Automaton:
    """Probabilistic automaton merged from the prefix tree of the samples."""

    def __init__(self, samples: list[str], alpha: float = ALPHA, merge: bool = True):
        self.total, self.stops, self.next, self.counts = [0], [0], [{}], [{}]
        for s in sorted(samples):
            at = 0
            self.total[0] += 1
            for a in map(symbol, s):
                if a not in self.next[at]:
                    self.next[at][a] = len(self.total)
                    self.total.append(0)
                    self.stops.append(0)
                    self.next.append({})
                    self.counts.append({})
                self.counts[at][a] = self.counts[at].get(a, 0) + 1
                at = self.next[at][a]
                self.total[at] += 1
            self.stops[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        if merge:
            self._merge()

    def _differs(self, x: int, n: int, y: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(x / n - y / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _fits(self, p: int, q: int) -> bool:
        todo, seen = [(p, q)], set()
        while todo:
            p, q = todo.pop()
            if p == q or (p, q) in seen:
                continue
            seen.add((p, q))
            n, m = self.total[p], self.total[q]
            if self._differs(self.stops[p], n, self.stops[q], m):
                return False
            for a in self.counts[p].keys() | self.counts[q].keys():
                if self._differs(self.counts[p].get(a, 0), n, self.counts[q].get(a, 0), m):
                    return False
                if a in self.next[p] and a in self.next[q]:
                    todo.append((self.next[p][a], self.next[q][a]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the subtree of q to p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.total[p] += self.total[q]
            self.stops[p] += self.stops[q]
            for a, n in self.counts[q].items():
                self.counts[p][a] = self.counts[p].get(a, 0) + n
                if a in self.next[p]:
                    todo.append((self.next[p][a], self.next[q][a]))
                else:
                    self.next[p][a] = self.next[q][a]

    def _merge(self) -> None:
        kept, edge = [0], [(0, a, q) for a, q in sorted(self.next[0].items())]
        while edge:
            parent, a, q = edge.pop(0)
            if self.next[parent].get(a) != q or q in kept:
                continue
            for p in kept:
                if self._fits(p, q):
                    self.next[parent][a] = p
                    self._fold(p, q)
                    edge = [(k, b, r) for k in kept for b, r in sorted(self.next[k].items()) if r not in kept]
                    break
            else:
                kept.append(q)
                edge += [(q, b, r) for b, r in sorted(self.next[q].items()) if r not in kept]
        self.states = kept

    def score(self, text: str) -> float:
        """Log-likelihood per character, with the characters of a class alike.

        What a state has not seen weighs as one symbol of the start state, from
        which such a run goes on: a run longer than all samples isn't cut off.
        """
        at, total = 0, 0.0
        for c in text:
            a = symbol(c)
            first = (self.counts[0].get(a, 0) + 0.05) / (self.total[0] + 1.0)
            total += math.log((self.counts[at].get(a, 0) + first) / (self.total[at] + 1.0)) - math.log(CLASSES.get(a, 1))
            at = self.next[at][a] if a in self.next[at] else self.next[0].get(a, 0)
        return total / max(1, len(text))


NUMBER = frozenset("0123456789.-/+=_")   # characters of dates, amounts, addresses and other written numbers


class PlainRuns:
    """Likelihood of a run as plain text: words as the table's plain runs spell them, character after character, or a written number."""

    def __init__(self, runs: list[str]):
        self.single, self.pairs, self.before = Counter(), Counter(), Counter()
        for run in runs:
            for a, b in zip(" " + run, run):
                self.single[b] += 1
                self.pairs[a, b] += 1
                self.before[a] += 1
        self.total = sum(self.single.values())
        self.known: dict[tuple[str, str], float] = {}

    def pair(self, a: str, b: str) -> float:
        if (a, b) not in self.known:
            alone = (self.single[b] + 0.5) / (self.total + 0.5 * 67)   # 67 credential characters
            self.known[a, b] = math.log((self.pairs[a, b] + 8 * alone) / (self.before[a] + 8))
        return self.known[a, b]

    def score(self, run: str) -> float:
        """Log-likelihood of the whole run."""
        known, pair = self.known.get, self.pair
        spelled = sum([known((a, b)) or pair(a, b) for a, b in zip(" " + run, run)])
        return max(spelled, -math.log(len(NUMBER)) * len(run)) if NUMBER.issuperset(run) else spelled


class Scorer:
    """Automata, plain-text model and limits of all kinds: which kind a run is of, if any."""

    def __init__(self, credentials: dict[str, list[str]], plain: list[str]):
        self.plain = PlainRuns(plain[::2])
        self.automata = {kind: Automaton(values) for kind, values in sorted(credentials.items()) if values}
        self.low: dict[str, list[float]] = {}    # odds for each character, by kind and length
        self.high: dict[str, list[float]] = {}   # odds of the whole run
        for kind, automaton in self.automata.items():
            seen = [(len(v), self.odds(kind, v)) for v in credentials[kind]]
            apart = [(len(v), self.odds(kind, v)) for v in plain[1::2]]
            self.low[kind] = [self._low(seen, k) for k in range(len(LENGTHS))]
            self.high[kind] = [self._high(apart, k) for k in range(len(LENGTHS))]
        self.memo: dict[str, str | None] = {}

    def odds(self, kind: str, run: str) -> float:
        return self.automata[kind].score(run) * len(run) - self.plain.score(run)

    @staticmethod
    def _place(length: int) -> int:
        return max(0, bisect_right(LENGTHS, length) - 1)

    def _low(self, seen: list[tuple[int, float]], k: int) -> float:
        """Low quantile of credentials of this length; 0, even odds, where there are too few."""
        own = sorted(x / n for n, x in seen if self._place(n) == k)
        return max(0.0, own[int(QUANTILE * len(own))]) if len(own) >= 20 else 0.0

    def _high(self, apart: list[tuple[int, float]], k: int) -> float:
        """Above all but the oddest plain runs of up to this length: longer ones have more to tell, not less."""
        own = sorted(x for n, x in apart if self._place(n) <= k)
        return max(0.0, own[math.ceil((1 - ODD) * len(own)) - 1] if own else 0.0) + MARGIN

    def kind(self, run: str) -> str | None:
        found = self.memo.get(run, "")
        if found == "":
            k = self._place(len(run))
            gain, best = max(((self.odds(kind, run) - max(self.low[kind][k] * len(run), self.high[kind][k]), kind)
                              for kind in self.automata), default=(-1.0, None))
            found = best if gain >= 0 else None
            if len(run) <= 64:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[run] = found
        return found

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}


def samples(df: DataFrame, text_col: str, bound: int, plain_bound: int) -> dict[str, list[str]]:
    """Different credentials by kind and plain runs, the first by hash; one pass, bounded in every task."""
    bounds = dict.fromkeys(KINDS, bound) | {"plain": plain_bound}
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {k: {} for k in bounds}
        ceiling = dict.fromkeys(bounds, 1 << 32)   # hashes from here on are beyond the bound already

        def add(kind: str, value: str) -> None:
            h = zlib.crc32(value.encode())
            if h < ceiling[kind]:
                kept = held[kind]
                kept[value] = h
                if len(kept) > 4 * bounds[kind]:
                    first = sorted(kept.items(), key=lambda x: (x[1], x[0]))[:bounds[kind]]
                    held[kind], ceiling[kind] = dict(first), first[-1][1] + 1

        for batch in batches:
            for text in texts_of(batch):
                taken = []
                for kind, start, end, value in base_matches(text):
                    add(kind, value)
                    taken.append((start, end))
                for start, end, value in candidates(text):
                    if not any(s < end and start < e for s, e in taken):
                        add("plain", value)
        for kind, kept in held.items():
            first = sorted(kept.items(), key=lambda x: (x[1], x[0]))[:bounds[kind]]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(first), pa.string()), pa.array([h for _, h in first], pa.int64()),
                                              pa.array([v for v, _ in first], pa.string())], names=["kind", "h", "value"])

    rows = df.select(col(text_col).cast("string").alias("_text")).mapInArrow(run, "kind string, h bigint, value string")
    found = stage(rows.distinct(), "secret-samples")
    out = {k: [r.value for r in top_k(found.filter(F.col("kind") == k), [("h", False), ("value", False)], n).collect()] for k, n in bounds.items()}
    release(found)
    return out


def fit(df: DataFrame, text_col: str = "text", bound: int = TRAIN_BOUND, plain_bound: int = PLAIN_BOUND, chars: int = TRAIN_CHARS) -> Scorer:
    """Automata, plain-text model and limits from bounded samples of the table."""
    drawn = samples(df, text_col, bound, plain_bound)
    plain = drawn.pop("plain")
    for kind, values in drawn.items():
        room, kept = chars, []
        for v in values:
            if len(v) <= room:   # a credential is taken whole or not at all
                kept.append(v)
                room -= len(v)
        drawn[kind] = kept
    return Scorer(drawn, plain)


def find(text: str, models: Scorer) -> tuple[list, list]:
    """Base spans and the added spans of candidates that touch none of them."""
    base = [m[:3] for m in base_matches(text)]
    added = []
    if models.automata:
        held, k, reach = sorted((s, e) for _, s, e in base), 0, 0
        for start, end, run in candidates(text):
            while k < len(held) and held[k][0] < end:
                reach = max(reach, held[k][1])
                k += 1
            if reach <= start and (kind := models.kind(run)):
                added.append((kind, start, end))
    return base, added


def find_table(df: DataFrame, models: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All spans of each row as ``spans`` (array of kind, start, end, base) beside the id; one pass, no shuffle."""
    name = id_col.replace("`", "``")
    schema = f"`{name}` {id_type(df, id_col)}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    shared = df.sparkSession.sparkContext.broadcast(models)   # bounded by the samples

    def run(batch):
        out, models = [], shared.value
        for text in texts_of(batch):
            base, added = find(text, models)
            out.append([{"kind": k, "start": s, "end": e, "base": b} for part, b in ((base, True), (added, False)) for k, s, e in part])
        return {id_col: batch.column(0), "spans": out}

    return map_batches(df.select(col(id_col), col(text_col).cast("string").alias("_text")), schema, run)
