"""Personal data: exact base patterns plus a semi-Markov conditional random field.

The base patterns (e-mail, IPv4, card, phone) are matched in linear time over
the whole text. The semi-Markov model scores whole candidate segments by
features of the complete span (digit count, separators, checksum, octets,
label words before it) and a dynamic programme over bounded segments chooses
boundaries and types together. Text without a digit or an @ cannot hold a
segment, so the programme runs on the windows round such characters; between
two windows every token is outside, which is what the full programme would
give too. Spans that touch no base span are added to the base spans.

Training uses windows with base spans as labels, at most ``TRAIN_WINDOWS`` of
them chosen by hash, each also in disturbed spellings (separators changed,
"at"/"dot" written out, plus sign left out) that the base patterns miss.

Cases: null text counts as empty (no spans, digest of the empty string);
repeated rows give a row each; an empty table gives no rows; only the id and
text columns are read.
"""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import col, id_type, map_batches, sha256_hex, spans_text, texts_of

KINDS = ("email", "ip", "card", "phone")
TRAIN_WINDOWS = 300      # bound of the labelled sample
WINDOW = 48              # characters kept round a digit or @
MAX_TOKENS = 20          # bound of an entity, in tokens

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can begin only at the start of a run of digits, so the look-behind changes nothing but the time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_SPELLED = re.compile(r"\b(?:at|AT)\b(?=[^\n]{1,40}?\b(?:dot|DOT)\b)")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            d = digits_of(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(digits_of(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches round digits, @ and a written-out "at ... dot", joined where they touch."""
    out: list[list[int]] = []
    found = [m.span() for m in _TRIGGER.finditer(text)]
    if "dot" in text or "DOT" in text:
        found = sorted(found + [m.span() for m in _SPELLED.finditer(text)])
    for a, b in found:
        s, e = max(0, a - WINDOW), min(len(text), b + WINDOW)
        if out and s <= out[-1][1]:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


_EMAIL_LIKE = re.compile(r"[\w.%+-]+\s?(?:@|[\[(]?\b(?:at|AT)\b[\])]?)\s?[\w-]+(?:\s?(?:\.|[\[(]?\b(?:dot|DOT)\b[\])]?)\s?[\w-]+)+\Z")
_IP_LIKE = re.compile(r"[0-9]{1,3}(?:\s?[.,]\s?[0-9]{1,3}){3}\Z")
_CARD_LIKE = re.compile(r"[0-9]+(?:[\s./_-]{1,2}[0-9]+)*\Z")
_PHONE_LIKE = re.compile(r"\+?\s?\(?[0-9]+(?:[\s().\-/]{1,3}[0-9]+)*\Z")
LABEL_WORDS = {"email": ("mail", "email", "e-mail", "contact"), "ip": ("ip", "address", "host", "server"),
               "card": ("card", "visa", "mastercard", "credit", "amex"), "phone": ("phone", "tel", "call", "mobile", "fax")}


def features(text: str, start: int, end: int, kind: str) -> list[str] | None:
    """Features of a whole candidate span; None where the type's frame rules it out."""
    span = text[start:end]
    d = digits_of(span)
    if kind == "email":
        if not _EMAIL_LIKE.match(span):
            return None
        out = ["@" if "@" in span else "at", "tld" if span[-2:].isalpha() else "notld", f"dots{min(3, span.count('.'))}",
               "spaced" if " " in span else "tight", "exact" if "@" in span and " " not in span else "loose"]
    elif kind == "ip":
        if not _IP_LIKE.match(span):
            return None
        ok = all(int(p) <= 255 for p in re.findall("[0-9]+", span))
        out = ["octets" if ok else "over", "comma" if "," in span else "dots", "spaced" if " " in span else "tight"]
    elif kind == "card":
        if not 12 <= len(d) <= 19 or not _CARD_LIKE.match(span):
            return None
        groups = [len(g) for g in re.findall("[0-9]+", span)]
        out = ["luhn" if luhn(d) else "noluhn", f"len{len(d)}", "fours" if set(groups[:-1]) <= {4} else "mixed",
               "odd" if re.search(r"[./_]", span) else "plain", f"groups{min(6, len(groups))}"]
    else:
        if not 9 <= len(d) <= 15 or not _PHONE_LIKE.match(span):
            return None
        groups = len(re.findall("[0-9]+", span))
        out = ["plus" if span[0] == "+" else "noplus", "paren" if "(" in span and ")" in span else "noparen",
               f"len{len(d)}", f"groups{min(6, groups)}", "slash" if "/" in span else "noslash"]
    before, after = text[start - 1:start], text[end:end + 1]
    out.append("glued" if before.isalnum() or after.isalnum() else "free")
    out.append("more" if re.match(r"[.\-]?[0-9]", text[end:end + 2]) or re.search(r"[0-9][.\-]?\Z|\+\Z", text[max(0, start - 2):start]) else "whole")
    left = text[max(0, start - 24):start].lower()
    out.append("label" if any(w in left for w in LABEL_WORDS[kind]) else "nolabel")
    shape = ",".join(out)
    return [f"{kind}:bias", f"{kind}:all:{shape}"] + [f"{kind}:{x}" for x in out]


def lattice(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, str, list[str]]]]:
    """Tokens of a window and its candidate segments (first token, end token, kind, features)."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    out = []
    for i, (start, first_end) in enumerate(tokens):
        if not (text[start].isalnum() or text[start] in "+("):
            continue
        digits = ats = 0
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            a, b = tokens[j]
            if j > i and a - tokens[j - 1][1] > 2:
                break
            piece = text[a:b]
            digits += len(digits_of(piece))
            ats += piece == "@" or piece.lower() == "at"
            if not piece[-1].isalnum():
                continue
            if digits > 19 and not ats:
                break
            if ats:
                kinds = ("email",)
            elif 4 <= digits:
                kinds = ("ip", "card", "phone")
            else:
                continue
            for kind in kinds:
                f = features(text, start, b, kind)
                if f:
                    out.append((i, j + 1, kind, f))
    return tokens, out


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def _weight(model: dict[str, float], names: list[str]) -> float:
    return sum(model.get(n, 0.0) for n in names)


def viterbi(text: str, model: dict[str, float]) -> list[tuple[str, int, int]]:
    """The best segmentation of a window; outside tokens score 0."""
    tokens, segments = lattice(text)
    if not segments:
        return []
    ending: dict[int, list] = {}
    for i, j, kind, names in segments:
        ending.setdefault(j, []).append((i, kind, _weight(model, names)))
    best, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
    for j in range(1, len(tokens) + 1):
        best[j] = best[j - 1]
        for i, kind, w in ending.get(j, ()):
            if best[i] + w > best[j]:
                best[j], back[j] = best[i] + w, (i, kind)
    out, j = [], len(tokens)
    while j:
        if back[j]:
            i, kind = back[j]
            out.append((kind, tokens[i][0], tokens[j - 1][1]))
            j = i
        else:
            j -= 1
    return out[::-1]


def train(samples: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 6, rate: float = 0.5,
          decay: float = 1e-3) -> dict[str, float]:
    """Conditional likelihood by AdaGrad; expectations from forward and backward sums over segmentations."""
    model: dict[str, float] = {}
    scale: dict[str, float] = {}
    ready = []
    for text, gold in samples:
        tokens, segments = lattice(text)
        if segments:
            want = set(gold)
            ready.append((len(tokens), segments, [float((k, tokens[i][0], tokens[j - 1][1]) in want) for i, j, k, _ in segments]))
    for _ in range(epochs):
        for n, segments, gold in ready:
            weights = [_weight(model, names) for *_, names in segments]
            ending: dict[int, list] = {}
            starting: dict[int, list] = {}
            for (i, j, *_), w in zip(segments, weights):
                ending.setdefault(j, []).append((i, w))
                starting.setdefault(i, []).append((j, w))
            ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                ahead[j] = _log_sum([ahead[j - 1]] + [ahead[i] + w for i, w in ending[j]]) if j in ending else ahead[j - 1]
            for i in range(n - 1, -1, -1):
                behind[i] = _log_sum([behind[i + 1]] + [behind[j] + w for j, w in starting[i]]) if i in starting else behind[i + 1]
            step: dict[str, float] = {}
            for (i, j, _, names), w, g in zip(segments, weights, gold):
                diff = g - math.exp(min(0.0, ahead[i] + w + behind[j] - ahead[n]))
                if abs(diff) > 1e-6:
                    for name in names:
                        step[name] = step.get(name, 0.0) + diff
            for name, g in step.items():
                g -= decay * model.get(name, 0.0)
                scale[name] = scale.get(name, 0.0) + g * g
                model[name] = model.get(name, 0.0) + rate * g / math.sqrt(scale[name] + 1e-8)
    return model


def disturbed(text: str, gold: list[tuple[str, int, int]], rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """The window with its spans respelled; what is no longer of its kind loses the label."""
    out, spans, at = "", [], 0
    for kind, s, e in sorted(gold, key=lambda x: x[1]):
        if s < at:
            continue
        span = text[s:e]
        if kind == "email":
            new = span.replace("@", rng.choice([" at ", " [at] ", "@", " @ "]))
            if "@" not in new or rng.random() < 0.3:
                head, _, tail = new.rpartition(".")
                new = f"{head} dot {tail}" if head else new
        elif kind == "phone":
            new = re.sub(r"[\x20-]", lambda _: rng.choice([" ", ".", "-"]), span[1:] if rng.random() < 0.6 else span)
        elif kind == "card":
            d = digits_of(span)
            new = rng.choice([".", "  ", "_", "-"]).join(d[k:k + 4] for k in range(0, len(d), 4))
            if rng.random() < 0.4:  # a wrong check digit: no card any more
                new, kind = new[:-1] + str((int(new[-1]) + 3) % 10), ""
        else:
            new = rng.choice([" . ", ". ", ","]).join(span.split("."))
            if rng.random() < 0.4:
                new, kind = re.sub(r"[0-9]+\Z", str(rng.randrange(300, 999)), new), ""
        out += text[at:s]
        if kind:
            spans.append((kind, len(out), len(out) + len(new)))
        out += new
        at = e
    return out + text[at:], spans


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", windows_bound: int = TRAIN_WINDOWS) -> dict[str, float]:
    """Train on at most ``windows_bound`` windows, the first by hash of all windows of the table."""

    def run(batch):
        found = []
        for text in texts_of(batch):
            spans = base_spans(text) if _DIGIT.search(text) or "@" in text else []
            for s, e in windows(text):
                if e - s <= 8 * WINDOW:
                    found.append((text[s:e], bool([x for x in spans if x[1] < e and x[2] > s])))
        return {"window": [w for w, _ in found], "hit": [h for _, h in found]}

    found = map_batches(df.select(col(text_col).cast("string").alias("_text")), "window string, hit boolean", run).distinct()
    rows = []
    for hit in (True, False):  # labelled windows, and others as examples of what is outside
        rows += (found.filter(F.col("hit") == hit).orderBy(F.xxhash64("window"), "window")
                 .limit(windows_bound if hit else windows_bound // 3).collect())
    rng = random.Random(7)
    samples = []
    for row in rows:
        spans = base_spans(row.window)
        samples.append((row.window, spans))
        if spans:
            samples.append(disturbed(row.window, spans, rng))
    return train(samples)


def find(text: str, model: dict[str, float]) -> tuple[list, list]:
    """Base spans and the spans that the model adds."""
    base = base_spans(text) if "@" in text or _DIGIT.search(text) else []
    added = []
    if model:
        held = sorted((s, e) for _, s, e in base)
        starts = np.array([s for s, _ in held])
        ends = np.maximum.accumulate(np.array([e for _, e in held])) if held else None
        for s, e in windows(text):
            for kind, a, b in viterbi(text[s:e], model):
                a, b = a + s, b + s
                k = int(np.searchsorted(starts, b)) if held else 0
                if k == 0 or ends[k - 1] <= a:
                    added.append((kind, a, b))
    return base, added


def find_table(df: DataFrame, model: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All spans of each row as ``spans`` (array of kind, start, end, base) beside the id; one pass, no shuffle."""
    name = id_col.replace("`", "``")
    schema = f"`{name}` {id_type(df, id_col)}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"

    def run(batch):
        out = []
        for text in texts_of(batch):
            base, added = find(text, model)
            out.append([{"kind": k, "start": s, "end": e, "base": b} for part, b in ((base, True), (added, False)) for k, s, e in part])
        return {id_col: batch.column(0), "spans": out}

    return map_batches(df.select(col(id_col), col(text_col).cast("string").alias("_text")), schema, run)


def digest(spans: DataFrame, kinds: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """Counts by kind and digest of the base spans, and the text of all spans."""
    name = id_col.replace("`", "``")
    schema = (f"`{name}` {id_type(spans, id_col)}, " + ", ".join(f"n_{k} bigint" for k in kinds)
              + ", base_sha256 string, spans string, n_added bigint")

    def run(batch):
        out = {id_col: batch.column(0), "base_sha256": [], "spans": [], "n_added": []} | {f"n_{k}": [] for k in kinds}
        for row in batch.column(1).to_pylist():
            row = row or []
            base = [(x["kind"], x["start"], x["end"]) for x in row if x["base"]]
            for k in kinds:
                out[f"n_{k}"].append(sum(x[0] == k for x in base))
            out["base_sha256"].append(sha256_hex(spans_text(base, kinds)))
            out["spans"].append(spans_text([(x["kind"], x["start"], x["end"]) for x in row], kinds))
            out["n_added"].append(len(row) - len(base))
        return out

    return map_batches(spans.select(col(id_col), col("spans")), schema, run, rows=2048)
