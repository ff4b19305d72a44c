"""BPE encoding and decoding with a backtracking encoder.

A word (pre-token) is covered from the left with the longest vocabulary
entries, found by one Aho-Corasick pass. A new token is accepted when it can
stand beside the previous one: no merge of lower rank may join pieces of the
two across their border while both words are built up. Otherwise a shorter
prefix is tried and, when none is left, the previous token is taken back and
the position marked dead. Every position dies at most once, so the time is
linear in the word's length, and the result is exactly what applying the
merges by rank gives. Decoding copies byte ranges out of one table by offset.

Cases: a null text counts as empty (0 tokens, digest of the empty string);
texts of any length are encoded whole; repeated rows each give a row; an
empty table gives no rows; only the id and text columns are read, so other
columns may have any names.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import numpy as np
from pyspark.sql import DataFrame

from .common import col, id_type, map_batches, texts_of

CACHE_WORDS = 500_000   # memo of encoded words per Python worker; emptied when full
CACHE_PAIRS = 2_000_000
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Memo(dict):
    """Encoded pre-tokens by word: what is not there is made and kept; emptied when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        entry = self.make(word)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = entry
        return entry


class BacktrackingBpe:
    """Encoder and decoder for one byte-level tokenizer file (its JSON text)."""

    def __init__(self, spec: str):
        import ahocorasick
        import regex

        doc = json.loads(spec)
        alphabet = byte_alphabet()
        raw = {bytes(alphabet[c] for c in token): i for token, i in doc["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in doc["added_tokens"]}
        size = max([*raw.values(), *self.special.values()]) + 1
        by_id = [b""] * size
        for token, i in raw.items():
            by_id[i] = token
        for content, i in self.special.items():
            by_id[i] = content.encode()
        # decoding: one byte string and where each id's bytes begin and end in it
        self.table = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in by_id])]).astype(np.int64)
        self.length = [len(t) for t in by_id]
        self.shown = list(map(str, range(size)))
        # merges: halves of each token, and the token that a pair makes
        self.size = size
        self.left, self.right, self.rank, self.merged = list(range(size)), list(range(size)), [-1] * size, {}
        for rank, pair in enumerate(doc["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = (raw[bytes(alphabet[c] for c in x)] for x in (a, b))
            made = raw[by_id[a] + by_id[b]]
            self.left[made], self.right[made], self.rank[made] = a, b, rank
            self.merged[a * size + b] = made
        # the longest proper prefix of each token that is a token
        self.shorter = [-1] * size
        for token, i in raw.items():
            for n in range(len(token) - 1, 0, -1):
                if (p := raw.get(token[:n])) is not None:
                    self.shorter[i] = p
                    break
        self.automaton = ahocorasick.Automaton()
        for token, i in raw.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.split_words = regex.compile(PRETOKEN).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.pairs: dict[int, bool] = {}
        self.words = Memo(self.word)

    def compatible(self, left: int, right: int) -> bool:
        """Can ``right`` follow ``left`` without a merge across their border?

        The border is seen backwards in time: of the two pieces that touch it,
        the one made last is taken apart. A pair of pieces conflicts when its
        merge comes before the pieces are used up inside their own tokens; of
        equal merges the leftmost goes first.
        """
        key = left * self.size + right
        known = self.pairs.get(key)
        if known is not None:
            return known
        rank, left_until, right_until, fits = self.rank, 1 << 60, 1 << 60, True
        while True:
            made = self.merged.get(left * self.size + right)
            if made is not None and rank[made] < left_until and rank[made] <= right_until:
                fits = False
                break
            if rank[left] < 0 and rank[right] < 0:
                break
            if rank[left] > rank[right]:
                left_until, left = rank[left], self.right[left]
            else:
                right_until, right = rank[right], self.left[right]
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[key] = fits
        return fits

    def encode_word(self, word: str) -> list[int]:
        text = word if word.isascii() else word.encode().decode("latin-1")
        length, shorter, compatible, pairs, size = self.length, self.shorter, self.compatible, self.pairs, self.size
        longest = [-1] * len(text)
        for end, token in self.automaton.iter(text):
            longest[end + 1 - length[token]] = token  # ends rise, so the longest stays
        out: list[int] = []
        at, stop, token, last = 0, len(text), longest[0], -1
        dead: set[int] = set()
        while True:
            end = at + length[token]
            if end not in dead and (last < 0 or ((ok := pairs.get(last * size + token)) is None and compatible(last, token)) or ok):
                out.append(token)
                if end == stop:
                    return out
                at, last, token = end, token, longest[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead.add(at)
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1

    def word(self, word: str) -> bytes:
        """Ids of a pre-token as 32-bit numbers."""
        return array("i", self.encode_word(word)).tobytes()

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text; added tokens are cut out first."""
        entry = self.words.__getitem__
        if self.split_special is None or not any(s in text for s in self.special):
            return np.frombuffer(b"".join(map(entry, self.split_words(text))), dtype=np.int32)
        out = []
        for piece in self.split_special(text):
            if piece in self.special:
                out.append(array("i", [self.special[piece]]).tobytes())
            else:
                out.extend(map(entry, self.split_words(piece)))
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def joined(self, ids: np.ndarray) -> str:
        """Ids as decimals, joined by commas."""
        return ",".join(map(self.shown.__getitem__, ids.tolist()))

    def encode(self, text: str) -> list[int]:
        return self.ids(text).tolist()

    def count(self, text: str) -> int:
        return len(self.ids(text))

    def decode_bytes(self, ids) -> bytes:
        """Bytes of the ids: ranges of the table, copied by offset."""
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return b""
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        return self.table[np.arange(ends[-1]) + np.repeat(start - (ends - size), size)].tobytes()

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_LOADED: dict[int, BacktrackingBpe] = {}


def loaded(spec: str) -> BacktrackingBpe:
    """The tokenizer of this Python process, built once."""
    key = hash(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = BacktrackingBpe(spec)
    return _LOADED[key]


def tokenizer_spec(path: str | None = None) -> str:
    """Text of a tokenizer file (a few MB at most); read on the driver and broadcast."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                 with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns the id column, ``ids`` (array<int>, left out with ``with_ids=False``),
    ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``. No shuffle: one pass
    over the rows, memory bounded by a slice of rows and the word memo.
    """
    spec = df.sparkSession.sparkContext.broadcast(tokenizer_spec(path))
    kind = id_type(df, id_col)
    name = id_col.replace("`", "``")
    schema = f"`{name}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batch):
        bpe = loaded(spec.value)
        out = {id_col: batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        for text in texts_of(batch):
            ids = bpe.ids(text)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(bpe.joined(ids).encode()).hexdigest())
            back = bpe.decode_bytes(ids).decode("utf-8", "replace")
            out["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
            if with_ids:
                out["ids"].append(ids)
        return out

    return map_batches(df.select(col(id_col), col(text_col).cast("string").alias("_text")), schema, run, rows=256)
