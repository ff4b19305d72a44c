"""Byte-level BPE from a rank file: merges found with a segment tree.

A text is split by a pattern and each match is encoded by itself. A match that
is a token as it stands gets that token. Any other starts as single bytes; a
segment tree over its byte positions holds, for each live part, the rank of
the part joined with the one behind it, and every inner node the smallest of
its span, the leftmost of equals. The root names the next merge. A merge
touches three leaves: the joined part, the part it swallowed and the part
before it, so each costs a logarithmic number of node updates and a match of n
bytes O(n log n), without any limit on its length.

Decoding puts the tokens' bytes behind each other, which gives back the text.

Cases: a null text counts as empty (0 tokens, digests of the empty string);
texts and matches of any length are encoded whole; equal ranks merge from the
left; repeated rows each give a row; an empty table gives no rows; only the id
and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain
from typing import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import col, id_type, map_batches, texts_of

MEMO_WORDS = 400_000   # encoded matches kept per Python worker, and as many of an older generation
ROW_BYTES = 64         # longest match, in bytes, whose tree is a row among others; longer ones aren't kept either
ROWS_CELLS = 1 << 18   # rows x width of the arrays at a time
GROUP_CHARS = 1 << 19  # texts that are encoded together: this many characters, or one longer text


class SegmentTreeBpe:
    """Encoder and decoder for one rank file: the file's text and the splitting pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex

        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
        self.by_id: dict[int, bytes] = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.none = max(self.by_id) + 1
        # ids of single bytes, and of the tokens that two tokens make together
        self.bytes_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {self.ranks[t[:k]] * self.none + self.ranks[t[k:]]: made for t, made in self.ranks.items()
                 for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.made = np.array([pairs[k] for k in self.pairs.tolist()], dtype=np.int64)
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match that is not a token itself."""
        n, none, longest, rank_of = len(piece), self.none, self.longest, self.ranks.get
        width = 1 << max(n - 1, 1).bit_length()
        dead = none * width                                  # a key is rank * width + position: order by rank, then from the left
        tree = [dead] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = rank_of(piece[i:i + 2], none) * width + i
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a <= b else b
        after, before = list(range(1, n + 1)), list(range(-1, n))

        while (top := tree[1]) < dead:
            i = top % width
            gone = after[i]
            after[i] = end = after[gone]
            before[end] = i
            # the three leaves that change: the swallowed part, the joined part, the part before it
            changed = [(gone, dead)]
            if end < n and (stop := after[end]) - i <= longest:
                changed.append((i, rank_of(piece[i:stop], none) * width + i))
            else:
                changed.append((i, dead))
            if (p := before[i]) >= 0:
                changed.append((p, rank_of(piece[p:end], none) * width + p if end - p <= longest else dead))
            for k, key in changed:
                k += width
                tree[k] = key
                while k > 1:
                    if (other := tree[k ^ 1]) < key:
                        key = other
                    k >>= 1
                    if tree[k] == key:
                        break                                # nothing above changes
                    tree[k] = key
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i:after[i]]])
            i = after[i]
        return out

    def pair_ids(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id (rank) of the token that two tokens make together, ``none`` where there is no such token."""
        wanted = left * self.none + right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.made[at], self.none)

    def merge_rows(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        """``merge`` for pieces of at most ``width`` bytes (a power of two), a row each."""
        count, none, dead = len(pieces), self.none, self.none * width
        sizes = np.array(list(map(len, pieces)))
        token = self.bytes_ids[np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), dtype=np.uint8)].reshape(count, width)
        place = np.arange(width)
        tree = np.full((count, 2 * width), dead, dtype=np.int64)
        first = self.pair_ids(token[:, :-1], token[:, 1:]) * width + place[:-1]
        tree[:, width:-1] = np.where(place[1:] < sizes[:, None], np.minimum(first, dead), dead)
        for k in (1 << np.arange(width.bit_length() - 1))[::-1]:
            tree[:, k:2 * k] = np.minimum(tree[:, 2 * k:4 * k:2], tree[:, 2 * k + 1:4 * k:2])
        after, before = np.tile(place + 1, (count, 1)), np.tile(place - 1, (count, 1))
        live = place < sizes[:, None]

        def put(rows, at, key):
            k = at + width
            tree[rows, k] = key
            while k[0] > 1:                                  # leaves are all at one depth
                key = np.minimum(key, tree[rows, k ^ 1])
                k = k >> 1
                tree[rows, k] = key

        rows = np.arange(count)
        while len(rows := rows[tree[rows, 1] < dead]):
            made, i = np.divmod(tree[rows, 1], width)
            gone = after[rows, i]
            end = after[rows, gone]
            token[rows, i], after[rows, i], live[rows, gone] = made, end, False
            put(rows, gone, np.full(len(rows), dead))
            more = end < sizes[rows]
            r, at, to = rows[more], i[more], end[more]
            before[r, to] = at
            key = np.full(len(rows), dead)
            key[more] = np.minimum(self.pair_ids(made[more], token[r, to]) * width + at, dead)
            put(rows, i, key)
            p = before[rows, i]
            if len(r := rows[p >= 0]):
                q, right = p[p >= 0], made[p >= 0]
                put(r, q, np.minimum(self.pair_ids(token[r, q], right) * width + q, dead))
        flat, ends = token[live].tolist(), np.cumsum(live.sum(axis=1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]

    def learn(self, words: set[str]) -> None:
        """Put words into the memo. A full memo is kept as the older one, from which words that come again return."""
        if len(self.memo) + len(words) > MEMO_WORDS:
            self.memo, self.older = {}, self.memo
        known, older = self.memo, self.older
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for word in words.difference(known):
            if (ids := older.get(word)) is None:
                piece = word.encode()
                if (whole := self.ranks.get(piece)) is None:
                    if len(piece) <= ROW_BYTES:
                        by_width.setdefault(max(8, 1 << (len(piece) - 1).bit_length()), []).append((word, piece))
                    continue
                ids = (whole,)
            known[word] = ids
        for width, new in by_width.items():
            step = max(1, ROWS_CELLS // width)
            for at in range(0, len(new), step):
                part = new[at:at + step]
                known.update(zip([w for w, _ in part], self.merge_rows([p for _, p in part], width)))

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; the texts' new matches are merged together."""
        split = [self.split(t) for t in texts]
        self.learn(set(chain.from_iterable(split)))
        known = self.memo
        for words in split:
            try:
                yield list(chain.from_iterable(map(known.__getitem__, words)))
            except KeyError:                                 # a match too long for the memo
                yield list(chain.from_iterable([known.get(w) or self.merge(w.encode()) for w in words]))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids))


_LOADED: dict[tuple[int, str], SegmentTreeBpe] = {}


def loaded(ranks: bytes, pattern: str) -> SegmentTreeBpe:
    """The tokenizer of this Python process, built once."""
    key = (hash(ranks), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = SegmentTreeBpe(ranks, pattern)
    return _LOADED[key]


def groups(texts: list[str]) -> Iterator[list[str]]:
    """Neighbouring texts of about ``GROUP_CHARS`` characters together."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= GROUP_CHARS:
            yield held
            held, size = [], 0
    yield held


def rank_file(path: str | None = None) -> bytes:
    """Bytes of a rank file (about 1 MB); read on the driver and broadcast."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def encode_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                 pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """Encode every whole text by the rank file and decode it again.

    Returns the id column, ``n_tokens``, ``ids_sha256`` (ids as little-endian
    unsigned 32-bit integers), ``decoded_sha256`` and ``ids`` (array<int>, left
    out with ``with_ids=False``). One pass over the rows without a shuffle.
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    ranks = df.sparkSession.sparkContext.broadcast(rank_file(path))
    name = id_col.replace("`", "``")
    schema = f"`{name}` {id_type(df, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batch):
        bpe = loaded(ranks.value, pattern)
        out = {id_col: batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        for ids in chain.from_iterable(map(bpe.encode_all, groups(texts_of(batch)))):
            packed = np.array(ids, dtype="<u4")
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(packed.tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            if with_ids:
                out["ids"].append(packed.astype(np.int32))
        return out

    return map_batches(df.select(col(id_col), col(text_col).cast("string").alias("_text")), schema, run, rows=256)
