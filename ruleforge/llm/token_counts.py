"""Edit-aware token counts.

Each document keeps a segment tree over its pre-tokens: a leaf holds the text
of some pre-tokens and their token and character counts, an inner node the
sums of its children. An edit cuts its place out of the leaves that it
touches, takes one leaf's worth of context before it, and splits and encodes
that stretch again, reading on until a leaf's border is a pre-token border
once more; from there on nothing can have changed. Only the paths above the
touched leaves are summed anew.

Added tokens of the tokenizer count as ordinary text. Edits of a document
have positions in its text before all of them and must not overlap; those
that overlap an earlier one are left out and reported.

Cases: null or empty text has one empty leaf and no tokens; null edits are
none; an edit beyond the end is cut to the text; repeated rows give a row
each; an empty table gives no rows; only the id, text and edits columns are
read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .bpe import BacktrackingBpe, loaded, tokenizer_spec
from .common import col, id_type, map_batches, texts_of

LEAF = 64      # pre-tokens of a leaf as built
CONTEXT = 4    # characters that decide whether a border stands: the longest look of the pre-token pattern

EDITS = "array<struct<start:bigint,end:bigint,text:string>>"
TREE = "leaves array<string>, tokens array<int>, chars array<int>"


class CountTree:
    """Leaves and the heap-ordered sums of their tokens and characters."""

    def __init__(self, leaves: list[str], tokens: list[int], chars: list[int]):
        self.leaves, self.tokens, self.chars = leaves, tokens, chars
        self.size = len(leaves)      # leaf k is node size + k
        self.encoded = 0             # pre-tokens encoded by edits

    @classmethod
    def of(cls, text: str, bpe: BacktrackingBpe) -> CountTree:
        words = bpe.split_words(text)
        groups = [words[k:k + LEAF] for k in range(0, len(words), LEAF)] or [[]]
        leaves = ["".join(g) for g in groups]
        return cls.summed(leaves, [count(g, bpe) for g in groups])

    @classmethod
    def summed(cls, leaves: list[str], counts: list[int]) -> CountTree:
        tokens, chars = [0] * len(leaves) + counts, [0] * len(leaves) + [len(x) for x in leaves]
        for k in range(len(leaves) - 1, 0, -1):
            tokens[k] = tokens[2 * k] + tokens[2 * k + 1]
            chars[k] = chars[2 * k] + chars[2 * k + 1]
        return cls(leaves, tokens, chars)

    def total(self) -> int:
        return self.tokens[1] if self.size > 1 else self.tokens[self.size]

    def _set(self, leaf: int, text: str, count: int) -> None:
        self.leaves[leaf] = text
        at = self.size + leaf
        self.tokens[at], self.chars[at] = count, len(text)
        at //= 2
        while at:
            if 2 * at + 1 < 2 * self.size:
                self.tokens[at] = self.tokens[2 * at] + self.tokens[2 * at + 1]
                self.chars[at] = self.chars[2 * at] + self.chars[2 * at + 1]
            at //= 2

    def starts(self) -> list[int]:
        out, at = [], 0
        for x in self.chars[self.size:]:
            out.append(at)
            at += x
        return out

    def edit(self, start: int, end: int, text: str, starts: list[int], bpe: BacktrackingBpe) -> None:
        """Replace characters ``start`` to ``end``; ``starts`` are the leaves' places in the present text."""
        from bisect import bisect_right

        first = max(0, bisect_right(starts, max(0, start - CONTEXT)) - 1)
        while first and not self.leaves[first]:
            first -= 1
        last = max(first, bisect_right(starts, end) - 1)
        while True:
            after, seen = last + 1, 0   # leaves after the last one, as context
            while after < self.size and seen < CONTEXT:
                seen += len(self.leaves[after])
                after += 1
            old = "".join(self.leaves[first:last + 1])
            new = old[:start - starts[first]] + text + old[end - starts[first]:]
            words, at = [], 0
            for w in bpe.split_words(new + "".join(self.leaves[last + 1:after])):
                if at >= len(new):
                    break
                words.append(w)
                at += len(w)
            if at == len(new):
                break
            last += 1                   # a pre-token crosses the border: read on
        self.encoded += len(words)
        self._set(first, new, count(words, bpe))
        for k in range(first + 1, last + 1):
            if self.leaves[k]:
                self._set(k, "", 0)

    def apply(self, edits: list[tuple[int, int, str]], bpe: BacktrackingBpe) -> int:
        """Apply edits from the last to the first, so that positions before them stay; gives the number left out."""
        size = sum(self.chars[self.size:])
        usable, reach = [], 0
        for s, e, t in sorted((max(0, min(s, size)), max(0, min(e, size)), t or "") for s, e, t in edits):
            if s >= reach and e >= s:
                usable.append((s, e, t))
                reach = max(e, s)
        for s, e, t in reversed(usable):
            self.edit(s, e, t, self.starts(), bpe)
        return len(edits) - len(usable)


def count(words: list[str], bpe: BacktrackingBpe) -> int:
    return sum(map(len, map(bpe.words.__getitem__, words))) // 4  # four bytes an id


def build(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None, path: str | None = None) -> DataFrame:
    """Trees of all rows: the id, ``leaves``, ``tokens`` and ``chars`` (sums in heap order), and the edits if there are any."""
    spec = df.sparkSession.sparkContext.broadcast(tokenizer_spec(path))
    name = id_col.replace("`", "``")
    rows = [col(id_col).alias(id_col), col(text_col).cast("string").alias("_text")]
    schema = f"`{name}` {id_type(df, id_col)}, {TREE}"
    if edits_col:
        rows.append(col(edits_col).cast(EDITS).alias("_edits"))
        schema += f", _edits {EDITS}"

    def run(batch):
        bpe = loaded(spec.value)
        trees = [CountTree.of(t, bpe) for t in texts_of(batch)]
        out = {id_col: batch.column(0), "leaves": [t.leaves for t in trees], "tokens": [t.tokens for t in trees], "chars": [t.chars for t in trees]}
        return out | ({"_edits": batch.column("_edits")} if edits_col else {})

    return map_batches(df.select(*rows), schema, run, rows=128)


def update(trees: DataFrame, id_col: str = "doc_id", path: str | None = None, keep_tree: bool = True) -> DataFrame:
    """Apply ``_edits`` to the trees: the id, ``n_tokens_before``, ``n_tokens``, ``n_edits``, ``n_left_out``, ``n_encoded``, and the new tree."""
    spec = trees.sparkSession.sparkContext.broadcast(tokenizer_spec(path))
    name = id_col.replace("`", "``")
    schema = (f"`{name}` {id_type(trees, id_col)}, n_tokens_before bigint, n_tokens bigint, n_edits bigint, n_left_out bigint, n_encoded bigint"
              + f", {TREE}" * keep_tree)
    names = ["n_tokens_before", "n_tokens", "n_edits", "n_left_out", "n_encoded"] + ["leaves", "tokens", "chars"] * keep_tree

    def run(batch):
        out = {id_col: batch.column(id_col)} | {n: [] for n in names}
        totals = batch.column("tokens").to_pylist() if keep_tree else None
        for k, edits in enumerate(batch.column("_edits").to_pylist()):
            edits = [(e["start"], e["end"], e["text"]) for e in edits or [] if e and e["start"] is not None and e["end"] is not None]
            if not edits and not keep_tree:  # nothing to touch: the root has the count
                sums = batch.column("tokens")[k].values
                root = sums[1 if len(sums) > 2 else len(sums) // 2].as_py()
                row = [root, root, 0, 0, 0]
            else:
                tree = CountTree(batch.column("leaves")[k].as_py(), totals[k] if totals else batch.column("tokens")[k].as_py(),
                                 batch.column("chars")[k].as_py())
                before = tree.total()
                bad = tree.apply(edits, loaded(spec.value)) if edits else 0
                row = [before, tree.total(), len(edits) - bad, bad, tree.encoded] + [tree.leaves, tree.tokens, tree.chars] * keep_tree
            for n, v in zip(names, row):
                out[n].append(v)
        return out

    return map_batches(trees.select(col(id_col), "leaves", "tokens", "chars", "_edits"), schema, run, rows=128)


def redactions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table's id and text with ``edits``: personal data and secrets replaced by the name of their kind."""
    from . import pii, secrets

    name = id_col.replace("`", "``")

    def run(batch):
        edits = []
        for t in texts_of(batch):
            spans = sorted({(s, e, k) for k, s, e in pii.base_spans(t)} | {(s, e, k) for k, s, e, _ in secrets.base_matches(t)})
            own, reach = [], 0
            for s, e, k in spans:
                if s >= reach:
                    own.append({"start": s, "end": e, "text": f"[{k.upper()}]"})
                    reach = e
            edits.append(own)
        return {id_col: batch.column(0), "_text": batch.column(1), "edits": edits}

    return map_batches(df.select(col(id_col), col(text_col).cast("string").alias("_text")),
                       f"`{name}` {id_type(df, id_col)}, _text string, edits {EDITS}", run)
