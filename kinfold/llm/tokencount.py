"""Edit-aware token counts: a segment tree over each document's pre-tokens, re-encoded only around edits."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_PIECES = 200_000
#: What an edit replaces in the stated edit script: mail addresses, numbers of 7 digits or more (marks inside allowed).
SCRUB = re.compile(r"(?<![\w.+-])[\w.+-]+@[\w-]+\.[\w.-]+|(?<!\d)\d(?:[ .-]?\d){6,}")
MARK = "<PII>"


class PieceCounter:
    """Byte-level BPE ids of pre-tokens; their number is kept in a bounded cache."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE_PIECES):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.single = self.encoding._core_bpe.encode_single_piece
        self.find, self.iter = regex.compile(pattern).findall, regex.compile(pattern).finditer
        self.cache: dict[str, int] = {}
        self.most = cache

    def _count(self, piece: str) -> int:
        n = len(self.single(piece.encode()))
        if len(self.cache) < self.most:
            self.cache[piece] = n
        return n

    def counts(self, text_pieces: list[str]) -> list[int]:
        get, make = self.cache.get, self._count
        return [get(p) or make(p) for p in text_pieces]


class SegmentTree:
    """Sums over a fixed number of leaves, level by level; a changed leaf updates its ancestors only."""

    def __init__(self, leaves: np.ndarray):
        self.levels = [np.asarray(leaves, np.int64).copy()]
        while len(self.levels[-1]) > 1:
            last = self.levels[-1]
            self.levels.append(np.add.reduceat(last, np.arange(0, len(last), 2)))

    def total(self) -> int:
        return int(self.levels[-1][0]) if len(self.levels[-1]) else 0

    def update(self, first: int, values: np.ndarray) -> None:
        self.levels[0][first : first + len(values)] = values
        lo, hi = first, first + len(values) - 1
        for k in range(1, len(self.levels)):
            lo, hi = lo // 2, hi // 2
            below = self.levels[k - 1][2 * lo : 2 * hi + 2]
            self.levels[k][lo : hi + 1] = np.add.reduceat(below, np.arange(0, len(below), 2))

    def prefix(self, n: int) -> int:
        """Sum of the first n leaves."""
        out = 0
        for level in self.levels:
            if n & 1:
                out += int(level[n - 1])
            n >>= 1
        return out


class CountedText:
    """A text with its pre-token boundaries and a tree of their token counts.

    Leaves stand for the original pre-tokens. Around an edit the new text is split and encoded again, from
    two pre-tokens before the first one touched (a match looks at most one character past itself and the
    white space there, so that boundary stands) to the first new boundary that is an old one behind the
    edits met so far: from equal places, equal remaining texts are split alike. The region's count goes to
    its first leaf, and its other leaves become 0.
    """

    def __init__(self, text: str, counter: PieceCounter):
        self.text, self.counter = text, counter
        found = counter.find(text)
        self._set(np.fromiter(map(len, found), np.int64, len(found)), np.array(counter.counts(found), np.int64))
        self.encoded = 0

    def _set(self, sizes: np.ndarray, counts: np.ndarray) -> None:
        self.sizes, self.counts = sizes, counts
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.tree = SegmentTree(counts)
        self.regions: list[tuple[int, int, list[int], list[int]]] = []

    def _settle(self) -> None:
        """Puts the pre-tokens of the edits before in the place of those they replaced; nothing is encoded."""
        sizes, counts, done = [], [], 0
        for leaf, last, own_sizes, own_counts in self.regions:
            sizes += [self.sizes[done:leaf], np.array(own_sizes, np.int64)]
            counts += [self.counts[done:leaf], np.array(own_counts, np.int64)]
            done = max(leaf, last)
        self._set(np.concatenate([*sizes, self.sizes[done:]]), np.concatenate([*counts, self.counts[done:]]))

    def total(self) -> int:
        return self.tree.total()

    def apply(self, edits: list[tuple[int, int, str]]) -> str:
        """Replaces the character ranges [a, b) of the text as it now is, ascending and disjoint; returns the
        new text. Edits may come in any number of calls."""
        if self.regions:
            self._settle()
        parts, done = [], 0
        for a, b, new in edits:
            parts += [self.text[done:a], new]
            done = b
        text = "".join(parts) + self.text[done:]
        n, k, shift, settled = len(self.start) - 1, 0, 0, 0
        joined: dict[int, int] = {}
        while k < len(edits):
            leaf = max(settled, int(np.searchsorted(self.start, edits[k][0], "right")) - 3, 0)
            pieces, last, end = [], n, -1
            for m in self.counter.iter(text, int(self.start[leaf]) + shift):
                pieces.append(m.group())
                place = m.end()
                while k < len(edits) and place >= edits[k][0] + shift:
                    end = edits[k][1]
                    shift += len(edits[k][2]) - (end - edits[k][0])
                    k += 1
                old = place - shift
                if old >= end >= 0:
                    i = int(np.searchsorted(self.start, old))
                    if self.start[i] == old:
                        last = i
                        break
            else:
                k = len(edits)
            counts = self.counter.counts(pieces)
            count = int(sum(counts))
            self.regions.append((leaf, last, [len(p) for p in pieces], list(counts)))
            self.encoded += len(pieces)
            if not n:
                self.tree = SegmentTree(np.array([count]))
            elif last > leaf:
                values = np.zeros(last - leaf, np.int64)
                values[0] = count + joined.pop(leaf, 0)
                self.tree.update(leaf, values)
            else:  # the region takes the place of no old leaf: it joins the one behind, or the last
                at = min(leaf, n - 1)
                joined[leaf] = joined.get(leaf, 0) + count
                self.tree.update(at, self.tree.levels[0][at : at + 1] + count)
            settled = last
        self.text = text
        return text


def scrub_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), MARK) for m in SCRUB.finditer(text)]


_counters: dict[str, PieceCounter] = {}


def edited_counts(docs: DataFrame, edits=scrub_edits, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_edits, tokens_before, tokens_after, pieces, pieces_encoded_again for every row of docs.

    edits: text -> ascending, disjoint (start, end, replacement) by character. The count after the edits
    comes from the tree; a whole second encoding never happens. Null and empty texts count 0; repeated
    rows are counted each.
    """
    if path is None:
        import public_tokenizers

        path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(path) or _counters.setdefault(path, PieceCounter(path, pattern))
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for t in b.column("text"):
                doc = CountedText(t.as_py() or "", counter)
                before, todo = doc.total(), edits(doc.text)
                if todo:
                    doc.apply(todo)
                for c, v in zip(cols, (len(todo), before, doc.total(), len(doc.start) - 1, doc.encoded), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols]], names=["doc_id", "n_edits", "tokens_before", "tokens_after", "pieces", "pieces_encoded_again"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_edits long, tokens_before long, tokens_after long, pieces long, pieces_encoded_again long")
