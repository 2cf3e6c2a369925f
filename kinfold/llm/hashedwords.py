"""Hashed features of whole texts, by sentence or by document: words and how they begin."""

from __future__ import annotations

import numpy as np

from .textgrid import LOWER_CODE, Grid, mix, prefix_hash, span_hash

BITS = 18
#: Besides the whole word, its first bytes are features: a stem may take endings never seen in training.
STEMS = (4, 5, 6)
#: Letters, digits and all bytes outside ASCII make words here; everything else separates them.
_WORDLESS = np.array([not (chr(b).isalnum() and b < 128 or b >= 128) for b in range(256)])
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])


class Features:
    """index: the features of each word, by column; sentence: first word of each sentence; doc: first sentence of each document."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        g = self.grid = Grid(data, offs, separators=_WORDLESS)
        prefix = prefix_hash(LOWER_CODE[g.data])
        size = g.end - g.start
        kinds = [mix(span_hash(prefix, g.start, size) + size.astype(np.uint64)), *[mix(span_hash(prefix, g.start, np.minimum(size, n)) + np.uint64(n)) for n in STEMS]]
        self.index = np.stack([(h & np.uint64((1 << BITS) - 1)).astype(np.int32) for h in kinds])
        stops = np.concatenate([[0], np.cumsum(_STOP[g.data])])
        fresh = np.ones(len(g.start), bool)
        fresh[1:] = stops[g.start[1:]] > stops[g.end[:-1]]
        fresh[g.first[:-1][g.first[:-1] < len(g.start)]] = True
        self.sentence = np.flatnonzero(fresh)
        self.doc = np.searchsorted(self.sentence, g.first)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the words' weights in each sentence."""
        return np.add.reduceat(weights[self.index].sum(axis=0), self.sentence) if len(self.sentence) else np.zeros(0)


def group_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[k] : first[k + 1]], 0 for empty groups: each from its own values alone."""
    out = np.zeros((len(first) - 1,) + values.shape[1:])
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0)
    return out
