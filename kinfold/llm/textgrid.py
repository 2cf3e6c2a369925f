"""Words and byte strings of whole batches of texts as numpy arrays.

Texts stay in Arrow's buffers: one array of UTF-8 bytes and the documents' offsets into it.
A word is a maximal run of bytes other than 0x20 and 0x09-0x0D inside one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2_000_000
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += np.uint8(32)
LOWER_CODE = BYTE_CODE[_LOWER]
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_29, _32 = np.uint64(29), np.uint64(32)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed by a digest.
LONG_WORD = 64
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64, for i below n at least."""
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def stirred(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of two numbers, made in place of the first: a change of either one changes it."""
    t = x >> _29
    x ^= t
    x *= _K[3]
    x += y
    np.right_shift(x, _32, out=t)
    x ^= t
    x *= _K[2]
    np.right_shift(x, _29, out=t)
    x ^= t
    return x


def unaligned(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number (a view); behind the data are zeros."""
    return np.ndarray(len(data) + 8, "<u8", np.concatenate([data, np.zeros(16, np.uint8)]).tobytes(), strides=(1,))


def word_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray, lanes: int = 1) -> list[np.ndarray]:
    """One or two 64-bit hashes of each word, from its eight-byte pieces in turn; from its digest over 64 bytes."""
    words = unaligned(data)
    out = [size.astype(np.uint64) * _K[k] + _K[k + 2] for k in range(lanes)]
    long = size > LONG_WORD
    live = np.flatnonzero(~long & (size > 0))
    done = 0
    while len(live):
        piece = words[start[live] + done] & _MASKS[np.minimum(size[live] - done, 8)]
        for k in range(lanes):
            out[k][live] = stirred(out[k][live], piece * _K[4 + k])
        done += 8
        live = live[size[live] > done]
    if long.any():
        at = np.flatnonzero(long)
        raw = data.tobytes()
        digests = b"".join(hashlib.blake2b(raw[a : a + n], digest_size=16).digest() for a, n in zip(start[at].tolist(), size[at].tolist(), strict=True))
        for k, own in enumerate(np.frombuffer(digests, np.uint64).reshape(-1, 2).T[:lanes]):
            out[k][at] = own
    return out


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Sums of codes[i] * base**i before each place; see span_hash."""
    p, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * p[: len(codes)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, length) -> np.ndarray:
    """Hash of codes[start : start + length], the same wherever the span lies."""
    _, inv = powers(len(prefix) + 1)
    return mix((prefix[start + length] - prefix[start]) * inv[start] + np.uint64(0x632BE59BD9B4E019))


def batch_text(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null is an empty text."""
    col = batch.column(name)
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_string()).cast(pa.large_binary()) if not pa.types.is_binary(col.type) else col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and len(col.buffers()[2]) else np.zeros(0, np.uint8)
    return data, offs


def pieces(offs: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about limit bytes together (one document at least)."""
    k, n = 0, len(offs) - 1
    while k < n:
        e = max(k + 1, int(np.searchsorted(offs, offs[k] + limit, "right")) - 1)
        yield k, min(e, n)
        k = min(e, n)


class Grid:
    """The words of some documents: start and end bytes, first word of each document, and lanes hashes of each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False, lanes: int = 0, separators: np.ndarray = _SEP):
        self.data = data = data[offs[0] : offs[-1]]
        self.offs = offs = offs - offs[0]
        n = len(data)
        full = ~separators[data]
        cut = np.zeros(n + 1, bool)
        cut[offs] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = full[:-1], full[1:]
            before &= ~cut[:-1]
            after &= ~cut[1:]
        self.start = np.flatnonzero(full & ~before)
        self.end = np.flatnonzero(full & ~after) + 1
        self.first = np.searchsorted(self.start, offs)
        self.lanes = word_hashes(_LOWER[data] if lower else data, self.start, self.end - self.start, lanes) if lanes else []


def window_ends(bounds: np.ndarray, length: int) -> np.ndarray:
    """Mask over all places: whether a window of that length that starts there stays in its document."""
    ok = np.zeros(int(bounds[-1]) + 1, np.int32)
    last = np.maximum(bounds[1:] - length + 1, bounds[:-1])
    np.add.at(ok, bounds[:-1], 1)
    np.add.at(ok, last, -1)
    return np.cumsum(ok[:-1]) > 0
