"""What a round of prefix doubling costs: memory that is kept, and keys sorted as numbers."""

import ctypes
import os
import subprocess
import sys

import numpy as np
import pytest

from kinfold.llm import doubling

FAULTS = """
import resource
import numpy as np, pyarrow as pa
from kinfold.llm import doubling as D

raw = np.random.default_rng(1).integers(97, 123, 1_000_000, dtype=np.uint8).tobytes()
n = np.full(500, 2000, np.int32)
row = (0, raw, n, None, np.arange(500), np.arange(500, dtype=np.int32), n * 0, None, None)
batch = D._batch([row], D._ROW)
for _ in range(8):
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    for _, block in D.read_blocks(batch, 50, False):
        keys, doc, at, n = D.sieve_keys(block, 16, 16, 50)
        block.cut(D.windows_of(block, at[::2], n[::2]), 50)
print(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
"""


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "mallopt"), reason="another C library")
def test_memory_is_kept_between_blocks():
    """The eighth block's arrays take the place of the seventh's, without new pages of the system."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", FAULTS], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 1500


@pytest.mark.parametrize("kept", [64, 6])
def test_unlike_keys_of_one_hash(kept):
    """Hashes of few bits: unlike keys of one hash stay apart, equal ones together."""
    rng = np.random.default_rng(kept)
    a, b = rng.integers(0, 700, 20_000).astype(np.uint64), rng.integers(0, 3, 20_000).astype(np.uint64)
    h = doubling.mix(a) >> np.uint64(64 - kept) << np.uint64(64 - kept)
    order, equal = doubling.by_hash(h, [a, b])
    assert sorted(order.tolist()) == list(range(20_000))
    rows = list(zip(a[order].tolist(), b[order].tolist(), strict=True))
    assert [x == y for x, y in zip(rows[1:], rows[:-1], strict=True)] == equal.tolist()
    assert 1 + int((~equal).sum()) == len(set(rows))
    assert (np.diff((h[order] >> np.uint64(32)).astype(np.int64)) >= 0).all()


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_keys_by_hand(n):
    rng = np.random.default_rng(n)
    a, b, doc = (rng.integers(0, 60, n) for _ in range(3))
    keys = doubling.Keys(a.astype(np.uint64), b.astype(np.uint64))
    least = {}
    for x, y, d in zip(a.tolist(), b.tolist(), doc.tolist(), strict=True):
        least[x, y] = min(d, least.get((x, y), d))
    assert len(keys.first) == len(least)
    assert keys.items(keys.least(doc)).tolist() == [least[k] for k in zip(a.tolist(), b.tolist(), strict=True)]


def test_sieve_by_hand():
    rng = np.random.default_rng(5)
    brief, several = rng.integers(0, 3000, 4000).astype(np.uint32), (rng.random(4000) < 0.1).astype(np.uint8)
    told = doubling.Ask("sieve").answer(0, [brief, several])
    want = [int(brief.tolist().count(k) + several[brief == k].sum() > 1) for k in brief.tolist()]
    assert told.tolist() == want


def block_of(raw, alive=None):
    data = np.frombuffer(raw, np.uint8)
    one = np.array([len(data)], np.int32)
    alive = doubling.window_ends(np.array([0, len(data)]), 50)[: len(data)] if alive is None else alive
    return doubling.Block(0, data, one, one, np.array([1]), one * 0, one * 0, alive, np.zeros(0, np.uint64), None)


@pytest.mark.parametrize("size", [16, 32])
@pytest.mark.parametrize("n", [10, 49, 50, 51, 64, 1500])
def test_least_hashes_do_not_depend_on_pieces(n, size):
    """A window's least hash is that of the window alone, wherever a piece ends."""
    raw = bytes(np.random.default_rng(n).integers(97, 100, n, dtype=np.uint8))
    alone = [int(doubling.least_hashes(block_of(raw[k : k + 50]), 16, size, 50)[0]) for k in range(n - 49)]
    for piece in (7, 64, 10_000):
        assert doubling.least_hashes(block_of(raw), 16, size, 50, piece)[: max(0, n - 49)].tolist() == alone


def test_hashes_of_a_run_depend_on_its_bytes():
    raw = bytes(np.random.default_rng(3).integers(97, 100, 900, dtype=np.uint8))
    start, length = np.array([0, 30, 100, 400, 850]), np.array([50, 63, 130, 300, 50])
    x, y = doubling.Fingerprints(block_of(raw), 16).of(start, length, 50)
    for i, (a, n) in enumerate(zip(start.tolist(), length.tolist(), strict=True)):
        own = doubling.Fingerprints(block_of(b"zz" + raw[a : a + n] + b"y"), 16).of(np.array([2]), np.array([n]), 50)
        assert (own[0][0], own[1][0]) == (x[i], y[i])
        other = bytearray(raw[a : a + n])
        for k in range(n):
            changed = doubling.Fingerprints(block_of(bytes(other[:k] + b"!" + other[k + 1 :])), 16).of(np.array([0]), np.array([n]), 50)
            assert changed[0][0] != x[i]


@pytest.mark.parametrize("share", [0, 0.02, 0.5, 1])
def test_spread_by_hand(share):
    alive = np.random.default_rng(2).random(300) < share
    for width in (1, 2, 35, 400):
        assert doubling.spread(alive, width).tolist() == [bool(alive[max(0, i - width + 1) : i + 1].any()) for i in range(300)]
