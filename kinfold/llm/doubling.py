"""Prefix doubling over blocks of text: which windows of a length an earlier document holds.

Windows are of bytes or of words; "symbols" below are either. Bytes are compared themselves, words by 128 bits.
A block is a row with some segments of documents. In each round the blocks send keys of their positions to
buckets, a bucket sorts the keys of all blocks and answers, and the blocks keep what is left:

* sieve rounds, on sampled positions: equal windows have equal least hashes of the shorter strings inside,
  and windows whose least hash no other document holds leave. A sieve errs on the side of keeping;
* settling: neighbouring windows with one least hash are a run. A run that an earlier document holds whole
  goes at once. Its windows all start in that document too, whose own run stays, so nothing is lost;
* doubling, on all positions left: pairs (rank, rank at the growing offset) are sorted and ranked anew,
  from the bytes themselves up to the window's length. What one document alone holds leaves.

A block sends a key once however often it holds it, so a passage that a third of all rows share costs a
bucket one row a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, keep_memory, materialize
from .textgrid import _K, Grid, batch_text, mix, pieces, stirred, unaligned, window_ends

BLOCK_BYTES = 1_000_000
BUCKET_BYTES = 16_000_000
#: Text of a partition; words take several times the memory of their bytes.
PART_BYTES, WORD_PART_BYTES = 10_000_000, 4_000_000
SCHEMA = "block long, raw binary, size array<int>, count array<int>, doc array<long>, home array<int>, start array<int>, alive binary, rank binary"
#: Spans that go: the row of the block's first table, the first window's place in it, and how many windows.
GONE = "gone_home array<int>, gone_place array<int>, gone_n array<int>"
_LOW32 = np.uint64(0xFFFFFFFF)


@dataclass
class Block:
    """size, count, doc, home, start: bytes and symbols of each segment, its document, its row in the first
    table, its first symbol's place there. alive: the places where windows still start. rank: ranks of the
    places that alive windows need. words: where symbols are words, they; None for bytes."""

    block: int
    data: np.ndarray
    size: np.ndarray
    count: np.ndarray
    doc: np.ndarray
    home: np.ndarray
    start: np.ndarray
    alive: np.ndarray
    rank: np.ndarray
    words: Grid | None

    @property
    def offs(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.count, dtype=np.int64)])

    def segment(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offs, at, "right") - 1

    def docs(self, at: np.ndarray) -> np.ndarray:
        return self.doc[self.segment(at)]

    def row(self) -> tuple:
        return (self.block, self.data.tobytes(), self.size, self.count, self.doc, self.home, self.start, np.packbits(self.alive).tobytes(), self.rank.tobytes())

    def bare(self, alive: np.ndarray, rank: np.ndarray) -> Block:
        """Ranks tell all that is left to know."""
        return replace(self, data=self.data[:0], size=self.size * 0, alive=alive, rank=rank, words=None)

    def cut(self, alive: np.ndarray, length: int) -> Block:
        """Only the symbols that windows in `alive` cover; touching windows of one segment stay together."""
        offs = self.offs
        cover = spread(alive, length)
        fresh = cover & ~np.concatenate([[False], cover[:-1]])
        opens = offs[:-1][self.count > 0]
        fresh[opens] = cover[opens]
        first, index = np.flatnonzero(fresh), np.cumsum(cover, dtype=np.int32)
        count = np.diff(np.append(index[first] - 1, index[-1] if len(index) else 0))
        seg = self.segment(first)
        size, kept = count, cover
        if self.words is not None:
            begin, end = self.words.start[first], self.words.end[np.flatnonzero(cover)[np.cumsum(count) - 1]]
            size, step = end - begin, np.zeros(len(self.data) + 1, np.int32)
            step[begin] += 1
            np.add.at(step, end, -1)
            kept = np.cumsum(step[:-1]) > 0
        to_int = lambda x: x.astype(np.int32)
        return Block(self.block, self.data[kept], to_int(size), to_int(count), self.doc[seg], self.home[seg], to_int(self.start[seg] + first - offs[seg]), alive[cover], self.rank, self.words)

    def grams(self, short: int, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The `short` symbols from each place (of lo to hi) on as two numbers: up to 16 bytes themselves, or 128 bits of words."""
        total = len(self.data if self.words is None else self.words.start)
        hi = total if hi is None else min(hi, total)
        n = max(0, hi - lo)
        if self.words is None:
            words = unaligned(self.data[lo : hi + 16]).copy()
            if short == 16:
                return words[:n], words[8 : n + 8]
            mask = lambda k: np.uint64((1 << 8 * k) - 1)
            return words[:n] & mask(min(8, short)), words[8 : n + 8] & mask(max(0, short - 8))
        a, b = (joined(h[lo : hi + short], short)[:n] for h in self.words.lanes)
        return a, b

    def raw(self) -> tuple[bytes, int]:
        """All symbols as bytes, and the bytes of one."""
        return (self.data.tobytes(), 1) if self.words is None else (np.stack(self.words.lanes, axis=1).tobytes(), 16)

    def spans(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home, place, n) of the runs of n windows from `at` (rising), with touching ones joined."""
        seg = self.segment(at)
        place = self.start[seg] + at - self.offs[seg]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (seg[1:] != seg[:-1]) | (at[1:] != at[:-1] + n[:-1])
        first = np.flatnonzero(fresh)
        total = np.add.reduceat(n, first) if len(first) else n[:0]
        return self.home[seg[first]].astype(np.int32), place[first].astype(np.int32), total.astype(np.int32)


def spread(alive: np.ndarray, width: int) -> np.ndarray:
    """The places that `width` places from each one alive cover."""
    edge = np.flatnonzero(np.diff(alive, prepend=False, append=False))
    step = np.zeros(len(alive) + width + 1, np.int32)
    step[edge[::2]] += 1
    step[edge[1::2] + width - 1] -= 1
    return np.cumsum(step[: len(alive)], dtype=np.int32) > 0


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values."""
    size, out = 1, values
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    n = max(0, len(values) - width + 1)
    return np.minimum(out[:n], out[width - size : width - size + n])


def paired(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of what starts at each place and `step` places on; nothing behind the end."""
    rest = np.zeros_like(h)
    rest[: max(0, len(h) - step)] = h[step:]
    return stirred(h * _K[4], rest)


def joined(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n neighbours from each place on, by doubling."""
    size = 1
    while size < n:
        step = min(size, n - size)
        h, size = paired(h, step), size + step
    return h


class Fingerprints:
    """Two 64-bit hashes of strings of `short` symbols or twice that, made for the places that are asked for."""

    def __init__(self, block: Block, short: int):
        self.block, self.short, self.grams = block, short, block.grams(short)

    def level(self, at: np.ndarray, k: int, lane: int) -> np.ndarray:
        """The hashes of the short * 2**k symbols (all there) from some places on; k is 0 or 1."""
        a, b = self.grams
        h = stirred(b[at] * _K[2 * lane + 1], a[at] * _K[2 * lane])
        return stirred(h * _K[4], self.level(at + self.short, 0, lane)) if k else h

    def of(self, start: np.ndarray, length: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each of the strings (of `least` >= short symbols or more): from hashed pieces that cover
        it, the last of which may overlap; from its bytes, where there would be more than four."""
        k = int(2 * self.short <= least)
        size = self.short << k
        out = np.empty((2, len(start)), np.uint64)
        tail = start + length - size
        for lane in (0, 1):
            now = length.astype(np.uint64) * _K[5]
            for j in range(4):
                now = stirred(now, self.level(np.minimum(start + j * size, tail), k, lane))
            out[lane] = now
        long = np.flatnonzero(length > 4 * size)
        if len(long):
            raw, w = self.block.raw()
            digests = [hashlib.blake2b(raw[a * w : (a + n) * w], digest_size=16).digest() for a, n in zip(start[long].tolist(), length[long].tolist(), strict=True)]
            out[:, long] = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2).T
        return out[0], out[1]


def by_hash(h: np.ndarray, keys: list[np.ndarray], bits: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The order of the items by at least the top `bits` bits of a hash, equal keys beside each other; and which
    items equal the one before. Numbers that end in the items' places are sorted, several times as fast as places."""
    low = np.uint64(min(64 - bits, max(1, (len(h) - 1).bit_length())))
    ends = (np.uint64(1) << low) - np.uint64(1)
    packed = (h & ~ends) | np.arange(len(h), dtype=np.uint64)
    packed.sort()
    order = (packed & ends).astype(np.int64)
    tied = (packed[1:] ^ packed[:-1]) <= ends
    equal = tied.copy()
    for k in keys:
        own = k[order]
        equal &= own[1:] == own[:-1]
    unlike = tied & ~equal
    if unlike.any():  # unlike keys of one hash, as far as it was sorted
        group = np.concatenate([[0], np.cumsum(~tied)])
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[1:][unlike]] = True
        at = np.flatnonzero(mixed[group])
        order[at] = order[at][np.lexsort((*(k[order[at]] for k in keys[::-1]), group[at]))]
        at = at[at > 0]
        equal[at - 1] = np.logical_and.reduce([k[order[at]] == k[order[at - 1]] for k in keys])
    return order, equal


class Keys:
    """The distinct keys (pairs of numbers) of some items, in the order of a hash whose top bits name the bucket."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray | None = None):
        h = mix(k1 * _K[1] + _K[0]) if k2 is None else mix(mix(k1 * _K[1] + _K[0]) + k2 * _K[2])
        order, equal = by_hash(h, [k1] if k2 is None else [k1, k2])
        fresh = np.ones(len(h), bool)
        fresh[1:] = ~equal
        self.order, self.first = order, np.flatnonzero(fresh)
        self.group = np.cumsum(fresh) - 1
        lead = order[self.first]
        self.hash, self.k1, self.k2 = h[lead], k1[lead], None if k2 is None else k2[lead]

    def least(self, x: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(x[self.order], self.first) if len(self.first) else x[:0]

    def most(self, x: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(x[self.order], self.first) if len(self.first) else x[:0]

    def items(self, answer: np.ndarray) -> np.ndarray:
        """Each item's own of the answers to the distinct keys."""
        out = np.empty(len(self.order), answer.dtype)
        out[self.order] = answer[self.group]
        return out

    def cuts(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, its first key) for the buckets that keys go to, and one end more."""
        to = ((self.hash >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        at = np.flatnonzero(np.diff(to, prepend=~to[:1]) != 0)
        return to[at].astype(np.int64), np.append(at, len(to))


@dataclass(frozen=True)
class Ask:
    """What a round sends for its keys and what it is told.

    sieve: 32 bits of the key's hash; told: whether several documents or blocks hold it.
    rank: the key itself; told: its rank, or 0 where one document of one block holds it.
    low: the key and its smallest document; told: the smallest document of all blocks.
    """

    kind: str

    def load(self, keys: Keys, doc: np.ndarray) -> list[np.ndarray]:
        """Columns with a value for each distinct key."""
        low = keys.least(doc)
        if self.kind == "low":
            return [keys.k1, keys.k2, low]
        several = (low < keys.most(doc)).astype(np.uint8)
        return [(keys.hash & _LOW32).astype(np.uint32), several] if self.kind == "sieve" else [keys.k1, keys.k2, several]

    @property
    def kinds(self) -> list:
        return {"sieve": [np.uint32, np.uint8], "rank": [np.uint64, np.uint64, np.uint8], "low": [np.uint64, np.uint64, np.int64]}[self.kind]

    @property
    def told(self) -> type:
        return {"sieve": np.uint8, "rank": np.uint64, "low": np.int64}[self.kind]

    def answer(self, bucket: int, columns: list[np.ndarray]) -> np.ndarray:
        """The answer to each of the keys that all blocks sent to a bucket."""
        if self.kind == "sieve":
            packed = (columns[0].astype(np.uint64) << np.uint64(32)) | np.arange(len(columns[0]), dtype=np.uint64)
            packed.sort()
            order, brief = (packed & _LOW32).astype(np.int64), packed >> np.uint64(32)
            fresh = np.ones(len(brief), bool)
            fresh[1:] = brief[1:] != brief[:-1]
            first = np.flatnonzero(fresh)
            times = np.diff(np.append(first, len(brief)))
            yes = np.add.reduceat(columns[1][order], first, dtype=np.int64) + times > 1
            out = np.empty(len(brief), np.uint8)
            out[order] = np.repeat(yes, times)
            return out
        keys = Keys(columns[0], columns[1])
        if self.kind == "low":
            return keys.items(keys.least(columns[2]))
        times = np.diff(np.append(keys.first, len(keys.order))) + np.add.reduceat(columns[2][keys.order], keys.first, dtype=np.int64)
        rank = np.cumsum(times > 1).astype(np.uint64) + (np.uint64(bucket) << np.uint64(32))
        return keys.items(np.where(times > 1, rank, np.uint64(0)))


def _pack(columns: list[np.ndarray]) -> bytes:
    return np.int64(len(columns[0])).tobytes() + b"".join(c.tobytes() for c in columns)


def _unpack(raw: bytes, kinds: list) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def read_blocks(b: pa.RecordBatch, length: int, words: bool, lanes: int = 2) -> Iterator[tuple[int, Block]]:
    """The blocks of a batch; in those of whole documents, every window is alive."""
    keep_memory()
    for i in range(b.num_rows):
        get = lambda c, kind: np.asarray(b.column(c)[i].values).astype(kind, copy=False)  # noqa: E731, B023
        size, raw = get("size", np.int32), np.frombuffer(b.column("raw")[i].as_py(), np.uint8)
        grid = Grid(raw, np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), lanes=lanes) if words and len(raw) else None
        count = np.diff(grid.first).astype(np.int32) if grid is not None else get("count", np.int32) if b.column("count")[i].is_valid else size
        offs = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        bits = b.column("alive")[i].as_py()
        alive = window_ends(offs, length)[: offs[-1]] if bits is None else np.unpackbits(np.frombuffer(bits, np.uint8), count=int(offs[-1])).astype(bool)
        rank = b.column("rank")[i].as_py()
        yield i, Block(b.column("block")[i].as_py(), raw, size, count, get("doc", np.int64), get("home", np.int32), get("start", np.int32), alive, np.frombuffer(rank or b"", np.uint64), grid)


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(schema)], names=[n for n, _ in schema])


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_ROW = [("block", pa.int64()), ("raw", pa.binary()), ("size", _INTS), ("count", _INTS), ("doc", _LONGS), ("home", _INTS), ("start", _INTS), ("alive", pa.binary()), ("rank", pa.binary())]
_GONE = [("gone_home", _INTS), ("gone_place", _INTS), ("gone_n", _INTS)]

Make = Callable[..., "tuple[Keys, np.ndarray]"]


def heard(b: pa.RecordBatch, name: str, i: int, kind: type) -> np.ndarray:
    """All answers that a block got in a round, in the order of its keys."""
    parts = sorted((x["bucket"], x["load"]) for x in b.column(name)[i].as_py() or [])
    return np.concatenate([np.frombuffer(x, kind) for _, x in parts]) if parts else np.zeros(0, kind)


@dataclass(frozen=True)
class Work:
    """Symbols of a window, whether they are words, and into how many buckets and partitions the data go."""

    length: int
    words: bool
    buckets: int
    parts: int

    def joined(self, blocks: DataFrame, answers: DataFrame, how: str = "inner") -> DataFrame:
        return blocks.repartition(self.parts, "block").join(answers.repartition(self.parts, "block"), "block", how)


def asked(blocks: DataFrame, ask: Ask, make: Make, work: Work, name: str) -> DataFrame:
    """(block, name): a round's answers. make(block) gives the keys and their documents."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, block in read_blocks(b, work.length, work.words):
                keys, doc = make(block)
                if not len(keys.first):
                    continue
                columns = ask.load(keys, doc)
                to, cut = keys.cuts(work.buckets)
                yield _batch([(int(t), block.block, _pack([c[x:y] for c in columns])) for t, x, y in zip(to, cut[:-1], cut[1:], strict=True)], [("bucket", pa.int64()), ("block", pa.int64()), ("load", pa.binary())])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        keep_memory()
        parts = [_unpack(x, ask.kinds) for x in group["load"]]
        sizes = np.cumsum([len(p[0]) for p in parts])[:-1]
        answer = ask.answer(int(group["bucket"].iloc[0]), [np.concatenate(c) for c in zip(*parts, strict=True)])
        return pd.DataFrame({"bucket": group["bucket"], "block": group["block"], "load": [x.tobytes() for x in np.split(answer, sizes)]})

    sent = blocks.mapInArrow(send, "bucket long, block long, load binary").repartition(work.buckets, "bucket")
    met = sent.groupBy("bucket").applyInPandas(meet, "bucket long, block long, load binary")
    return materialize(met.repartition(work.parts, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "load")).alias("answers")), name)


def moved(blocks: DataFrame, take: Callable[..., tuple], ask: Ask, work: Work, gone: bool, name: str) -> DataFrame:
    """The next table of blocks: take(block, answers) gives a block and, with gone, spans that go. Blocks with nothing are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, block in read_blocks(b, work.length, work.words):
                now, *spans = take(block, heard(b, "answers", i, ask.told))
                if now.alive.any() or gone and len(spans[0]):
                    yield _batch([(*now.row(), *spans)], _ROW + _GONE * gone)

    return materialize(blocks.mapInArrow(run, SCHEMA + f", {GONE}" * gone), name)


def to_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text) as blocks of whole documents, of about block_bytes or one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for b in batches:
            data, offs = batch_text(b)
            ids = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in pieces(offs, block_bytes):
                at = np.arange(hi - lo, dtype=np.int32)
                yield _batch([(n, data[offs[lo] : offs[hi]].tobytes(), np.diff(offs[lo : hi + 1]).astype(np.int32), None, ids[lo:hi], at, np.zeros(hi - lo, np.int32), None, None)], _ROW)
                n += 1

    return docs.mapInArrow(run, SCHEMA)


def least_hashes(block: Block, short: int, size: int, length: int, piece: int = 32_768) -> np.ndarray:
    """The least hash among the strings of `size` symbols in each window: Fingerprints.level (lane 0), the least by
    sliding_min, in pieces of so many windows, whose arrays stay in a core's cache."""
    out = np.empty(max(0, len(block.alive) - length + size), np.uint64)
    for lo in range(0, len(out), piece):
        hi = min(lo + piece, len(out))
        a, b = block.grams(short, lo, hi + length - short)
        h = stirred(b * _K[1], a * _K[0])
        if size > short:
            h = paired(h, short)
        out[lo:hi] = sliding_min(h[: hi - lo + length - size], length - size + 1)
    return out


def sieve_keys(block: Block, short: int, size: int, length: int) -> tuple[Keys, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, documents, first windows and numbers of windows of the runs whose windows have one least hash
    among the strings of `size` bytes inside; size is short or twice short."""
    least = least_hashes(block, short, size, length)
    at, n = runs(block, least)
    return Keys(least[at]), block.docs(at), at, n


def runs(block: Block, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of neighbouring windows with one value."""
    m = len(value)
    alive = block.alive[:m]
    fresh = alive.copy()
    opens = np.zeros(len(block.alive) + 1, bool)
    opens[block.offs] = True
    if m:
        fresh[1:] &= ~alive[:-1] | (value[1:] != value[:-1]) | opens[1:m]
    first = np.flatnonzero(fresh)
    before = np.cumsum(alive, dtype=np.int32)
    return first, np.diff(np.append(before[first] - 1, before[-1] if m else 0)).astype(np.int64)


def windows_of(block: Block, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mask of the windows of some runs."""
    step = np.zeros(len(block.alive) + 1, np.int32)
    step[at] += 1
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1], dtype=np.int32) > 0


def repeated_windows(first: DataFrame, work: Work) -> list[DataFrame]:
    """(block, gone_home, gone_place, gone_n): the windows that a document with a smaller doc_id holds too, as
    tables of the shared folder. first: the table of to_blocks()."""
    length = work.length
    short = min(16, max(1, length // 3))
    double = min(2 * short, length)

    def sieve(blocks: DataFrame, size: int) -> DataFrame:
        """Windows whose sampled string of `size` symbols several documents hold."""

        def take(block: Block, yes: np.ndarray) -> tuple:
            keys, _, at, n = sieve_keys(block, short, size, length)
            hit = keys.items(yes).astype(bool)
            return (block.cut(windows_of(block, at[hit], n[hit]), length),)

        answers = asked(blocks, Ask("sieve"), lambda block: sieve_keys(block, short, size, length)[:2], work, f"sieve{size}")
        out = moved(work.joined(blocks, answers), take, Ask("sieve"), work, False, f"blocks{size}")
        discard(answers)
        return out

    def whole(block: Block) -> tuple[Keys, np.ndarray, np.ndarray, np.ndarray]:
        """Keys of all the symbols of the runs, documents, first windows, numbers of windows."""
        prints = Fingerprints(block, short)
        at, n = runs(block, least_hashes(block, short, short, length))
        return Keys(*prints.of(at, n + length - 1, length)), block.docs(at), at, n

    def settle(blocks: DataFrame) -> DataFrame:
        def take(block: Block, low: np.ndarray) -> tuple:
            keys, doc, at, n = whole(block)
            done = keys.items(low) < doc
            return block.cut(windows_of(block, at[~done], n[~done]), length), *block.spans(at[done], n[done])

        answers = asked(blocks, Ask("low"), lambda block: whole(block)[:2], work, "low")
        out = moved(work.joined(blocks, answers), take, Ask("low"), work, True, "settled")
        discard(answers)
        return out

    def pairs(block: Block, size: int, to: int) -> tuple[Keys, np.ndarray, np.ndarray]:
        """Keys of the strings of `to` symbols that alive windows need: themselves (size 0), or the ranks of two
        strings of `size` symbols."""
        at = np.flatnonzero(spread(block.alive, length - to + 1))
        if size == 0:
            a, b = block.grams(to)
            return Keys(a[at], b[at]), block.docs(at), at
        rank = np.zeros(len(block.alive), np.uint64)
        rank[spread(block.alive, length - size + 1)] = block.rank
        return Keys(rank[at], rank[at + to - size]), block.docs(at), at

    def doubled(blocks: DataFrame, size: int, to: int) -> DataFrame:
        """Ranks at `to` symbols; at the window's length, the spans that go."""
        ask = Ask("low" if to == length else "rank")

        def take(block: Block, answer: np.ndarray) -> tuple:
            keys, doc, at = pairs(block, size, to)
            own = keys.items(answer)
            if to == length:
                hit = at[own < doc]
                return block.bare(np.zeros(0, bool), block.rank[:0]), *block.spans(hit, np.ones(len(hit), np.int64))
            alone = np.zeros(len(block.alive) + 1, np.int64)
            alone[at[own == 0] + 1] = 1
            alone = np.cumsum(alone)
            s = np.flatnonzero(block.alive)
            alive = np.zeros(len(block.alive), bool)
            alive[s[alone[s + length - to + 1] == alone[s]]] = True
            rank = np.zeros(len(block.alive), np.uint64)
            rank[at] = own
            return (block.bare(alive, rank[spread(alive, length - to + 1)]),)

        answers = asked(blocks, ask, lambda block: pairs(block, size, to)[:2], work, f"ranks{to}")
        out = moved(work.joined(blocks, answers), take, ask, work, to == length, f"ranked{to}")
        discard(answers)
        return out

    now = sieve(first, short)
    settled = settle(now)
    discard(now)
    now = sieve(settled.drop("gone_home", "gone_place", "gone_n"), double)
    size, to = 0, short
    while True:
        was, now = now, doubled(now, size, to)
        discard(was)
        if to == length:
            break
        size, to = to, min(2 * to, length)
    return [t.select("block", "gone_home", "gone_place", "gone_n") for t in (settled, now)]


def gone_by_block(docs: DataFrame, length: int, words: bool, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text; no null ids) as blocks, with gone: an array of (gone_home, gone_place, gone_n)."""
    blocks = materialize(to_blocks(docs, block_bytes), "blocks", "zstd")
    total = blocks.agg(F.sum(F.expr("aggregate(size, 0L, (a, n) -> a + n)"))).first()[0] or 0
    work = Work(length, words, 1 + total // BUCKET_BYTES, 1 + total // (WORD_PART_BYTES if words else PART_BYTES))
    first, last = repeated_windows(blocks, work)
    gone = first.unionByName(last).repartition(work.parts, "block").groupBy("block").agg(F.collect_list(F.struct("gone_home", "gone_place", "gone_n")).alias("gone"))
    return work.joined(blocks, gone, "left")
