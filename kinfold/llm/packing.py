"""Packing token sequences by minimum bin slack over the histogram of piece lengths."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import materialize

CAPACITY = 2048
END_ID = 1
CACHE_WORDS = 250_000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of a word-level BPE file of the tokenizers library, by white-space separated chunk.

    The tokenizer lower-cases, drops white space and merges inside words, so a chunk's ids depend on the
    chunk alone; they are kept in a bounded cache. Chunks of plain Latin letters that miss the cache are
    merged by tiktoken's engine over the same merges; all others go to the tokenizer itself.
    """

    def __init__(self, path: str, cache: int = CACHE_WORDS):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        model = json.loads(self.whole.to_str())["model"]
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = [*map(chr, letters), *(chr(256 + k) for k in range(256 - len(letters)))]
        code = dict(zip(chars, [*letters, *sorted(set(range(256)) - set(letters))], strict=True))
        ranks = {}
        for token, i in model["vocab"].items():
            end = token.endswith(model["end_of_word_suffix"])
            body = token[: -len(model["end_of_word_suffix"])] if end else token
            if all(c in code for c in body) and not (token.startswith("<|") and i >= 49406):
                ranks[bytes(code[c] for c in body) + b"\xff" * end] = i
        ranks[b"\xff"] = max(ranks.values()) + 1  # no UTF-8 text holds this byte: it marks a word's end
        engine = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})
        self.merge = engine._core_bpe.encode_single_piece
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.cache: dict[str, bytes] = {}
        self.most = cache

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() or max(chunk) < "ɐ":
            ids = [i for w in self.words(chunk.lower()) for i in self.merge(w.encode() + b"\xff")]
        else:
            ids = self.whole.encode(chunk, add_special_tokens=False).ids
        out = np.array(ids, "<u4").tobytes()
        if len(self.cache) < self.most:
            self.cache[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if not text.isascii() or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split, not to the tokenizer
                return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        get, make = self.cache.get, self._chunk
        return b"".join([get(c) or make(c) for c in text.split()])


_encoders: dict[str, WordEncoder] = {}


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most `capacity` ids of each row of docs, the end id included.

    A null or empty text is the end id alone. Repeated doc_ids are told apart by the column copy, a
    digest-free running number within the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = enc.encode(text.as_py() or "") + end
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    part = ids[4 * s : 4 * (s + capacity)]
                    rows.append((doc, s, len(part) // 4, zlib.crc32(part), n))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def _padding(total: int, capacity: int) -> int:
    return 0 if total & (total - 1) == 0 else capacity - total


def fill_window(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of the longest length left and others whose sum leaves the least slack.

    Bit s of a bitset says that sum s can be reached. Lengths join by falling size, each as often as it
    is left (counts doubled, as in a bounded knapsack); the bitset before each group is kept, so that the
    chosen sum is traced back to counts. Joining stops once the capacity is reached.
    """
    order = sorted(counts, reverse=True)
    seed = order[0]
    room = capacity - seed
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for size in order:
        left = counts[size] - (size == seed)
        left = min(left, room // size) if size <= room else 0
        group = 1
        while left > 0:
            take = min(group, left)
            steps.append((size, take, reach))
            reach |= (reach << (size * take)) & full
            left -= take
            group *= 2
        if reach >> room & 1:
            break
    best = min((s for s in range(room + 1) if reach >> s & 1), key=lambda s: (_padding(seed + s, capacity), -s)) if not reach >> room & 1 else room
    out = {seed: 1}
    for size, take, before in reversed(steps):
        if not before >> best & 1:
            best -= size * take
            out[size] = out.get(size, 0) + take
    return out


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(multiset, how many sequences are filled so) until no length is left.

    A multiset is repeated as long as its lengths last, so the plan's size depends on the number of
    distinct lengths (at most the capacity), not on that of pieces.
    """
    left = {k: v for k, v in histogram.items() if v}
    out = []
    while left:
        one = fill_window(left, capacity)
        times = min(left[k] // v for k, v in one.items())
        out.append((one, times))
        for k, v in one.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
    return out


def plan_table(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first ordinal, pieces a sequence, first sequence, first offset), by ordinal."""
    used: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for one, times in patterns:
        offset = 0
        for size in sorted(one, reverse=True):
            rows.setdefault(size, []).append((used.get(size, 0), one[size], sequence, offset))
            used[size] = used.get(size, 0) + one[size] * times
            offset += size * one[size]
        sequence += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, share: int = 50_000) -> DataFrame:
    """Packs every document into sequences of at most `capacity` tokens.

    Documents are cut at multiples of the capacity; full pieces fill sequences of their own, and what
    remains is packed by minimum bin slack. The driver sees the histogram of lengths only (at most
    `capacity` rows). A piece's place among those of its length is a running number within (length,
    salt), `share` rows each or so, plus the sizes of the salts before; the plan turns it into a sequence
    and an offset. Rows that repeat a doc_id are packed each; null texts count as empty.
    """
    made = materialize(token_pieces(docs, path or vocabulary_path(), capacity, end_id), "pieces")
    sizes = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}
    total = sum(sizes.values())
    salts = max(1, -(-total // share))
    plan = plan_table(plan_patterns(sizes, capacity))
    spread = made.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    per = spread.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = per.select("length", "salt", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    placed = spread.withColumn("inside", inside).join(first, ["length", "salt"]).withColumn("ordinal", (F.col("before") + F.col("inside")).cast("long")).drop("inside", "before", "salt")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seq, off = np.empty(len(f), np.int64), np.empty(len(f), np.int64)
            lengths, ordinals = f["length"].to_numpy(), f["ordinal"].to_numpy()
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                at = order[a:b]
                size = lengths[at[0]]
                table = plan[int(size)]
                row = table[np.searchsorted(table[:, 0], ordinals[at], "right") - 1]
                k = ordinals[at] - row[:, 0]
                seq[at] = row[:, 2] + k // row[:, 1]
                off[at] = row[:, 3] + k % row[:, 1] * size
            yield f.drop(columns="ordinal").assign(sequence_id=seq, offset=off)

    return placed.mapInPandas(run, "length long, doc_id long, start long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
