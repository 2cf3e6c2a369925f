"""Substring dedup over words by level-wise doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .doubling import BLOCK_BYTES, gone_by_block, read_blocks
from .textgrid import Grid, batch_text, pieces

NAMES = ["doc_id", "n_words", "n_removed", "kept_sha256"]
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def strip_words(grid: Grid, keep: np.ndarray) -> tuple[list[int], list[int], list[str]]:
    """Words, removed words and the digest of the kept words of each document."""
    raw, n, gone, digests = grid.data.tobytes(), [], [], []
    for a, e in zip(grid.first[:-1], grid.first[1:], strict=True):
        own = keep[a:e]
        if own.all():
            words = raw[grid.start[a] : grid.end[e - 1]].split() if e > a else []
        else:
            words = [raw[s:t] for s, t in zip(grid.start[a:e][own].tolist(), grid.end[a:e][own].tolist(), strict=True)]
        n.append(int(e - a))
        gone.append(int(e - a - own.sum()))
        digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return n, gone, digests


def strip_blocks(blocks: DataFrame, length: int) -> DataFrame:
    """One row a document of the blocks; gone: an array of (home, place, n), n neighbouring windows from a place on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, block in read_blocks(b, length, True, lanes=0):
                grid = block.words or Grid(block.data, np.zeros(len(block.size) + 1, np.int64))
                step = np.zeros(len(grid.start) + 1, np.int32)
                for span in b.column("gone")[i].as_py() or []:
                    home, place, n = (np.array(span[c], np.int64) for c in ("gone_home", "gone_place", "gone_n"))
                    np.add.at(step, grid.first[home] + place, 1)
                    np.add.at(step, grid.first[home] + place + n + length - 1, -1)
                n, gone, digests = strip_words(grid, np.cumsum(step[:-1]) == 0)
                yield pa.RecordBatch.from_arrays([pa.array(block.doc), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], names=NAMES)

    return blocks.mapInArrow(run, OUT)


def whole_texts(docs: DataFrame) -> DataFrame:
    """The same for rows that lose nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = batch_text(b)
            cols: list[list] = [[], [], []]
            for lo, hi in pieces(offs):
                grid = Grid(data, offs[lo : hi + 1])
                for c, v in zip(cols, strip_words(grid, np.ones(len(grid.start), bool)), strict=True):
                    c += v
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=NAMES)

    return docs.mapInArrow(run, OUT)


def remove_repeated_words(docs: DataFrame, length: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: each word goes that a window of `length` words covers
    whose words also start in a document with a smaller doc_id.

    Windows are looked at in levels: at a third of the length, sampled; at twice that, those left; and so on
    up to the length, or until no candidate is left (see doubling). Words are told apart by 128 bits.

    Null texts have no words. Rows with a null doc_id lose nothing and cause nothing; rows that repeat a
    doc_id are one document for the comparison, and each gets an answer of its own.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    blocks = gone_by_block(docs.where(F.col("doc_id").isNotNull()), length, True, block_bytes)
    return strip_blocks(blocks, length).unionByName(whole_texts(docs.where(F.col("doc_id").isNull())))
