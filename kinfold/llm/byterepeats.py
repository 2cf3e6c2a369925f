"""Substring dedup over bytes by distributed prefix doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .doubling import BLOCK_BYTES, gone_by_block, read_blocks

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def strip_bytes(blocks: DataFrame, length: int) -> DataFrame:
    """One row a document of the blocks; gone: an array of (home, place, n), n neighbouring windows from a place on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, block in read_blocks(b, length, False):
                offs = block.offs
                step = np.zeros(len(block.data) + 1, np.int32)
                for span in b.column("gone")[i].as_py() or []:
                    home, place, n = (np.array(span[c], np.int64) for c in ("gone_home", "gone_place", "gone_n"))
                    np.add.at(step, offs[home] + place, 1)
                    np.add.at(step, offs[home] + place + n + length - 1, -1)
                gone = np.cumsum(step[:-1]) > 0
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                starts = offs[:-1][block.size > 0]
                opens[starts] = gone[starts]
                before, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, opens))
                kept, at = block.data[~gone].tobytes(), offs - before[offs]
                digests = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                columns = [block.doc, block.size.astype(np.int64), np.diff(before[offs]), np.diff(spans[offs])]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return blocks.mapInArrow(run, OUT)


def remove_repeated_bytes(docs: DataFrame, length: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: each byte goes that a string of `length` bytes covers
    which also starts in a document with a smaller doc_id.

    Null texts are empty. Rows with a null doc_id lose nothing and cause nothing; rows that repeat a doc_id
    are one document for the comparison, and each gets an answer of its own.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    blocks = gone_by_block(docs.where(F.col("doc_id").isNotNull()), length, False, block_bytes)
    out = strip_bytes(blocks, length)
    nameless = docs.where(F.col("doc_id").isNull()).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return out.unionByName(nameless)
