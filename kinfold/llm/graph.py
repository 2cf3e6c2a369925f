"""Connected components of link tables, in the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize

#: Links for which a salt more is taken.
SALT_ROWS = 1_000_000
#: Links that a task replaces by stars at a time.
LOCAL_ROWS = 2_000_000


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def with_least(links: DataFrame, salts: int) -> DataFrame:
    """(a, b, m): links with the smallest b of their a. The links of a hub are dealt by salt; only its minima
    for each salt, `salts` rows at most, meet in one place."""
    dealt = links.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    part = dealt.groupBy("a", "salt").agg(F.min("b").alias("m"))
    low = part.groupBy("a").agg(F.min("m").alias("m"))
    return dealt.join(part.select("a", "salt").join(low, "a"), ["a", "salt"]).drop("salt")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of each node but the smallest of its component with that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, least = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        x, y = least[a], least[b]
        if (x == y).all():
            break
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least[least] != least).any():
            least = least[least]
    rest = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[rest], nodes[least[rest]]


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) with the same components: stars of what a task holds, LOCAL_ROWS at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate([np.asarray(x.column(c)) for x in held]) for c in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(a, b)], names=["a", "b"])

        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= LOCAL_ROWS:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component_id): the smallest id that links (a, b) reach, for each id that has a link.

    Alternates two steps until the links stay the same: every node's larger neighbours are linked to its
    smallest one; every node's smaller neighbours likewise. A star with its smallest node is left of each
    component. Links of a node with itself and nulls are ignored. Tasks first replace what they hold by
    stars, which leaves fewer steps.
    """
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = materialize(contracted(now), "links")
    seen = _state(now)
    while seen[0]:
        salts = 16 + seen[0] // SALT_ROWS
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, as the next step reads it three times
        large = materialize(with_least(both, salts).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")), "large")
        small = with_least(large, salts)
        # both links of a row at once: a union would take the joins above twice
        ends = small.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b")
        was, old = seen, now
        now = materialize(ends.distinct(), "links")
        discard(old, large)
        seen = _state(now)
        if was == seen:
            break
    tail = now.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return tail.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
