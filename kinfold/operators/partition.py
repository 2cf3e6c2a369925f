"""Blocking of entities: k-d tree over attribute values, LPT scheduling, simple blocking by one attribute.

A fitted partitioner is a Column expression over value ids, so it runs inside any projection.
"""

from __future__ import annotations

import heapq
import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.draws import running

log = logging.getLogger("kinfold.partition")
#: Splits of this quality or less are logged as warnings.
POOR_SPLIT = 0.9
#: Nodes with at most so many distinct values are split greedily by weight, others at the weighted median.
SMALL_DOMAIN = 30


class PartitionFunction(Protocol):
    """What the sampler asks of a partitioner. fitted() is what fit() found, as JSON can hold it; restore() takes it back."""

    @property
    def count(self) -> int: ...

    def fit(self, wide: DataFrame, values: str = "values") -> PartitionFunction: ...

    def column(self, values: str | Column = "values") -> Column: ...

    def fitted(self) -> object: ...

    def restore(self, said: object) -> PartitionFunction: ...


def lpt_split(weights: list[tuple[int, float]]) -> tuple[set[int], float]:
    """Values that go right, and the split's quality, of a greedy two-way split by falling weight.

    Each value goes to the lighter side, to the right one on a tie; unseen values go left.
    """
    left = right = 0.0
    chosen = set()
    for value, w in sorted(weights, key=lambda x: (-x[1], x[0])):
        if left < right:
            left += w
        else:
            right += w
            chosen.add(value)
    return chosen, 1 - abs(left - right) / (left + right) if left + right else 1.0


def median_split(counts: DataFrame, keys: list[str], value: str = "value_id", weight: str = "w") -> DataFrame:
    """(keys…, split, below, total): the first value at which the running weight passes half; right means above it."""
    run = running(counts, keys, value, weight)
    return run.where(F.col("upto") * 2 >= F.col("total")).groupBy(*keys).agg(F.min(value).alias("split"), F.min("upto").alias("below"), F.first("total").alias("total"))


def lpt_schedule(jobs: list[tuple[object, float]], bins: int) -> dict[object, int]:
    """Longest processing time first: each job goes to the least loaded bin, the first of equals."""
    if bins < 1:
        raise ValueError("bins must be positive")
    heap = [(0.0, k) for k in range(bins)]
    out = {}
    for job, size in sorted(jobs, key=lambda x: (-x[1], str(x[0]))):
        load, k = heapq.heappop(heap)
        out[job] = k
        heapq.heappush(heap, (load + size, k))
    return out


class LPTSchedule:
    """lpt_schedule() with its bins' jobs and sizes."""

    def __init__(self, jobs: list[tuple[object, float]], bins: int) -> None:
        self.of_job = lpt_schedule(jobs, bins)
        self.jobs: list[list] = [[] for _ in range(bins)]
        self.sizes = [0.0] * bins
        for job, size in jobs:
            self.jobs[self.of_job[job]].append(job)
            self.sizes[self.of_job[job]] += size


@dataclass
class Node:
    """A leaf, or a test of one attribute: values of the list go right, or (without one) values above a bound."""

    attr_id: int | None = None
    rights: list[int] | None = None
    above: int | None = None
    left: Node | None = None
    right: Node | None = None
    leaf: int = 0

    def column(self, value: Callable[[int], Column]) -> Column:
        if self.attr_id is None:
            return F.lit(self.leaf)
        own = value(self.attr_id)
        test = own.isin(*self.rights) if self.rights is not None else own > self.above
        return F.when(test, self.right.column(value)).otherwise(self.left.column(value))

    def said(self) -> object:
        return self.leaf if self.attr_id is None else [self.attr_id, self.rights, self.above, self.left.said(), self.right.said()]

    @staticmethod
    def of(said: object) -> Node:
        if isinstance(said, int):
            return Node(leaf=said)
        attr, rights, above, left, right = said
        return Node(attr, rights, above, Node.of(left), Node.of(right))


@dataclass
class KDTreePartitioner:
    """Splits every populated leaf once a level, cycling through the attributes.

    fit() runs one aggregation a level: (leaf, value) weights, which are bounded by leaves times the
    attribute's domain; medians are found in the cluster, and only domains of SMALL_DOMAIN values or fewer
    come to the driver. A split keeps the left leaf's number and gives the right one the next. Leaves
    that hold a single value aren't split further at that level.
    """

    levels: int
    attributes: list[int]
    root: Node = field(default_factory=Node)
    count: int = 1
    qualities: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.levels < 0:
            raise ValueError("levels must not be negative")
        if self.levels and not self.attributes:
            raise ValueError("a tree with levels needs attributes")

    def fit(self, wide: DataFrame, values: str = "values") -> KDTreePartitioner:
        """wide: one row a record or entity, with an array of value ids."""
        self.root, self.count, leaves = Node(), 1, {}
        leaves[0] = self.root
        for level in range(self.levels):
            attr = self.attributes[level % len(self.attributes)]
            counts = wide.select(self.column(values).alias("leaf"), F.element_at(values, attr + 1).alias("value_id")).where(F.col("value_id").isNotNull())
            counts = counts.groupBy("leaf", "value_id").agg(F.count(F.lit(1)).alias("w"))
            sizes = {r["leaf"]: r["n"] for r in counts.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
            small = [k for k, n in sizes.items() if 1 < n <= SMALL_DOMAIN]
            rights: dict[int, tuple[list[int] | None, int | None, float]] = {}
            lists: dict[int, list] = {}
            for r in counts.where(F.col("leaf").isin(small)).collect() if small else []:
                lists.setdefault(r["leaf"], []).append((r["value_id"], float(r["w"])))
            for k, own in lists.items():
                right, quality = lpt_split(own)
                rights[k] = sorted(right), None, quality
            large = [k for k, n in sizes.items() if n > SMALL_DOMAIN]
            for r in median_split(counts.where(F.col("leaf").isin(large)), ["leaf"]).collect() if large else []:
                rights[r["leaf"]] = None, r["split"], 1 - abs(2 * r["below"] - r["total"]) / r["total"]
            for k in sorted(rights):
                node = leaves[k]
                node.attr_id, (node.rights, node.above, quality) = attr, rights[k]
                self.qualities.append(quality)
                if quality <= POOR_SPLIT:
                    log.warning("poor split of quality %.3f: level %d, attribute %d, leaf %d", quality, level, attr, k)
                node.left, node.right = Node(leaf=k), Node(leaf=self.count)
                leaves[k], leaves[self.count] = node.left, node.right
                self.count += 1
        return self

    def fitted(self) -> object:
        return {"count": self.count, "root": self.root.said()}

    def restore(self, said: object) -> KDTreePartitioner:
        self.count, self.root = said["count"], Node.of(said["root"])
        return self

    def column(self, values: str | Column = "values") -> Column:
        array = F.col(values) if isinstance(values, str) else values
        return self.root.column(lambda a: F.element_at(array, a + 1))


@dataclass
class SimplePartitioner:
    """Blocks by one attribute's values, dealt to partitions by LPT; unseen values go to partition 0."""

    attribute: int
    partitions: int
    of_value: dict[int, int] = field(default_factory=dict)

    def fit(self, wide: DataFrame, values: str = "values", most: int = 100_000) -> SimplePartitioner:
        rows = wide.groupBy(F.element_at(values, self.attribute + 1).alias("v")).count().where("v is not null").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"the attribute has more than {most} values")
        self.of_value = lpt_schedule([(r["v"], float(r["count"])) for r in rows], self.partitions)
        return self

    @property
    def count(self) -> int:
        return self.partitions

    def fitted(self) -> object:
        return sorted(self.of_value.items())

    def restore(self, said: object) -> SimplePartitioner:
        self.of_value = dict(map(tuple, said))
        return self

    def column(self, values: str | Column = "values") -> Column:
        array = F.col(values) if isinstance(values, str) else values
        table = F.create_map(*[F.lit(x) for kv in sorted(self.of_value.items()) for x in kv]) if self.of_value else None
        found = F.element_at(table, F.element_at(array, self.attribute + 1)) if table is not None else F.lit(0)
        return F.coalesce(found, F.lit(0)).cast("int")


def hard_partition(key: Column, n: int) -> Column:
    return F.pmod(key, F.lit(n))
