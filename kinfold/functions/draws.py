"""Random variates as expressions over hashes: the same in any partitioning, after any retry, in any engine."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Hashable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: 2**52; uniforms are odd multiples of half its inverse, strictly inside (0, 1).
SCALE = float(1 << 52)
CDF_BUCKETS = 1024
#: A running sum's window holds so many consecutive values at most; a group's windows are tied by their sums.
RUN = 1 << 16


def uniform(seed: int, iteration: int, op: str, *keys: Column | str) -> Column:
    """A uniform in (0, 1) from md5("seed|iteration|op|key|…")."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(str(iteration)), F.lit(op), *[c.cast("string") for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(SCALE)


def gumbel_score(log_weight: Column, u: Column) -> Column:
    """The row of largest score is a draw in proportion to exp(log_weight)."""
    return log_weight - F.log(-F.log(u))


def categorical(weights: DataFrame, group: list[str], value: str, log_weight: str, u: Column) -> DataFrame:
    """One value of each group in proportion to exp(log_weight): (group…, value). Rows of weight 0 must be gone."""
    pick = F.max_by(value, F.struct(gumbel_score(F.col(log_weight), u), F.col(value)))
    return weights.groupBy(*group).agg(pick.alias(value))


def checked_weights(dist: DataFrame, weight: str = "weight") -> DataFrame:
    """Fails, when run, on negative, NaN or infinite weights and nulls."""
    w = F.col(weight)
    bad = w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf"))
    return dist.withColumn(weight, F.when(bad, F.raise_error(F.lit("weights must be finite and not negative")).cast("double")).otherwise(w))


def probabilities(dist: DataFrame, group: list[str], weight: str = "weight") -> DataFrame:
    """A distribution table with its column prob; a group of total 0 fails."""
    total = F.sum(weight).over(Window.partitionBy(*group))
    bad = F.raise_error(F.lit("a distribution needs a positive weight")).cast("double")
    return checked_weights(dist, weight).withColumn("prob", F.when(total > 0, F.col(weight) / total).otherwise(bad))


def running(rows: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    """Adds upto (sum of weight up to the row, in the order of value), total and last (largest value) of the row's group.

    value: an integer, once a group. A group of any size is spread over windows of RUN values each.
    """
    # the one exchange of rows serves the sums, the windows and the join
    own = rows.withColumn("_run", F.floor(F.col(value) / RUN)).repartition(*group, "_run")
    sums = own.groupBy(*group, "_run").agg(F.sum(weight).alias("_sum"), F.max(value).alias("_most"))
    by = Window.partitionBy(*group)  # a row a window
    before = F.coalesce(F.sum("_sum").over(by.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = sums.select(*group, "_run", before.alias("_before"), F.sum("_sum").over(by).alias("total"), F.max("_most").over(by).alias("last"))
    inside = F.sum(weight).over(Window.partitionBy(*group, "_run").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("_inside", inside).join(ends, [*group, "_run"]).withColumn("upto", F.col("_before") + F.col("_inside")).drop("_run", "_before", "_inside")


def cumulative(dist: DataFrame, group: list[str], value: str, prob: str) -> DataFrame:
    """Adds lo and hi, the ends of each value's part of [0, 1) in the order of values, and the buckets it meets.

    value: an integer. One row for each of the CDF_BUCKETS equal parts of [0, 1) that the value's part meets, so that a
    draw is an equality join on the bucket and a test of two bounds.
    """
    out = running(dist.where(F.col(prob) > 0), group, value, prob).withColumnRenamed("upto", "hi").withColumn("lo", F.col("hi") - F.col(prob))
    out = out.withColumn("hi", F.when(F.col(value) == F.col("last"), F.lit(1.0)).otherwise(F.col("hi"))).drop("total", "last")
    bucket = lambda c: F.least(F.lit(CDF_BUCKETS - 1), F.greatest(F.lit(0), F.floor(c * CDF_BUCKETS).cast("int")))
    return out.withColumn("bucket", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.greatest("lo", "hi")))))


def draw_from(keys: DataFrame, u: Column, cdf: DataFrame, group: list[str], value: str) -> DataFrame:
    """keys with a value drawn for each row from the cumulative() table of its group."""
    bucket = F.least(F.lit(CDF_BUCKETS - 1), F.floor(F.col("_u") * CDF_BUCKETS).cast("int"))
    rows = keys.withColumn("_u", u).withColumn("bucket", bucket)
    table = cdf.select(*group, "bucket", F.col(value).alias("_value"), "lo", "hi")
    met = rows.join(table, [*group, "bucket"], "left").where(F.col("_value").isNull() | ((F.col("_u") >= F.col("lo")) & (F.col("_u") < F.col("hi"))))
    return met.drop("_u", "bucket", "lo", "hi").withColumnRenamed("_value", value)


def bernoulli(p: Column, u: Column) -> Column:
    return u < p


@dataclass(frozen=True)
class Distribution:
    """A distribution over listed values held by the driver; larger ones are tables, see cumulative()."""

    weights: dict[Hashable, float]
    upto: list[float] = field(repr=False)

    @staticmethod
    def of(weights: Mapping[Hashable, float] | Sequence[float]) -> Distribution:
        """Weights by value, or of the values 0, 1, …; finite, not negative, and one of them positive."""
        own = {k: float(w) for k, w in (weights.items() if isinstance(weights, Mapping) else enumerate(weights))}
        if any(not math.isfinite(w) or w < 0 for w in own.values()):
            raise ValueError("weights must be finite and not negative")
        upto = list(accumulate(own.values()))
        if not upto or upto[-1] <= 0:
            raise ValueError("a distribution needs a positive weight")
        return Distribution(own, upto)

    @property
    def values(self) -> list:
        return list(self.weights)

    @property
    def num_values(self) -> int:
        return len(self.weights)

    @property
    def total_weight(self) -> float:
        return self.upto[-1]

    def probability(self, value: Hashable) -> float:
        """0 for what isn't among the values."""
        return self.weights.get(value, 0.0) / self.total_weight

    def __iter__(self) -> Iterator[tuple[Hashable, float]]:
        return ((v, w / self.total_weight) for v, w in self.weights.items())

    def sample(self, u: float) -> Hashable:
        """The value at u, a uniform in [0, 1), in the order of values; never one of weight 0."""
        at = bisect_right(self.upto, u * self.total_weight)
        if at == len(self.upto):  # u * total_weight was rounded up to the end
            at = max(k for k, w in enumerate(self.weights.values()) if w > 0)
        return self.values[at]
