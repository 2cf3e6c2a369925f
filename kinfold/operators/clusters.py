"""Clusterings and their evaluation: memberships, pairs, contingency, precision and recall, Rand index, baselines."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_clusters(members: DataFrame, rec_id: str = "rec_id", label: str = "cluster_id") -> DataFrame:
    """(cluster): the sorted distinct records of each label."""
    return members.groupBy(label).agg(F.array_sort(F.collect_set(rec_id)).alias("cluster")).select("cluster")


def to_membership(clusters: DataFrame) -> DataFrame:
    """(rec_id, cluster_id): a cluster is named by its smallest record, so overlapping clusters may share a name."""
    return clusters.where(F.size("cluster") > 0).select(F.explode("cluster").alias("rec_id"), F.array_min("cluster").alias("cluster_id"))


def pairs_of(members: DataFrame, rec_id: str = "rec_id", label: str = "cluster_id") -> DataFrame:
    """(a, b) with a < b: all pairs of records that share a label, each once."""
    left = members.select(F.col(label).alias("c"), F.col(rec_id).alias("a"))
    right = members.select(F.col(label).alias("c"), F.col(rec_id).alias("b"))
    return left.join(right, "c").where("a < b").select("a", "b").distinct()


def canonical_pairs(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct pairs with the smaller record first; a record paired with itself fails."""
    bad = F.raise_error(F.concat(F.lit("record linked with itself: "), F.col(a).cast("string"))).cast("string")
    return pairs.select(F.when(F.col(a) == F.col(b), bad).otherwise(F.least(a, b)).alias("a"), F.greatest(a, b).alias("b")).distinct()


def flagged_pairs(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """(a, b, is_pred, is_true) of all pairs that either side has."""
    p, t = predicted.select("a", "b", F.lit(True).alias("p")), true.select("a", "b", F.lit(True).alias("t"))
    return p.join(t, ["a", "b"], "full_outer").select("a", "b", F.coalesce("p", F.lit(False)).alias("is_pred"), F.coalesce("t", F.lit(False)).alias("is_true"))


def confusion(flagged: DataFrame) -> DataFrame:
    """One row: tp, fp, fn."""
    p, t = F.col("is_pred"), F.col("is_true")
    return flagged.agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))


def precision() -> Column:
    return F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))


def recall() -> Column:
    return F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))


def f_measure(beta: float = 1.0) -> Column:
    b = F.lit(float(beta) ** 2)
    return F.try_divide((1 + b) * F.col("tp"), (1 + b) * F.col("tp") + b * F.col("fn") + F.col("fp"))


def pairwise_metrics(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 of pair tables; a measure without cases is null."""
    return confusion(flagged_pairs(predicted, true)).select("tp", "fp", "fn", precision().alias("precision"), recall().alias("recall"), f_measure().alias("f1"))


def membership_metrics(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """pairwise_metrics() of two memberships (rec_id, cluster_id), without making their pairs.

    Pairs are counted from the sizes of clusters and of their intersections; records that one side lacks count
    with the other. Where clusters of a side overlap, pairs are shared, and they are made and compared.
    """
    p, t = predicted.select("rec_id", F.col("cluster_id").alias("p")).distinct(), true.select("rec_id", F.col("cluster_id").alias("t")).distinct()
    met = p.join(t, "rec_id", "full_outer")
    if met.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        return pairwise_metrics(pairs_of(predicted), pairs_of(true))
    cells = met.groupBy("p", "t").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.coalesce(F.expr("sum(n * (n - 1) div 2)"), F.lit(0))
    side = lambda c: cells.where(F.col(c).isNotNull()).groupBy(c).agg(F.sum("n").alias("n")).agg(pairs.alias(f"of_{c}"))
    one = cells.where("p is not null and t is not null").agg(pairs.alias("tp")).join(side("p")).join(side("t"))  # three one-row tables
    counts = one.select("tp", (F.col("of_p") - F.col("tp")).alias("fp"), (F.col("of_t") - F.col("tp")).alias("fn"))
    return counts.select("tp", "fp", "fn", precision().alias("precision"), recall().alias("recall"), f_measure().alias("f1"))


def contingency(predicted: DataFrame, true: DataFrame, check: bool = True) -> DataFrame:
    """(pred_id, true_id, n) of two memberships (rec_id, cluster_id) of the same records.

    check: fails unless both hold the same records, once each.
    """
    p, t = predicted.select("rec_id", F.col("cluster_id").alias("pred_id")), true.select("rec_id", F.col("cluster_id").alias("true_id"))
    if check:
        both = p.groupBy("rec_id").agg(F.count(F.lit(1)).alias("np")).join(t.groupBy("rec_id").agg(F.count(F.lit(1)).alias("nt")), "rec_id", "full_outer")
        if both.where("coalesce(np, 0) <> 1 or coalesce(nt, 0) <> 1").limit(1).count():
            raise ValueError("predicted and true clusterings must hold the same records, once each")
    return p.join(t, "rec_id").groupBy("pred_id", "true_id").agg(F.count(F.lit(1)).alias("n"))


def comb2(n: Column) -> Column:
    """Pairs among n: 0 below 2."""
    return F.when(n < 2, F.lit(0.0)).otherwise(n.cast("double") * (n - 1) / 2)


def adjusted_rand(table: DataFrame) -> DataFrame:
    """One row: ari of a contingency table; null where it is 0 / 0 (trivial clusterings)."""
    side = lambda c: table.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(comb2(F.col("n"))).alias(c))
    cells = table.agg(F.sum(comb2(F.col("n"))).alias("c"), comb2(F.sum("n")).alias("m"))
    a, b, c, m = F.col("pred_id"), F.col("true_id"), F.col("c"), F.col("m")
    expected = F.try_divide(a * b, m)
    one = cells.join(side("pred_id")).join(side("true_id"))  # three one-row tables
    return one.select(F.try_divide(c - expected, (a + b) / 2 - expected).alias("ari"))


def exact_matches(df: DataFrame, attributes: list[str], rec_id: str = "rec_id") -> DataFrame:
    """(rec_id, cluster_id): records that agree on all attributes, nulls being equal; named by the smallest record."""
    first = df.groupBy(*attributes).agg(F.min(rec_id).alias("cluster_id"))
    same = [df[a].eqNullSafe(first[a]) for a in attributes]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return df.join(first, on).select(df[rec_id].alias("rec_id"), "cluster_id")


def near_matches(df: DataFrame, attributes: list[str], disagree: int, rec_id: str = "rec_id") -> DataFrame:
    """(pattern, cluster): for each choice of `disagree` attributes left out, the records that agree on the rest.

    Clusters of several patterns overlap; pattern is the list of attributes kept.
    """
    kept = [c for c in combinations(attributes, len(attributes) - disagree)]
    key = lambda c: F.struct(F.lit(",".join(c)).alias("pattern"), F.array(*[F.col(x).cast("string") for x in c]).alias("values"))
    rows = df.select(F.col(rec_id).alias("rec_id"), F.explode(F.array(*map(key, kept))).alias("k"))
    return rows.groupBy("k").agg(F.array_sort(F.collect_set("rec_id")).alias("cluster")).select("k.pattern", "cluster")
