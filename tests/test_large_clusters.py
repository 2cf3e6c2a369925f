"""Chains with clusters of many records."""

import re

from pyspark.sql import functions as F

from kinfold.operators import chain as C
from kinfold.plans import project
from kinfold.plans.file_queries import melted, with_chain
from kinfold.sources import tables

ROWS = [
    (0, [["b", "a!"], ["a"], ["c", "d"], ["e"]], 0), (1, [["b", "a"], ["a!"], ["e"]], 0), (1, [["d", "c"]], 1),
    (2, [["b", "a!", "a"], ["c"]], 0), (2, [["d"], []], 1), (3, [["b"], ["a", "a!"]], 0),
]


def large(spark, n):
    """Three samples: a cluster of n records twice, and n clusters once."""
    ids = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("string"))
    rows = spark.range(3).select(F.col("id").alias("iteration"), F.when(F.col("id") < 2, F.array(ids)).otherwise(F.transform(ids, lambda x: F.array(x))).alias("linkageStructure"))
    return rows.withColumn("partitionId", F.lit(0))


def by_hand(rows):
    """Each record's most frequent cluster; ties to the smaller text."""
    samples = len({r[0] for r in rows})
    counts = {}
    for _, clusters, _ in rows:
        for c in clusters:
            counts[tuple(sorted(c))] = counts.get(tuple(sorted(c)), 0) + 1
    best = {}
    for c, n in counts.items():
        for x in c:
            best[x] = min(best.get(x, (0, "~", ())), (-n / samples, ",".join(c), c))
    return {x: (list(c), -f) for x, (f, _, c) in best.items()}


def test_most_probable_by_hand(spark):
    chain = spark.createDataFrame(ROWS, tables.CHAIN_SCHEMA)
    got = {r["rec_id"]: (r["cluster"], r["frequency"]) for r in C.most_probable_clusters(chain).collect()}
    assert got == by_hand(ROWS)
    plain = C.shared_most_probable_clusters(C.most_probable_clusters(chain)).collect()
    assert sorted(C.shared_best_clusters(chain).collect()) == sorted(plain)


def test_no_exchange_repeats_a_cluster(spark):
    """10,000 records of one cluster, dealt to three places: its records stand once in what is dealt by record."""
    chain = large(spark, 10_000)
    best = C.most_probable_clusters(chain, F.size("cluster"))
    rows = best.groupBy("cluster", "frequency").count().collect()
    assert [tuple(r) for r in rows] == [(10_000, 2 / 3, 10_000)]
    plan = C.most_probable_clusters(chain)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if re.search(r"Aggregate \[rec_id", x) and "cluster#" in x]
    assert [len(r["cluster"]) for r in C.shared_best_clusters(chain).collect()] == [10_000]


def test_counts_of_many_sizes(spark):
    """30,000 sizes, more than a pivot or a CSV reader takes as columns."""
    rows = {r["iteration"]: r["counts"] for r in C.cluster_size_counts(C.cluster_size_distribution(large(spark, 30_000))).collect()}
    assert {len(c) for c in rows.values()} == {30_001}
    assert [{k: n for k, n in enumerate(rows[i]) if n} for i in range(3)] == [{30_000: 1}, {30_000: 1}, {1: 30_000}]


def test_file_of_many_sizes(spark):
    out = with_chain(spark, large(spark, 30_000))
    project.SummarizeStep(["cluster-size-distribution"]).run(spark, type("P", (), {"output": out, "chain": lambda self, s, cutoff: tables.read_chain(s, f"{out}/linkage-chain.parquet", cutoff)})())
    path = f"{out}/cluster-size-distribution.csv"
    head, *lines = [r[0] for r in spark.read.text(path).collect()]
    assert head.split(",") == ["iteration", *map(str, range(30_001))]
    assert [(x.split(",")[0], x.count(",")) for x in lines] == [(str(i), 30_001) for i in range(3)]
    assert sorted(tuple(r) for r in melted(spark, path, "cluster_size").collect()) == [(0, 30_000, 1), (1, 30_000, 1), (2, 1, 30_000)]
