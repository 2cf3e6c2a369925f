"""Whole-domain work in ranges, counted pairs, and draws under other partitionings."""

import random

import pytest
from pyspark.sql import functions as F

from kinfold.functions import draws
from kinfold.functions.similarity import LevenshteinSimilarity
from kinfold.operators import clusters as K
from kinfold.operators import records as R
from kinfold.operators import transition as T
from kinfold.operators.partition import median_split
from kinfold.plans import queries as Q


def table(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("cuts", [1, 5, 255])
def test_domain_ranges(spark, monkeypatch, cuts):
    monkeypatch.setattr(R, "CUTS", cuts)
    rng = random.Random(cuts)
    values = [(str(i), "0", a, rng.choice(["", "é", "zz", f"v{rng.randrange(40)}", None])) for i in range(400) for a in (0, 1)]
    cells = spark.createDataFrame(values, "rec_id string, file_id string, attr_id int, value string")
    got = {(r["attr_id"], r["value"]): (r["value_id"], r["cnt"], r["prob"]) for r in R.domains(cells).collect()}
    want = {}
    for a in (0, 1):
        own = [v for *_, b, v in values if a == b and v is not None]
        for k, v in enumerate(sorted(set(own), key=lambda v: v.encode())):
            want[a, v] = (k, own.count(v), own.count(v) / len(own))
    assert got == want
    assert R.domains(cells.where("value is null")).count() == 0


@pytest.mark.parametrize("run", [1, 3, 1 << 16])
def test_running_sums(spark, monkeypatch, run):
    monkeypatch.setattr(draws, "RUN", run)
    rows = spark.createDataFrame([(g, v, (v * 7 + g) % 5 + 1) for g in (0, 1) for v in range(10)], "g int, v int, w long")
    for r in draws.running(rows, ["g"], "v", "w").collect():
        own = [(v * 7 + r["g"]) % 5 + 1 for v in range(10)]
        assert (r["upto"], r["total"], r["last"]) == (sum(own[: r["v"] + 1]), sum(own), 9)
    for r in median_split(rows, ["g"], "v").collect():
        own = [(v * 7 + r["g"]) % 5 + 1 for v in range(10)]
        split = next(v for v in range(10) if sum(own[: v + 1]) * 2 >= sum(own))
        assert (r["split"], r["below"], r["total"]) == (split, sum(own[: split + 1]), sum(own))
    cdf = draws.cumulative(rows.withColumn("p", F.col("w") / F.sum("w").over(draws.Window.partitionBy("g"))), ["g"], "v", "p").select("v", "g", "lo", "hi").distinct()
    ends = sorted((r["g"], r["v"], r["lo"], r["hi"]) for r in cdf.collect())
    assert len(ends) == 20 and [e[3] for e in ends if e[1] == 9] == [1.0, 1.0]
    assert all(abs(b[2] - a[3]) < 1e-12 for a, b in zip(ends, ends[1:]) if a[0] == b[0])


def test_similar_values_against_all_pairs(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abc", k=rng.randrange(0, 9))) for _ in range(60)} | {"annabella", "annabela", "añabella"})
    own = spark.createDataFrame([(0, k, w) for k, w in enumerate(words)], "attr_id int, value_id int, value string")
    for fn in (LevenshteinSimilarity(7, 10), LevenshteinSimilarity(0, 10), LevenshteinSimilarity(9.5, 10)):
        got = {(r["v1"], r["v2"]): round(r["exp_sim"], 6) for r in R.similar_values(own, [R.Attribute("a", fn)]).collect()}
        met = own.select(F.col("value_id").alias("v1"), F.col("value").alias("x")).crossJoin(own.select(F.col("value_id").alias("v2"), F.col("value").alias("y")))
        sims = met.select("v1", "v2", fn.column(F.col("x"), F.col("y")).alias("s")).where("s > 0")
        assert got == {(r["v1"], r["v2"]): round(r["e"], 6) for r in sims.select("v1", "v2", F.exp("s").alias("e")).collect()}


@pytest.mark.parametrize("kind", ["disjoint", "lacking", "overlapping", "empty"])
def test_counted_pairs(spark, kind):
    rng = random.Random(kind)
    rows = lambda n: [(f"r{i}", f"c{rng.randrange(n)}") for i in range(30) if kind != "lacking" or rng.random() < 0.8]
    pred, true = rows(6), rows(4)
    if kind == "overlapping":
        pred += rows(6)
    if kind == "empty":
        pred = []
    pred, true = (spark.createDataFrame(x + x[:3], "rec_id string, cluster_id string") for x in (pred, true))
    want = K.pairwise_metrics(K.pairs_of(pred), K.pairs_of(true))
    got = K.membership_metrics(pred, true)
    assert got.columns == want.columns and got.collect() == want.collect()


def test_partitions_leave_draws_alone(spark, sf):
    """A whole step gives the same links, values and distortions with other numbers of partitions."""
    asked, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            state = Q.state(spark, sf)
            state.cells = state.cells.repartition(int(n))
            now = T.step(state, "PCG-I", keep=lambda df, name: Q.tables.keep(df), theta=state.theta)
            seen.append([table(now.links), table(now.entities), table(now.cells)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", asked)
    assert seen[0] == seen[1]
