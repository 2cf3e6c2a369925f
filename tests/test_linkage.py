import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions import draws
from kinfold.functions.similarity import ConstantSimilarity, LevenshteinSimilarity
from kinfold.operators import chain as C
from kinfold.operators import clusters as K
from kinfold.operators import records as R
from kinfold.operators import transition as T
from kinfold.operators.partition import KDTreePartitioner, SimplePartitioner, lpt_schedule, lpt_split
from kinfold.operators.state import initial_state
from kinfold.plans import project
from kinfold.sources import tables

STATES = [
    ("Australian Capital Territory", 0.410, 0.0027140755302269004), ("New South Wales", 7.86, 1.4193905286944585e-4),
    ("Northern Territory", 0.246, 0.00451528932619675), ("Queensland", 4.92, 2.2673706056780077e-4),
    ("South Australia", 1.72, 6.465919296781136e-4), ("Tasmania", 0.520, 0.00214117348291189),
    ("Victoria", 6.32, 1.7651936247903708e-4), ("Western Australia", 2.58, 4.317863538883541e-4),
]


def similarity(spark, fn, a, b):
    return spark.range(1).select(fn.column(F.lit(a), F.lit(b))).first()[0]


def test_similarity_values(spark):
    five = LevenshteinSimilarity(5, 10)
    assert similarity(spark, five, "John Smith", "John Smith") == 10 == similarity(spark, five, "", "")
    assert similarity(spark, five, "", "John Smith") == 0
    assert math.isclose(similarity(spark, five, "AB", "BB"), 2.0)
    assert math.isclose(similarity(spark, LevenshteinSimilarity(0, 10), "AB", "BB"), 6.0)
    assert math.isclose(similarity(spark, five, "Jane Smith", "John Smith"), similarity(spark, five, "John Smith", "Jane Smith"))
    assert similarity(spark, ConstantSimilarity(), "a", "b") == 0
    for bad in ((5, 0), (-1, 10), (10, 10)):
        with pytest.raises(ValueError):
            LevenshteinSimilarity(*bad)


def test_index_values(spark):
    dom = spark.createDataFrame([(0, i, v, w) for i, (v, w, _) in enumerate(STATES)], "attr_id int, value_id int, value string, w double")
    total = sum(w for _, w, _ in STATES)
    dom = dom.withColumn("prob", F.col("w") / total)
    sim = R.similar_values(dom, [R.Attribute("s", LevenshteinSimilarity(5, 10))])
    norms = {r["value"]: r["sim_norm"] for r in R.with_norms(dom, sim).collect()}
    assert all(math.isclose(norms[v], n, rel_tol=1e-4) for v, _, n in STATES)
    near = {r["v2"]: r["exp_sim"] for r in sim.where("v1 = 4").collect()}
    assert set(near) == {4, 7} and math.isclose(near[7], 39.813678188084864) and math.isclose(near[4], 22026.465794806718)
    assert R.similar_values(dom, [R.Attribute("s")]).count() == 0


@pytest.fixture(scope="module")
def toy(spark):
    rows = [("r1", "A", "anna", "x"), ("r2", "B", "anne", "x"), ("r3", "A", "anna", None)]
    return spark.createDataFrame(rows, "rec_id string, file_id string, name string, kind string")


ATTRS = [R.Attribute("name", LevenshteinSimilarity(3, 10), R.BetaPrior(1, 4)), R.Attribute("kind", prior=R.BetaPrior(1, 4))]


def memory(df, name="t"):
    """Small tables as literals: short plans."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def test_index_lookups(spark, toy):
    index = R.build_index(R.to_cells(toy, ATTRS, "rec_id", "file_id"), ATTRS)
    assert index.value_id(0, "anna") == 0 and index.value_id(0, "zoe") is None and index.size(0) == 2
    assert math.isclose(index.probability(0, 0), 2 / 3) and index.exp_sim(1, 0, 0) == 1.0 and index.exp_sim(0, 0, 1) > 1
    with pytest.raises(KeyError):
        index.probability(0, 9)
    with pytest.raises(ValueError):
        R.build_index(R.to_cells(toy.withColumn("kind", F.lit(None).cast("string")), ATTRS), ATTRS)
    theta = R.prior_theta(index.files, [R.Attribute("n", prior=R.BetaPrior(3, 3))]).collect()
    assert {(r["file_id"], r["theta"]) for r in theta} == {("A", 0.5), ("B", 0.5)}


def test_state_invariants(spark, toy):
    for sampler in T.SAMPLERS:
        s = initial_state(toy, ATTRS, KDTreePartitioner(1, [0]), 3, file_id="file_id", population=4, keep=memory)
        s = T.step(s, sampler, memory)
        assert sorted(r["rec_id"] for r in s.links.collect()) == ["r1", "r2", "r3"]
        values = {(r["ent_id"], r["attr_id"]): r["value_id"] for r in s.entities.collect()}
        assert len(values) == 8 and s.parts.count() == 4
        ent = {r["rec_id"]: r["ent_id"] for r in s.links.collect()}
        for c in s.cells.collect():
            assert c["value_id"] is None or c["distorted"] or values[ent[c["rec_id"]], c["attr_id"]] == c["value_id"]
        assert sum(r["n"] for r in T.record_distortions(s).collect()) == 3


def test_draws(spark):
    n = 4000
    dist = spark.createDataFrame([(0, 0.1), (1, 0.2), (2, 0.7), (3, 0.0)], "v int, w double").withColumn("g", F.lit(0))
    cdf = draws.cumulative(draws.probabilities(dist, ["g"], "w"), ["g"], "v", "prob")
    keys = spark.range(n).withColumn("g", F.lit(0))
    got = Counter(r["v"] for r in draws.draw_from(keys, draws.uniform(1, 0, "t", "id"), cdf, ["g"], "v").collect())
    assert sum(got.values()) == n and set(got) == {0, 1, 2} and abs(got[2] / n - 0.7) < 0.03
    rows = keys.join(dist.where("w > 0"), "g").withColumn("lw", F.log("w"))
    got = Counter(r["v"] for r in draws.categorical(rows, ["id"], "v", "lw", draws.uniform(2, 0, "t", "id", "v")).collect())
    assert sum(got.values()) == n and abs(got[0] / n - 0.1) < 0.03
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(Exception, match="weights must be"):
            draws.checked_weights(spark.createDataFrame([(bad,)], "weight double")).collect()
    with pytest.raises(Exception, match="positive weight"):
        draws.probabilities(spark.createDataFrame([(0, 0.0)], "g int, weight double"), ["g"]).collect()


def test_value_updates_share_a_law(spark, toy):
    """The perturbation and the full scan draw an entity's value with equal frequencies."""
    n = 1500
    s = initial_state(toy.where("rec_id <> 'r3'"), ATTRS, KDTreePartitioner(0, []), 5, file_id="file_id", keep=memory)
    # many entities, each with one distorted record of value 0
    ids = spark.range(n)
    s.entities = memory(ids.select(F.col("id").alias("ent_id"), F.lit(0).alias("attr_id"), F.lit(0).alias("value_id")))
    s.links = memory(ids.select(F.col("id").cast("string").alias("rec_id"), F.col("id").alias("ent_id")))
    s.cells = memory(ids.select(F.col("id").cast("string").alias("rec_id"), F.lit("A").alias("file_id"), F.lit(0).alias("attr_id"), F.lit(0).alias("value_id"), F.lit(True).alias("distorted")))
    dom = {r["value_id"]: r for r in s.index.domain.where("attr_id = 0").collect()}
    sim = {(r["v1"], r["v2"]): r["exp_sim"] for r in s.index.sim.collect()}
    w = {v: d["prob"] * d["sim_norm"] * sim.get((0, v), 1.0) for v, d in dom.items()}
    want = w[0] / sum(w.values())
    for update in (T.values_plain, T.values_by_scan):
        share = np.mean([r["value_id"] == 0 for r in update(s).collect()])
        assert abs(share - want) < 4 * math.sqrt(want * (1 - want) / n) + 1e-9
    theta = 0.2
    s.theta = spark.createDataFrame([(0, "A", theta)], "attr_id int, file_id string, theta double")
    c = {v: d["prob"] * d["sim_norm"] * (sim.get((0, v), 1.0) + ((1 / theta - 1) / (dom[0]["prob"] * dom[0]["sim_norm"]) if v == 0 else 0)) for v, d in dom.items()}
    want = c[0] / sum(c.values())
    share = np.mean([r["value_id"] == 0 for r in T.values_collapsed(s).collect()])
    assert abs(share - want) < 4 * math.sqrt(want * (1 - want) / n) + 2e-3


def test_partitioners(spark):
    right, quality = lpt_split([(0, 5.0), (1, 3.0), (2, 2.0)])
    assert right == {0} and quality == 1.0
    jobs = [(k, float(w)) for k, w in enumerate([7, 6, 5, 4, 3, 2, 1])]
    bins = lpt_schedule(jobs, 3)
    load = Counter()
    for k, w in jobs:
        load[bins[k]] += w
    assert max(load.values()) <= 4 / 3 * math.ceil(28 / 3) and set(load) == {0, 1, 2}
    wide = spark.range(400).select(F.array((F.col("id") % 100).cast("int"), (F.col("id") % 3).cast("int")).alias("values"))
    tree = KDTreePartitioner(3, [0, 1]).fit(wide)
    sizes = {r["p"]: r["count"] for r in wide.groupBy(tree.column().alias("p")).count().collect()}
    assert sum(sizes.values()) == 400 and set(sizes) == set(range(tree.count)) and tree.count == 8
    assert KDTreePartitioner(0, []).fit(wide).count == 1
    blocks = SimplePartitioner(1, 2).fit(wide)
    assert {r["p"] for r in wide.select(blocks.column().alias("p")).distinct().collect()} == {0, 1}
    with pytest.raises(ValueError):
        KDTreePartitioner(-1, [0])


def test_evaluation(spark):
    pred = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "3")], "rec_id string, cluster_id string")
    true = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y")], "rec_id string, cluster_id string")
    m = K.pairwise_metrics(K.pairs_of(pred), K.pairs_of(true)).first()
    assert (m["tp"], m["fp"], m["fn"], m["precision"]) == (1, 0, 2, 1.0) and math.isclose(m["recall"], 1 / 3) and math.isclose(m["f1"], 0.5)
    assert K.adjusted_rand(K.contingency(true, true)).first()[0] == 1.0
    assert K.adjusted_rand(K.contingency(pred.limit(1), pred.limit(1))).first()[0] is None
    with pytest.raises(ValueError):
        K.contingency(pred, true.limit(2))
    with pytest.raises(Exception, match="itself"):
        K.canonical_pairs(spark.createDataFrame([("a", "a")], "a string, b string")).collect()
    near = K.near_matches(spark.createDataFrame([("1", "p", "q"), ("2", "p", "z"), ("3", None, "q")], "rec_id string, x string, y string"), ["x", "y"], 1)
    assert any(r["pattern"] == "x" and r["cluster"] == ["1", "2"] for r in near.collect())


def test_chain_summaries(spark, tmp_path):
    rows = [(0, [["a", "b"], ["c"]], 0), (1, [["a"], ["b", "c"]], 0), (2, [["b", "a"]], 1), (2, [], 0), (3, [["c"]], 0), (3, [["a"]], 1)]
    df = spark.createDataFrame(rows, tables.CHAIN_SCHEMA)
    path = str(tmp_path / "chain.parquet")
    tables.write_chain(df, path, False)
    chain = tables.read_chain(spark, path)
    mpc = {r["rec_id"]: (r["cluster"], r["frequency"]) for r in C.most_probable_clusters(chain).collect()}
    # {a} and {a, b} are as frequent: the smaller text wins
    assert mpc == {"a": (["a"], 0.5), "b": (["a", "b"], 0.5), "c": (["c"], 0.5)}
    assert sorted(r["cluster"] for r in C.shared_most_probable_clusters(C.most_probable_clusters(chain)).collect()) == [["a"], ["b"], ["c"]]
    assert {(r["iteration"], r["partitionId"]): r["size"] for r in C.partition_sizes(chain).collect()}[2, 0] == 0
    wide = C.pivot_cluster_sizes(C.cluster_size_distribution(chain))
    assert wide.columns == ["iteration", "0", "1", "2"] and tuple(wide.first()) == (0, 0, 1, 1)
    assert tables.read_chain(spark, path, 9) is None and tables.read_chain(spark, str(tmp_path / "none")) is None
    out = str(tmp_path / "clusters.csv")
    tables.write_clusters(spark.createDataFrame([(["a", "b"],), (["c"],)], "cluster array<string>"), out)
    tables.write_clusters(spark.createDataFrame([(["z"],)], "cluster array<string>"), out, overwrite=False)
    assert sorted(r["cluster"] for r in tables.read_clusters(spark, out).collect()) == [["a", "b"], ["c"]]


def config(tmp_path, data, size=2, burnin=0, thinning=1, sampler="PCG-I"):
    levenshtein = {"name": "LevenshteinSimilarityFn", "parameters": {"threshold": 3.0, "maxSimilarity": 10.0}}
    prior = {"alpha": 1.0, "beta": 4.0}
    return {
        "data": {
            "path": data, "recordIdentifier": "rec_id", "fileIdentifier": "file_id", "entityIdentifier": "ent", "nullValue": "NA",
            "matchingAttributes": [{"name": "name", "similarityFunction": levenshtein, "distortionPrior": prior}, {"name": "kind", "similarityFunction": {"name": "ConstantSimilarityFn"}, "distortionPrior": prior}],
        },
        "outputPath": str(tmp_path / "out") + "/", "checkpointPath": str(tmp_path / "ck"), "randomSeed": 11, "populationSize": 3,
        "partitioner": {"name": "KDTreePartitioner", "parameters": {"numLevels": 1, "matchingAttributes": ["name"]}},
        "steps": [
            {"name": "sample", "parameters": {"sampleSize": size, "burninInterval": burnin, "thinningInterval": thinning, "sampler": sampler}},
            {"name": "summarize", "parameters": {"quantities": ["cluster-size-distribution", "partition-sizes", "shared-most-probable-clusters"]}},
            {"name": "evaluate", "parameters": {"metrics": ["pairwise", "cluster"], "useExistingSMPC": True}},
            {"name": "copy-files", "parameters": {"fileNames": ["evaluation-results.txt", "missing.txt"], "destinationPath": str(tmp_path / "copy")}},
        ],
    }


def test_project_runs_and_resumes(spark, tmp_path):
    data = tmp_path / "d.csv"
    data.write_text("rec_id,file_id,name,kind,ent\nr1,A,anna,x,1\nr2,B,anne,x,1\nr3,A,bob,NA,2\n")
    project.run(spark, {"root": config(tmp_path, str(data))})
    out = tmp_path / "out"
    chain = tables.read_chain(spark, str(out / "linkage-chain.parquet"))
    assert sorted(r[0] for r in chain.select("iteration").distinct().collect()) == [0, 1, 2]
    for r in chain.groupBy("iteration").agg(F.sum(F.aggregate("linkageStructure", F.lit(0), lambda a, c: a + F.size(c))).alias("n")).collect():
        assert r["n"] == 3
    assert "adjusted Rand index" in (out / "evaluation-results.txt").read_text() and (tmp_path / "copy/evaluation-results.txt").exists()
    assert "Seed: 11" in (out / "run.txt").read_text()
    header = spark.read.option("header", True).csv(str(out / "diagnostics.csv"))
    assert header.columns[:3] == ["iteration", "systemTime-ms", "numObservedEntities"] and header.count() == 3
    again = config(tmp_path, str(data), size=1)
    again["steps"] = again["steps"][:1]
    project.run(spark, again)
    chain = tables.read_chain(spark, str(out / "linkage-chain.parquet"))
    assert sorted(r[0] for r in chain.select("iteration").distinct().collect()) == [0, 1, 2, 3]
    resumed = sorted(map(str, chain.where("iteration = 3").collect()))
    whole = config(tmp_path / "whole", str(data), size=3)
    whole["steps"] = whole["steps"][:1]
    project.run(spark, whole)
    straight = tables.read_chain(spark, str(tmp_path / "whole/out/linkage-chain.parquet"))
    clusters = lambda rows: sorted((r["partitionId"], sorted(map(tuple, r["linkageStructure"]))) for r in rows)
    assert clusters(chain.where("iteration = 3").collect()) == clusters(straight.where("iteration = 3").collect()), resumed


def test_config_errors(tmp_path):
    good = config(tmp_path, "d.csv")
    project.Project.parse(good)
    for path, value in (("randomSeed", "x"), ("partitioner.name", "Other"), ("expectedMaxClusterSize", 0), ("partitioner.parameters.matchingAttributes", ["nope"]), ("data.matchingAttributes", [])):
        bad = json.loads(json.dumps(good))
        at = bad
        *head, last = path.split(".")
        for p in head:
            at = at[p]
        at[last] = value
        with pytest.raises(ValueError):
            project.Project.parse(bad)
    for step in ({"name": "other"}, {"name": "sample", "parameters": {"sampleSize": 0}}, {"name": "sample", "parameters": {"sampleSize": 1, "sampler": "x"}}, {"name": "evaluate", "parameters": {"metrics": []}}, {"name": "summarize", "parameters": {"quantities": ["x"]}}):
        with pytest.raises(ValueError):
            project.parse_step(step)
