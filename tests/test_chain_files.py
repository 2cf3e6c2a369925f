"""States, scratch tables and files of a chain."""

import json
import math
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from kinfold.functions.draws import Distribution
from kinfold.functions.similarity import LevenshteinSimilarity
from kinfold.operators import records as R
from kinfold.operators import transition as T
from kinfold.operators.partition import KDTreePartitioner, LPTSchedule, SimplePartitioner
from kinfold.operators.sampler import sample
from kinfold.operators.state import initial_state, load_state
from kinfold.plans import project
from kinfold.sources import tables

ATTRS = [R.Attribute("name", LevenshteinSimilarity(3, 10), R.BetaPrior(1, 4)), R.Attribute("kind", prior=R.BetaPrior(1, 4))]
ROWS = [("r1", "A", "anna", "x", "1"), ("r2", "B", "anne", "x", "1"), ("r3", "A", "bob", None, "2")]
SCHEMA = "rec_id string, file_id string, name string, kind string, ent string"

CONF = """
link : {
  prior : {alpha : 1.0, beta : 4.0} // of both
  data : {
    path : "-", recordIdentifier : rec_id, fileIdentifier : file_id, entityIdentifier : null, nullValue : "NA"
    matchingAttributes : [
      {name : "name", similarityFunction : {name : "LevenshteinSimilarityFn", parameters : {threshold : 3.0, maxSimilarity : 10.0}}, distortionPrior : ${link.prior}},
      {name : "kind", similarityFunction : {name : "ConstantSimilarityFn",}, distortionPrior : ${link.prior}}
    ]
  }
  outputPath : "OUT/", checkpointPath : "CK", randomSeed : 11, expectedMaxClusterSize : 2.0
  partitioner : {name : "KDTreePartitioner", parameters : {numLevels : 1, matchingAttributes : ["name"]}}
  steps : [
    {name : "sample", parameters : {sampleSize : 2, sampler : "PCG-I"}},
    {name : "summarize", parameters : {quantities : ["cluster-size-distribution", "partition-sizes"]}}
  ]
}
"""


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_scratch_keeps_the_newest(spark, tmp_path):
    s = tables.Scratch(spark, str(tmp_path), 2)
    kept = [s(spark.range(3), "base")]
    for k in range(1, 6):
        s.step()
        kept.append(s(spark.range(k), "t"))
    assert sorted(os.listdir(s.root)) == ["0", "4", "5"] and [kept[k].count() for k in (0, 4, 5)] == [3, 4, 5]
    s.close()
    assert os.listdir(tmp_path) == []
    with pytest.raises(ValueError):
        tables.Scratch(spark, str(tmp_path), 1)


def test_a_long_chain_leaves_few_states(spark, toy, tmp_path):
    scratch = tables.Scratch(spark, str(tmp_path / "scratch"))
    state = initial_state(toy, ATTRS, KDTreePartitioner(1, [0]), 3, file_id="file_id", keep=scratch, most_power=2)
    out = str(tmp_path / "out")
    state = sample(state, 5, out, buffer=2, scratch=scratch)
    generations = [n for n in os.listdir(scratch.root) if n.isdigit()]
    assert sorted(map(int, generations)) == [0, 3, 4, 5] and len(os.listdir(scratch.root)) == 4
    scratch.close()
    saved = [n for n in os.listdir(f"{out}/state") if not n.startswith(".")]
    assert len(saved) == 3 and "state.json" in saved
    assert state.iteration == 5 and state.links.count() == 3  # the state returned needs no scratch table
    again = load_state(spark, f"{out}/state", ATTRS, KDTreePartitioner(1, [0]))
    assert again.partitioner.fitted() == state.partitioner.fitted() and again.index.powers.where("attr_id = 0").select("k").distinct().count() == 3
    assert again.parts.join(T.to_wide(again.entities), "ent_id").where(F.col("partition_id") != again.partitioner.column()).isEmpty()
    with pytest.raises(ValueError, match="other attributes"):
        load_state(spark, f"{out}/state", ATTRS[:1], KDTreePartitioner(1, [0]))
    assert load_state(spark, str(tmp_path / "none"), ATTRS, KDTreePartitioner(1, [0])) is None
    lines = (tmp_path / "out/diagnostics.csv").read_text().splitlines()
    assert len(lines) == 7 and [x.split(",")[0] for x in lines] == ["iteration", *"012345"]


def test_powers_made_in_advance_change_no_draw(spark, toy):
    plain = initial_state(toy, ATTRS, KDTreePartitioner(0, []), 3, file_id="file_id")
    ahead = initial_state(toy, ATTRS, KDTreePartitioner(0, []), 3, file_id="file_id", most_power=1)
    ways = [T.step(s, "PCG-I", tables.keep).entities.collect() for s in (plain, ahead)]
    assert sorted(map(str, ways[0])) == sorted(map(str, ways[1]))


def test_project_from_text(spark, toy, tmp_path):
    own = project.run(spark, CONF.replace("OUT", str(tmp_path / "out")).replace("CK", str(tmp_path / "ck")), toy)
    assert own.max_cluster_size == 2 and own.ent_id is None and own.attributes[0].prior == R.BetaPrior(1.0, 4.0)
    shared = spark.conf.get("spark.checkpoint.dir", None)
    assert own.scratch(spark) == (shared or str(tmp_path / "ck"))  # the session's setting comes first
    assert own.scratch(SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default))) == str(tmp_path / "ck")
    assert (tmp_path / "out/cluster-size-distribution.csv").read_text().startswith("iteration,0,1")
    sizes = [list(map(int, x.split(","))) for x in (tmp_path / "out/cluster-size-distribution.csv").read_text().splitlines()[1:]]
    assert [r[0] for r in sizes] == [0, 1, 2] and all(sum(k * n for k, n in enumerate(r[1:])) == 3 for r in sizes)
    assert (tmp_path / "out/partition-sizes.csv").is_file()


def test_csv_of_no_rows(spark, tmp_path):
    tables.write_csv(spark.range(0).select("id", F.lit(1).alias("n")), str(tmp_path / "x.csv"))
    assert (tmp_path / "x.csv").read_text() == "id,n\n" and [n for n in os.listdir(tmp_path) if not n.startswith(".")] == ["x.csv"]


def test_partitioners_come_back(spark, caplog):
    wide = spark.range(400).select(F.array((F.col("id") % 100).cast("int"), F.least(F.col("id"), F.lit(2)).cast("int")).alias("values"))
    for one, other in ((KDTreePartitioner(2, [0, 1]), KDTreePartitioner(2, [0, 1])), (SimplePartitioner(0, 3), SimplePartitioner(0, 3))):
        one.fit(wide)
        other.restore(json.loads(json.dumps(one.fitted())))
        assert one.count == other.count and wide.where(one.column() != other.column()).isEmpty()
    assert "poor split" in caplog.text  # the second attribute is 2 nearly everywhere


def test_schedule_and_distribution():
    s = LPTSchedule([("a", 5.0), ("b", 3.0), ("c", 2.0)], 2)
    assert (s.of_job, s.jobs, s.sizes) == ({"a": 0, "b": 1, "c": 1}, [["a"], ["b", "c"]], [5.0, 5.0])
    d = Distribution.of({"A": 100, "B": 200, "C": 700})
    assert d.values == ["A", "B", "C"] and d.total_weight == 1000 and d.num_values == 3
    assert d.probability("B") == 0.2 and d.probability("D") == 0.0 and math.isclose(sum(p for _, p in d), 1)
    assert [d.sample(u) for u in (0.0, 0.0999, 0.1, 0.2999, 0.3, 0.9999999)] == ["A", "A", "B", "B", "C", "C"]
    e = Distribution.of([0.0, 0.25, 0.0, 0.75, 0.0])
    assert e.probability(0) == 0 == e.probability(7) and [e.sample(u) for u in (0.0, 0.24, 0.25, 0.99)] == [1, 1, 3, 3]
    for bad in ([], [0.0], [-1.0, 2.0], [math.nan], [math.inf]):
        with pytest.raises(ValueError):
            Distribution.of(bad)
