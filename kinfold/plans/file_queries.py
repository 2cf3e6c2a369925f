"""Queries for scans, sinks, saved states, look-ups and steps: each writes its whole table in the shared folder and
returns what is read back, held against the SQL of what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.draws import Distribution
from kinfold.operators import chain as C
from kinfold.operators import clusters as K
from kinfold.operators import records as R
from kinfold.operators.partition import lpt_split
from kinfold.operators.state import load_state, save_state
from kinfold.sources import hocon, tables

from . import project as P
from .queries import ATTRIBUTES, BASE, CHAIN, CONFUSED, ER, MPC, ORACLE_SQL, QUERIES, STATE, TRUTH, Brands, cells, predicted, query, records, state, synthetic_chain


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{tables.shared_dir(spark).rstrip('/')}/kinfold-{name}-{uuid.uuid4().hex}"


def texts(clusters: DataFrame) -> DataFrame:
    return clusters.select(F.array_join("cluster", ",").alias("cluster"))


@query(ER)
def sc01_csv_scan(spark, sf_dir):
    """Records as CSV with a text for nulls, read by the scan."""
    path = fresh(spark, "records")
    records(spark, sf_dir).write.option("header", True).option("nullValue", "NA").csv(path)
    return tables.read_csv(spark, path, null_value="NA")


@query(f"with {CHAIN} select iteration, partition_id, cluster from flatc where iteration >= 5")
def sc02_chain_scan(spark, sf_dir):
    """A chain through the partitioned sink, in two appended parts, read from iteration 5 on."""
    path, chain = fresh(spark, "chain"), tables.keep(synthetic_chain(spark, sf_dir))
    tables.write_chain(chain.where("iteration < 7"), path, False)
    tables.write_chain(chain.where("iteration >= 7"), path, True)
    flat = C.flat_clusters(tables.read_chain(spark, path, 5))
    return flat.select("iteration", F.col("partitionId").alias("partition_id"), F.array_join("cluster", ",").alias("cluster"))


@query(f"with {CHAIN} select iteration, partition_id, cluster from flatc")
def pr04_without_empty_clusters(spark, sf_dir):
    """Chain rows that each hold an empty cluster too."""
    chain = synthetic_chain(spark, sf_dir).withColumn("linkageStructure", F.concat("linkageStructure", F.array(F.array().cast("array<string>"))))
    return C.flat_clusters(chain).select("iteration", F.col("partitionId").alias("partition_id"), F.array_join("cluster", ",").alias("cluster"))


@query(f"{TRUTH} select string_agg(rec_id, ',' order by rec_id) as cluster from truth group by cluster_id")
def sc05_clusters_text(spark, sf_dir):
    """Clusters as lines of text, written and read."""
    path = fresh(spark, "clusters")
    er = records(spark, sf_dir)
    tables.write_clusters(K.to_clusters(er, label="true_ent"), path)
    return texts(tables.read_clusters(spark, path))


@query("select 'chain' as what, false as found union all select 'late chain', false union all select 'state', false union all select 'copy', false")
def sc07_guarded_scans(spark, sf_dir):
    """What isn't there is told, not an error."""
    path, none = fresh(spark, "chain"), fresh(spark, "none")
    tables.write_chain(synthetic_chain(spark, sf_dir), path, False)
    found = [
        ("chain", tables.read_chain(spark, none) is not None), ("late chain", tables.read_chain(spark, path, 10) is not None),
        ("state", load_state(spark, none, ATTRIBUTES, Brands()) is not None), ("copy", tables.copy(spark, none, f"{none}-2")),
    ]
    return spark.createDataFrame(found, "what string, found boolean")


@query(f"""with {STATE} select c.rec_id, c.file_id, c.attr_id, c.value_id, c.distorted, l.ent_id, e.value_id as entity_value, p.partition_id::int as partition_id, 0.2::double as theta
    from st c join links l using (rec_id) join entities e on e.ent_id = l.ent_id and e.attr_id = c.attr_id join parts p on p.ent_id = l.ent_id""")
def sk07_saved_state(spark, sf_dir):
    """The chain's tables, saved and loaded."""
    path = fresh(spark, "state")
    save_state(state(spark, sf_dir), path)
    s = load_state(spark, path, ATTRIBUTES, Brands())
    values = s.entities.withColumnRenamed("value_id", "entity_value")
    rows = s.cells.join(s.links, "rec_id").join(values, ["ent_id", "attr_id"]).join(s.parts, "ent_id").join(s.theta, ["attr_id", "file_id"])
    return rows.select("rec_id", "file_id", "attr_id", "value_id", "distorted", "ent_id", "entity_value", F.col("partition_id").cast("int").alias("partition_id"), "theta")


@query(f"""with {BASE} select n.attr_id, n.value_id, n.value, round(n.prob, 9) as prob, round(n.sim_norm, 9) as sim_norm,
    (select count(*) from sim s where s.attr_id = n.attr_id and s.v1 = n.value_id) as n_similar from norms n""")
def fn05_index_lookups(spark, sf_dir):
    """Every value of every domain, asked of the index one by one."""
    index = R.build_index(tables.keep(cells(spark, sf_dir)), ATTRIBUTES, tables.keep)
    rows = []
    for k in range(len(ATTRIBUTES)):
        for v, (value, _, _) in sorted(index.lookup(k).by_id.items()):
            assert index.value_id(k, value) == v
            rows.append((k, v, value, round(index.probability(k, v), 9), round(index.sim_norm(k, v), 9), len(index.similar(k, v))))
    return spark.createDataFrame(rows, "attr_id int, value_id int, value string, prob double, sim_norm double, n_similar long")


@query("""with w as (select p_brand as value, count(*)::double as n from part where p_brand is not null group by all),
    r as (select value, n, sum(n) over (order by value) as upto, sum(n) over () as total from w)
    select value, round(n / total, 9) as prob, (select count(*) from range(100) t(i) where (2 * i + 1) / 200 * total >= upto - n and (2 * i + 1) / 200 * total < upto) as n_drawn from r""")
def rn02_distribution(spark, sf_dir):
    """Brands by their parts, and how often each is drawn at a hundred even places of [0, 1)."""
    counts = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_brand is not null").groupBy("p_brand").count().limit(R.MOST_LOOKED_UP + 1).collect()
    if len(counts) > R.MOST_LOOKED_UP:
        raise ValueError("too many brands for the driver: use cumulative()")
    dist = Distribution.of({r["p_brand"]: r["count"] for r in sorted(counts)})
    drawn = [dist.sample((2 * i + 1) / 200) for i in range(100)]
    return spark.createDataFrame([(v, round(p, 9), drawn.count(v)) for v, p in dist], "value string, prob double, n_drawn long")


@query("""with recursive w as (select p_size as value, count(*)::double as n from part group by all),
    o as (select *, row_number() over (order by n desc, value) as rn from w),
    dealt as (
        select 0::bigint as rn, 0 as value, false as goes_right, 0::double as l, 0::double as r
        union all
        select o.rn, o.value, not d.l < d.r, case when d.l < d.r then d.l + o.n else d.l end, case when d.l < d.r then d.r else d.r + o.n end from dealt d join o on o.rn = d.rn + 1
    ) select value::bigint as value, goes_right from dealt where rn > 0""")
def pt03_lpt_split(spark, sf_dir):
    """Part sizes in two halves; a small domain, which the driver holds."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_size").count().limit(R.MOST_LOOKED_UP + 1).collect()
    if len(rows) > R.MOST_LOOKED_UP:
        raise ValueError("too many sizes for the driver: use median_split()")
    counts = [(r["p_size"], float(r["count"])) for r in rows]
    right, _ = lpt_split(counts)
    return spark.createDataFrame([(v, v in right) for v, _ in counts], "value long, goes_right boolean")


#: A project's text; the steps' own settings and the output folder come in where it is used.
PROJECT = """
link : {
  prior : {alpha : 2, beta : 8.0} // of all three
  exact : {name : "ConstantSimilarityFn"}
  data : {
    path : "-", recordIdentifier : "rec_id", fileIdentifier : "file_id", entityIdentifier : "true_ent", nullValue : "NA"
    matchingAttributes : [
      {name : "a0", similarityFunction : {name : "LevenshteinSimilarityFn", parameters : {threshold : 7.0, maxSimilarity : 10.0}}, distortionPrior : ${link.prior}}
      {name : "a1", similarityFunction : ${link.exact}, distortionPrior : ${link.prior}}
      {name : "a2", similarityFunction : ${link.exact}, distortionPrior : ${link.prior}},
    ]
  }
  randomSeed : 7, expectedMaxClusterSize : 2
  partitioner : {name : "KDTreePartitioner", parameters : {numLevels : 0, matchingAttributes : []}}
  checkpointPath = ${link.outputPath}/scratch
}
"""


def ran(spark: SparkSession, sf_dir: str, steps: str, more: str = "", output: str | None = None) -> str:
    """The output folder of a project over all records, its steps done."""
    output = output or fresh(spark, "project")
    P.run(spark, f'{PROJECT}\nlink.outputPath : "{output}"\nlink.steps : [{steps}]\n{more}', records(spark, sf_dir))
    return output


def with_chain(spark: SparkSession, chain: DataFrame) -> str:
    """An output folder that holds this chain."""
    output = fresh(spark, "project")
    tables.write_chain(chain, f"{output}/linkage-chain.parquet", False)
    return output


@query(f"""with {STATE}, c as (select ent_id, string_agg(rec_id, ',' order by rec_id) as cluster from links group by all)
    select 0::bigint as iteration, cluster, 1::bigint as n from c
    union all select 1, 'records', count(*) from er union all select 1, 'distinct records', count(*) from er""")
def st01_sample_step(spark, sf_dir):
    """A sample step: the initial state's clusters, and that the next sample holds each record once."""
    count = records(spark, sf_dir).count()
    output = ran(spark, sf_dir, '{name : "sample", parameters : {sampleSize : 1, resume : false}}', f"link.populationSize : {count * 3 // 4}")
    flat = C.flat_clusters(tables.read_chain(spark, f"{output}/linkage-chain.parquet"))
    first = flat.where("iteration = 0").groupBy("iteration", F.array_join("cluster", ",").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    later = flat.where("iteration > 0").select("iteration", F.explode("cluster").alias("rec_id")).groupBy("iteration")
    totals = later.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("rec_id").alias("distinct records"))
    return first.unionByName(totals.unpivot("iteration", ["records", "distinct records"], "cluster", "n"))


RAND_TABLES, RAND = ORACLE_SQL["ag25_adjusted_rand"].removeprefix(f"{TRUTH}, ").split("\n    select round(", 1)


@query(f"""{CONFUSED}, {RAND_TABLES} select 'precision' as name, round(tp / (tp + fp), 9) as value from cm union all select 'recall', round(tp / (tp + fn), 9) from cm
    union all select 'f1', round(2 * tp / (2 * tp + fn + fp), 9) from cm union all select 'adjusted Rand index', round({RAND}""")
def st02_evaluate_step(spark, sf_dir):
    """The report of an evaluation, read back, over a chain of one sample: records of equal values together."""
    clusters = K.to_clusters(predicted(spark, sf_dir))
    part = F.pmod(F.hash(F.element_at("cluster", 1)), F.lit(8)).alias("partitionId")
    output = with_chain(spark, clusters.groupBy(F.lit(0).cast("long").alias("iteration"), part).agg(F.collect_list("cluster").alias("linkageStructure")))
    ran(spark, sf_dir, '{name : "evaluate", parameters : {metrics : ["pairwise", "cluster"]}}', output=output)
    lines = [x.strip().rsplit(None, 1) for x in tables.read_lines(spark, f"{output}/evaluation-results.txt").splitlines() if x.startswith(" ")]
    return spark.createDataFrame([(name, round(float(value), 9)) for name, value in lines], "name string, value double")


def melted(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(iteration, name, n) of a CSV file with a column for each value of name, however many; no zeros."""
    lines = spark.read.text(path).select(F.split("value", ",").alias("v"))
    is_head = F.element_at("v", 1) == "iteration"
    head = lines.where(is_head).select(F.posexplode("v").alias("k", name)).where("k > 0")
    long = lines.where(~is_head).select(F.element_at("v", 1).cast("long").alias("iteration"), F.posexplode("v").alias("k", "n")).where("k > 0 and cast(n as long) > 0")
    return long.join(head, "k").select("iteration", F.col(name).cast("int").alias(name), F.col("n").cast("long").alias("n"))


@query(f"with {CHAIN} select iteration, size::int as cluster_size, count(*) as n from flatc group by all")
def st03_cluster_size_file(spark, sf_dir):
    output = ran(spark, sf_dir, '{name : "summarize", parameters.quantities : ["cluster-size-distribution"]}', output=with_chain(spark, synthetic_chain(spark, sf_dir)))
    return melted(spark, f"{output}/cluster-size-distribution.csv", "cluster_size")


@query(f"with {CHAIN} select iteration, partition_id, count(*) as n from flatc where iteration >= 2 group by all")
def st03_partition_size_file(spark, sf_dir):
    steps = '{name : "summarize", parameters : {quantities : ["partition-sizes"], lowerIterationCutoff : 2}}'
    output = ran(spark, sf_dir, steps, output=with_chain(spark, synthetic_chain(spark, sf_dir)))
    return melted(spark, f"{output}/partition-sizes.csv", "partition_id")


@query(f"with {CHAIN}, {MPC} select string_agg(rec_id, ',' order by rec_id) as cluster from mpc group by cluster")
def st04_copied_clusters(spark, sf_dir):
    """Shared most probable clusters saved by one step and copied by the next, which passes over what isn't there."""
    output = with_chain(spark, synthetic_chain(spark, sf_dir))
    steps = f"""{{name : "summarize", parameters : {{quantities : ["shared-most-probable-clusters"]}}}}
        {{name : "copy-files", parameters : {{fileNames : ["shared-most-probable-clusters.csv", "none.txt"], destinationPath : "{output}/copy"}}}}"""
    ran(spark, sf_dir, steps, output=output)
    return texts(tables.read_clusters(spark, f"{output}/copy/shared-most-probable-clusters.csv"))


@query("""select * from (values ('a0', 'LevenshteinSimilarityFn', 2.0::double, 8.0::double), ('a1', 'ConstantSimilarityFn', 2.0::double, 8.0::double),
    ('a2', 'ConstantSimilarityFn', 2.0::double, 8.0::double)) t(name, similarity, alpha, beta)""")
def sc11_project_text(spark, sf_dir):
    """The attributes that a project's text describes, its references resolved."""
    tree = hocon.parse(PROJECT + '\nlink.outputPath : "/out"')["link"]
    rows = [(a["name"], a["similarityFunction"]["name"], float(a["distortionPrior"]["alpha"]), float(a["distortionPrior"]["beta"])) for a in tree["data"]["matchingAttributes"]]
    return spark.createDataFrame(rows, "name string, similarity string, alpha double, beta double")


__all__ = ["ORACLE_SQL", "QUERIES"]
