"""Projects from configurations (texts or dicts with the usual key tree), their steps, and the command line."""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.similarity import REGISTRY
from kinfold.operators import chain as C
from kinfold.operators import clusters as K
from kinfold.operators.partition import KDTreePartitioner, SimplePartitioner
from kinfold.operators.records import Attribute, BetaPrior
from kinfold.operators.sampler import sample
from kinfold.operators.state import initial_state, load_state
from kinfold.operators.transition import SAMPLERS
from kinfold.sources import hocon, tables


class ConfigError(ValueError):
    """A missing, malformed or unknown setting."""


def setting(tree: dict, path: str, kind=None, default=...):
    at = tree
    for part in path.split("."):
        if not isinstance(at, dict) or part not in at:
            if default is ...:
                raise ConfigError(f"missing setting {path}")
            return default
        at = at[part]
    if at is None and default is not ...:
        return default
    if kind is int and isinstance(at, float) and at.is_integer():
        at = int(at)
    if kind is not None and (not isinstance(at, kind) or isinstance(at, bool) and bool not in (kind if isinstance(kind, tuple) else (kind,))):
        raise ConfigError(f"setting {path} has a wrong type: {at!r}")
    return at


def parse_attribute(spec: dict) -> Attribute:
    name = setting(spec, "similarityFunction.name", str)
    if name not in REGISTRY:
        raise ConfigError(f"unknown similarity function {name}")
    given = setting(spec, "similarityFunction.parameters", dict, {})
    names = {"threshold": "threshold", "maxSimilarity": "max_similarity"}
    if set(given) - set(names):
        raise ConfigError(f"unknown parameters {sorted(set(given) - set(names))}")
    similarity = REGISTRY[name](**{names[k]: float(v) for k, v in given.items()})
    return Attribute(setting(spec, "name", str), similarity, BetaPrior(float(setting(spec, "distortionPrior.alpha", (int, float))), float(setting(spec, "distortionPrior.beta", (int, float)))))


@dataclass
class Project:
    data: str
    output: str
    checkpoint: str | None
    rec_id: str
    file_id: str | None
    ent_id: str | None
    null_value: str
    attributes: list[Attribute]
    partitioner: object
    seed: int
    population: int | None = None
    max_cluster_size: int = 10
    frame: DataFrame | None = field(default=None, repr=False)

    @staticmethod
    def parse(config: dict) -> Project:
        """config: the tree below the root key."""
        attributes = [parse_attribute(a) for a in setting(config, "data.matchingAttributes", list)]
        if not attributes:
            raise ConfigError("no matching attributes")
        names = [a.name for a in attributes]
        kind = setting(config, "partitioner.name", str)
        if kind == "KDTreePartitioner":
            on = setting(config, "partitioner.parameters.matchingAttributes", list, [])
            if set(on) - set(names):
                raise ConfigError(f"the tree's attributes {sorted(set(on) - set(names))} aren't matching attributes")
            partitioner = KDTreePartitioner(setting(config, "partitioner.parameters.numLevels", int), [names.index(x) for x in on])
        elif kind == "SimplePartitioner":
            on = setting(config, "partitioner.parameters.matchingAttribute", str)
            if on not in names:
                raise ConfigError(f"{on} isn't a matching attribute")
            partitioner = SimplePartitioner(names.index(on), setting(config, "partitioner.parameters.numPartitions", int))
        else:
            raise ConfigError(f"unknown partitioner {kind}")
        most = setting(config, "expectedMaxClusterSize", int, 10)
        if most <= 0:
            raise ConfigError("expectedMaxClusterSize must be positive")
        population = setting(config, "populationSize", int, None)
        if population is not None and population <= 0:
            raise ConfigError("populationSize must be positive")
        return Project(
            setting(config, "data.path", str), setting(config, "outputPath", str).rstrip("/"), setting(config, "checkpointPath", str, None),
            setting(config, "data.recordIdentifier", str), setting(config, "data.fileIdentifier", str, None), setting(config, "data.entityIdentifier", str, None),
            setting(config, "data.nullValue", str), attributes, partitioner, setting(config, "randomSeed", int), population, most,
        )

    def records(self, spark: SparkSession) -> DataFrame:
        return self.frame if self.frame is not None else tables.read_csv(spark, self.data, null_value=self.null_value)

    def true_clusters(self, spark: SparkSession) -> DataFrame | None:
        if self.ent_id is None:
            return None
        return self.records(spark).select(F.col(self.rec_id).cast("string").alias("rec_id"), F.col(self.ent_id).cast("string").alias("cluster_id"))

    def chain(self, spark: SparkSession, cutoff: int = 0) -> DataFrame | None:
        return tables.read_chain(spark, f"{self.output}/linkage-chain.parquet", cutoff)

    def scratch(self, spark: SparkSession) -> str:
        """The folder of tables between steps: the session's shared one, or the project's where that is unset."""
        if spark.conf.get("spark.checkpoint.dir", None) or self.checkpoint is None:
            return tables.shared_dir(spark)
        return self.checkpoint

    def describe(self) -> str:
        lines = [f"Data: {self.data}", f"Record id: {self.rec_id}; file id: {self.file_id or '-'}; entity id: {self.ent_id or '-'}", f"Seed: {self.seed}; population: {self.population or 'number of records'}; expected largest cluster: {self.max_cluster_size}", f"Partitioner: {type(self.partitioner).__name__}"]
        lines += [f"Attribute {k}: {a.name}, {a.similarity}, Beta({a.prior.alpha}, {a.prior.beta})" for k, a in enumerate(self.attributes)]
        return "\n".join(lines)


@dataclass
class SampleStep:
    size: int
    burnin: int = 0
    thinning: int = 1
    resume: bool = True
    sampler: str = "PCG-I"

    def __post_init__(self) -> None:
        if self.size <= 0 or self.burnin < 0 or self.thinning <= 0:
            raise ConfigError("sampleSize and thinningInterval must be positive, burninInterval not negative")
        if self.sampler not in SAMPLERS:
            raise ConfigError(f"unknown sampler {self.sampler}")

    def run(self, spark: SparkSession, project: Project) -> None:
        state = load_state(spark, f"{project.output}/state", project.attributes, project.partitioner) if self.resume else None
        scratch = tables.Scratch(spark, project.scratch(spark))
        try:
            if state is None:
                state = initial_state(project.records(spark), project.attributes, project.partitioner, project.seed, project.rec_id, project.file_id, project.population, scratch, project.max_cluster_size)
            sample(state, self.size, project.output, self.burnin, self.thinning, self.sampler, scratch=scratch)
        finally:
            scratch.close()


@dataclass
class EvaluateStep:
    metrics: list[str]
    cutoff: int = 0
    use_existing: bool = False

    def __post_init__(self) -> None:
        if not self.metrics or set(self.metrics) - {"pairwise", "cluster"}:
            raise ConfigError("metrics must be among pairwise and cluster")
        if self.cutoff < 0:
            raise ConfigError("lowerIterationCutoff must not be negative")

    def run(self, spark: SparkSession, project: Project) -> None:
        if project.ent_id is None:
            raise ConfigError("evaluation needs an entity identifier")
        clusters = shared_clusters(spark, project, self.cutoff, self.use_existing)
        predicted, true = K.to_membership(clusters), project.true_clusters(spark)
        lines = []
        if "pairwise" in self.metrics:
            r = K.membership_metrics(predicted, true).first()
            lines += ["Pairwise metrics", f"  precision {r['precision']}", f"  recall    {r['recall']}", f"  f1        {r['f1']}"]
        if "cluster" in self.metrics:
            lines += ["Cluster metrics", f"  adjusted Rand index {K.adjusted_rand(K.contingency(predicted, true)).first()[0]}"]
        tables.write_lines(spark, "\n".join(lines) + "\n", f"{project.output}/evaluation-results.txt")
        print("\n".join(lines))


@dataclass
class SummarizeStep:
    quantities: list[str]
    cutoff: int = 0

    def __post_init__(self) -> None:
        known = {"cluster-size-distribution", "partition-sizes", "shared-most-probable-clusters"}
        if not self.quantities or set(self.quantities) - known:
            raise ConfigError(f"quantities must be among {sorted(known)}")
        if self.cutoff < 0:
            raise ConfigError("lowerIterationCutoff must not be negative")

    def run(self, spark: SparkSession, project: Project) -> None:
        chain = project.chain(spark, self.cutoff)
        if chain is None:
            raise ConfigError("no saved linkage chain")
        if "cluster-size-distribution" in self.quantities:
            tables.write_csv_lines(C.cluster_size_lines(C.cluster_size_distribution(chain)), "iteration", f"{project.output}/cluster-size-distribution.csv")
        if "partition-sizes" in self.quantities:
            tables.write_csv(C.pivot_partition_sizes(C.partition_sizes(chain)), f"{project.output}/partition-sizes.csv")
        if "shared-most-probable-clusters" in self.quantities:
            shared_clusters(spark, project, self.cutoff, False)


@dataclass
class CopyFilesStep:
    names: list[str]
    target: str
    overwrite: bool = False
    delete_source: bool = False

    def run(self, spark: SparkSession, project: Project) -> None:
        for n in self.names:
            tables.copy(spark, f"{project.output}/{n}", f"{self.target.rstrip('/')}/{n}", self.overwrite, self.delete_source)


def shared_clusters(spark: SparkSession, project: Project, cutoff: int, use_existing: bool) -> DataFrame:
    """The shared most probable clusters, from their file or from the chain, and then saved."""
    path = f"{project.output}/shared-most-probable-clusters.csv"
    if not (use_existing and tables.exists(spark, path)):
        chain = project.chain(spark, cutoff)
        if chain is None:
            raise ConfigError("no saved linkage chain")
        scratch = tables.Scratch(spark, project.scratch(spark))
        try:
            tables.write_clusters(C.shared_best_clusters(chain, scratch), path)
        finally:
            scratch.close()
    return tables.read_clusters(spark, path)


def parse_step(spec: dict):
    name, p = setting(spec, "name", str), setting(spec, "parameters", dict, {})
    if name == "sample":
        return SampleStep(setting(p, "sampleSize", int), setting(p, "burninInterval", int, 0), setting(p, "thinningInterval", int, 1), setting(p, "resume", bool, True), setting(p, "sampler", str, "PCG-I"))
    if name == "evaluate":
        return EvaluateStep(setting(p, "metrics", list), setting(p, "lowerIterationCutoff", int, 0), setting(p, "useExistingSMPC", bool, False))
    if name == "summarize":
        return SummarizeStep(setting(p, "quantities", list), setting(p, "lowerIterationCutoff", int, 0))
    if name == "copy-files":
        return CopyFilesStep(setting(p, "fileNames", list), setting(p, "destinationPath", str), setting(p, "overwrite", bool, False), setting(p, "deleteSource", bool, False))
    raise ConfigError(f"unknown step {name}")


def run(spark: SparkSession, config: dict | str, frame: DataFrame | None = None) -> Project:
    """Parses a whole configuration (a tree or its text) first, then runs its steps in order; root keys that hold
    the tree are looked through."""
    if isinstance(config, str):
        config = hocon.parse(config)
    while len(config) == 1 and isinstance(next(iter(config.values())), dict):
        config = next(iter(config.values()))
    project = Project.parse(config)
    project.frame = frame
    steps = [parse_step(s) for s in setting(config, "steps", list)]
    tables.write_lines(spark, project.describe() + "\n" + "\n".join(map(str, steps)) + "\n", f"{project.output}/run.txt")
    for s in steps:
        s.run(spark, project)
    return project


def main(args: list[str]) -> None:
    spark = SparkSession.builder.appName("kinfold").getOrCreate()
    run(spark, tables.read_lines(spark, args[0]))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
