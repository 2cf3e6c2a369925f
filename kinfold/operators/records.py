"""Records: projection to cells, statistics, dictionaries, encoding."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinfold.functions.similarity import ConstantSimilarity


@dataclass(frozen=True)
class BetaPrior:
    alpha: float
    beta: float

    def __post_init__(self) -> None:
        if not (self.alpha > 0 and self.beta > 0):
            raise ValueError("shape parameters must be positive")

    @property
    def mean(self) -> float:
        return self.alpha / (self.alpha + self.beta)


@dataclass(frozen=True)
class Attribute:
    name: str
    similarity: object = field(default_factory=ConstantSimilarity)
    prior: BetaPrior = BetaPrior(0.5, 50.0)

    @property
    def is_constant(self) -> bool:
        return self.similarity.is_constant


def to_cells(df: DataFrame, attributes: list[Attribute], rec_id: str = "rec_id", file_id: str | None = None) -> DataFrame:
    """(rec_id, file_id, attr_id, value): one row a record and attribute; file "0" where no file column is named."""
    file = F.coalesce(F.col(file_id).cast("string"), F.lit("0")) if file_id else F.lit("0")
    values = F.array(*[F.col(a.name).cast("string") for a in attributes])
    return df.select(F.col(rec_id).cast("string").alias("rec_id"), file.alias("file_id"), F.posexplode(values).alias("attr_id", "value"))


def file_sizes(cells: DataFrame) -> DataFrame:
    return cells.where("attr_id = 0").groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


def missing_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("file_id", "attr_id").agg(F.count_if(F.col("value").isNull()).alias("n_missing")).where("n_missing > 0")


def value_counts(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("value").isNotNull()).groupBy("attr_id", "value").agg(F.count(F.lit(1)).alias("cnt"))


def percent_missing(cells: DataFrame) -> DataFrame:
    return cells.agg((F.avg(F.col("value").isNull().cast("double")) * 100).alias("pct_missing"))


#: Values, of all attributes together, that cut the domains into ranges.
CUTS = 255


def domains(cells: DataFrame, keep=lambda df: df) -> DataFrame:
    """(attr_id, value_id, value, cnt, prob): ids are ranks by ascending value, from 0, in each attribute.

    Values are ranked inside ranges, to which the counts of the ranges before are added. The ranges' ends are the
    CUTS values of least hash, so they are the same after a retry; keep writes the counts that they are taken from.
    """
    counts = keep(value_counts(cells))
    ends: dict[int, list[str]] = {}
    for r in counts.select("attr_id", "value").orderBy(F.xxhash64("attr_id", "value"), "attr_id", "value").limit(CUTS).collect():
        ends.setdefault(r["attr_id"], []).append(r["value"])
    before = F.lit(0)
    for attr, cuts in ends.items():
        own = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("value")))
        before = F.when(F.col("attr_id") == attr, own).otherwise(before)
    ranged = counts.withColumn("range", before)
    by = Window.partitionBy("attr_id")  # a row a range
    sums = ranged.groupBy("attr_id", "range").agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("s"))
    first = F.coalesce(F.sum("n").over(by.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tied = F.broadcast(sums.select("attr_id", "range", first.alias("first"), F.sum("s").over(by).alias("total")))  # CUTS ranges, and one an attribute
    rank = F.row_number().over(Window.partitionBy("attr_id", "range").orderBy("value")) - 1
    rows = ranged.withColumn("rank", rank).join(tied, ["attr_id", "range"])
    return rows.select("attr_id", (F.col("first") + F.col("rank")).cast("int").alias("value_id"), "value", "cnt", (F.col("cnt") / F.col("total")).alias("prob"))


def similar_values(domain: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """(attr_id, v1, v2, exp_sim) of all pairs of values with exp_sim above 1, a value with itself included.

    Pairs meet by their lengths: a difference of lengths is a lower bound of the edits, so a value is
    offered to the lengths within reach only, and edits are counted up to the reach. Constant attributes have no rows.
    """
    out = None
    for k, a in enumerate(attributes):
        if a.is_constant:
            continue
        own = domain.where(F.col("attr_id") == k).select("attr_id", "value_id", "value", F.length("value").alias("size"))
        sizes = own.select(F.col("size").alias("to_size")).distinct()
        near = own.select("size").distinct().join(sizes, F.abs(F.col("size") - F.col("to_size")) <= a.similarity.reach(F.col("size") + F.col("to_size")))
        left = own.join(near, "size").select("attr_id", F.col("value_id").alias("v1"), F.col("value").alias("x"), F.col("to_size").alias("size"))
        right = own.select("size", F.col("value_id").alias("v2"), F.col("value").alias("y"))
        reach = a.similarity.reach(F.length("x") + F.length("y"))
        met = left.join(right, "size").where(F.call_function("levenshtein", F.col("x"), F.col("y"), reach) >= 0)
        sims = met.withColumn("sim", a.similarity.column(F.col("x"), F.col("y"))).where("sim > 0")
        part = sims.select("attr_id", "v1", "v2", F.exp("sim").alias("exp_sim"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return domain.sparkSession.createDataFrame([], "attr_id int, v1 int, v2 int, exp_sim double")
    return out


def with_norms(domain: DataFrame, sim: DataFrame) -> DataFrame:
    """Adds sim_norm = 1 / sum over w of prob(w) * exp_sim(v, w); from the pairs above 1 only: 1 / (1 + sum prob (e - 1))."""
    other = domain.select("attr_id", F.col("value_id").alias("v2"), F.col("prob").alias("p2"))
    extra = sim.join(other, ["attr_id", "v2"]).groupBy("attr_id", F.col("v1").alias("value_id")).agg(F.sum(F.col("p2") * (F.col("exp_sim") - 1)).alias("extra"))
    return domain.join(extra, ["attr_id", "value_id"], "left").withColumn("sim_norm", 1 / (1 + F.coalesce("extra", F.lit(0.0)))).drop("extra")


def powered_base(domain: DataFrame, powers: DataFrame) -> DataFrame:
    """(attr_id, k, value_id, base): base proportional to prob * sim_norm ** k, for the (attr_id, k) asked for."""
    w = F.col("prob") * F.pow("sim_norm", F.col("k"))
    rows = powers.select("attr_id", "k").distinct().join(domain, "attr_id").withColumn("w", w)
    return rows.select("attr_id", "k", "value_id", (F.col("w") / F.sum("w").over(Window.partitionBy("attr_id", "k"))).alias("base"))


def encode(cells: DataFrame, domain: DataFrame) -> DataFrame:
    """(rec_id, file_id, attr_id, value_id): null for missing values."""
    return cells.join(domain.select("attr_id", "value", "value_id"), ["attr_id", "value"], "left").select("rec_id", "file_id", "attr_id", "value_id")


def decode(encoded: DataFrame, domain: DataFrame) -> DataFrame:
    return encoded.join(domain.select("attr_id", "value_id", "value"), ["attr_id", "value_id"], "left").select("rec_id", "file_id", "attr_id", "value")


def prior_theta(files: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """(attr_id, file_id, theta) at the priors' means."""
    if not attributes:
        raise ValueError("no attributes")
    rows = F.array(*[F.struct(F.lit(k).alias("attr_id"), F.lit(a.prior.mean).alias("theta")) for k, a in enumerate(attributes)])
    return files.select("file_id", F.explode(rows).alias("r")).select("r.attr_id", "file_id", "r.theta")


#: Domains of more values aren't held by the driver.
MOST_LOOKED_UP = 1_000_000


class DomainLookup:
    """One attribute's values in the driver's memory, and the similar values of those asked for so far."""

    def __init__(self, index: Index, attr_id: int) -> None:
        own = index.domain.where(F.col("attr_id") == attr_id).select("value_id", "value", "prob", "sim_norm")
        rows = own.limit(MOST_LOOKED_UP + 1).collect()
        if len(rows) > MOST_LOOKED_UP:
            raise ValueError(f"attribute {attr_id} has more than {MOST_LOOKED_UP} values: join with the domain instead")
        self.by_id = {r["value_id"]: (r["value"], r["prob"], r["sim_norm"]) for r in rows}
        self.by_value = {r["value"]: r["value_id"] for r in rows}
        self.sim = index.sim.where(F.col("attr_id") == attr_id)
        self.constant = index.attributes[attr_id].is_constant
        self.near: dict[int, dict[int, float]] = {}

    def row(self, value_id: int) -> tuple[str, float, float]:
        if value_id not in self.by_id:
            raise KeyError(f"value id {value_id} is not in the domain")
        return self.by_id[value_id]

    def similar(self, value_id: int) -> dict[int, float]:
        """exp_sim by value id where it is above 1; the first question about a value is a job for it and the
        99 ids after it, later ones aren't."""
        self.row(value_id)
        if value_id not in self.near:
            end = value_id + 100
            self.near |= {v: {} for v in range(value_id, end) if v in self.by_id and v not in self.near}
            asked = self.sim.where((F.col("v1") >= value_id) & (F.col("v1") < end)).select("v1", "v2", "exp_sim")
            for r in [] if self.constant else asked.collect():
                self.near[r["v1"]][r["v2"]] = r["exp_sim"]
        return self.near[value_id]


@dataclass
class Index:
    """What is known of the attributes' values: domain with sim_norm, similar pairs, files.

    powers: powered_base() for up to most_power records an entity, where it was asked for. folder: where the
    tables are saved, if they are. Look-ups collect one attribute's domain, once.
    """

    attributes: list[Attribute]
    domain: DataFrame
    sim: DataFrame
    files: DataFrame
    powers: DataFrame | None = None
    most_power: int = -1
    folder: str | None = None
    looked_up: dict[int, DomainLookup] = field(default_factory=dict, repr=False)

    def lookup(self, attr_id: int) -> DomainLookup:
        if attr_id not in self.looked_up:
            self.looked_up[attr_id] = DomainLookup(self, attr_id)
        return self.looked_up[attr_id]

    def value_id(self, attr_id: int, value: str) -> int | None:
        return self.lookup(attr_id).by_value.get(value)

    def probability(self, attr_id: int, value_id: int) -> float:
        return self.lookup(attr_id).row(value_id)[1]

    def sim_norm(self, attr_id: int, value_id: int) -> float:
        return self.lookup(attr_id).row(value_id)[2]

    def size(self, attr_id: int) -> int:
        return len(self.lookup(attr_id).by_id)

    def similar(self, attr_id: int, value_id: int) -> dict[int, float]:
        return self.lookup(attr_id).similar(value_id)

    def exp_sim(self, attr_id: int, v1: int, v2: int) -> float:
        self.lookup(attr_id).row(v2)
        return self.similar(attr_id, v1).get(v2, 1.0)

    def bases(self, keys: DataFrame) -> DataFrame:
        """powered_base() for the (attr_id, k) of keys: from the saved powers as far as they reach."""
        wanted = keys.select("attr_id", "k").distinct()
        if self.powers is None:
            return powered_base(self.domain, wanted)
        return self.powers.unionByName(powered_base(self.domain, wanted.where(F.col("k") > self.most_power)))


def build_index(cells: DataFrame, attributes: list[Attribute], keep=lambda df: df, most_power: int = -1) -> Index:
    """keep: writes or caches a table that later steps read again and again. most_power: the largest cluster that
    the powers are made for in advance; larger ones are served too, by a sum over the domain each time."""
    domain = keep(domains(cells, keep))
    lacking = set(range(len(attributes))) - {r["attr_id"] for r in domain.select("attr_id").distinct().collect()}
    if lacking:
        raise ValueError("no values of attribute " + ", ".join(attributes[k].name for k in sorted(lacking)))
    sim = keep(similar_values(domain, attributes))
    whole = keep(with_norms(domain, sim))
    index = Index(attributes, whole, sim, keep(file_sizes(cells)))
    if most_power >= 0:
        asked = [(a, k) for a, own in enumerate(attributes) for k in range(1 if own.is_constant else most_power + 1)]
        index.powers, index.most_power = keep(powered_base(whole, domain.sparkSession.createDataFrame(asked, "attr_id int, k int"))), most_power
    return index
