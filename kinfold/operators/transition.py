"""One step of the Markov chain, as joins and aggregations over long tables.

Tables: entities (ent_id, attr_id, value_id); parts (ent_id, partition_id); cells (rec_id, file_id, attr_id,
value_id, distorted); links (rec_id, ent_id). Draws are hashes of (seed, iteration, operator, keys).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.draws import bernoulli, categorical, cumulative, draw_from, uniform

from .records import Index

#: collapsed links, collapsed values, sequential
SAMPLERS = {"PCG-I": (False, True, False), "PCG-II": (True, True, False), "Gibbs": (False, False, False), "Gibbs-Sequential": (False, False, True)}


@dataclass
class ChainState:
    iteration: int
    seed: int
    index: Index
    entities: DataFrame
    parts: DataFrame
    cells: DataFrame
    links: DataFrame
    theta: DataFrame
    partitioner: object

    @property
    def constant(self) -> Column:
        """Whether attr_id is an attribute of constant similarity."""
        ids = [k for k, a in enumerate(self.index.attributes) if a.is_constant]
        return F.col("attr_id").isin(*ids) if ids else F.lit(False)


def domain_part(index: Index, value: str, prob: str, norm: str) -> DataFrame:
    return index.domain.select("attr_id", F.col("value_id").alias(value), F.col("prob").alias(prob), F.col("sim_norm").alias(norm))


def sims(index: Index, a: str, b: str) -> DataFrame:
    return index.sim.select("attr_id", F.col("v1").alias(a), F.col("v2").alias(b), "exp_sim")


def by_attribute(rows: DataFrame, key: str, count: int, prefix: str, *columns: str) -> DataFrame:
    """(key, prefix0, prefix1, …): the columns of the key's row of each attribute, as structs; null without one."""
    cell = F.struct(*columns)
    return rows.groupBy(key).agg(*[F.max(F.when(F.col("attr_id") == k, cell)).alias(f"{prefix}{k}") for k in range(count)])


def entity_rows(state: ChainState) -> DataFrame:
    """(ent_id, partition_id, e0, e1, …): an entity in a row, with value y and its norm ny by attribute."""
    rows = state.entities.withColumnRenamed("value_id", "y").join(domain_part(state.index, "y", "py", "ny"), ["attr_id", "y"])
    return by_attribute(rows, "ent_id", len(state.index.attributes), "e", "y", "ny").join(state.parts, "ent_id")


def record_rows(state: ChainState) -> DataFrame:
    """(rec_id, partition_id, r0, r1, …): a record in a row, by attribute its observed value x, whether it is
    sure (not distorted), theta and px. s0, s1, …: exp_sim of x by the other value, unless constant."""
    near = state.index.sim.select("attr_id", F.col("v2").alias("x"), F.struct(F.col("v1"), F.col("exp_sim")).alias("e"))
    near = near.groupBy("attr_id", "x").agg(F.map_from_entries(F.collect_list("e")).alias("sims"))
    cells = state.cells.where("value_id is not null").select("rec_id", "file_id", "attr_id", F.col("value_id").alias("x"), (~F.col("distorted")).alias("sure"))
    rows = cells.join(domain_part(state.index, "x", "px", "nx"), ["attr_id", "x"]).join(state.theta, ["attr_id", "file_id"])
    count = len(state.index.attributes)
    wide = by_attribute(rows, "rec_id", count, "r", "x", "sure", "theta", "px")
    for k, a in enumerate(state.index.attributes):
        if not a.is_constant:
            own = near.where(F.col("attr_id") == k).select(F.col("x").alias(f"x{k}"), F.col("sims").alias(f"s{k}"))
            wide = wide.withColumn(f"x{k}", F.col(f"r{k}.x")).join(own, f"x{k}", "left").drop(f"x{k}")
    # records without an observed value have a row, too
    own = state.links.join(state.parts, "ent_id").select("rec_id", "partition_id")
    return own.join(wide, "rec_id", "left")


def agreeing(state: ChainState) -> Column:
    """Whether an entity's row has all sure values of a record's row."""
    out = F.lit(True)
    for k in range(len(state.index.attributes)):
        out = out & (~F.coalesce(F.col(f"r{k}.sure"), F.lit(False)) | (F.col(f"r{k}.x") == F.col(f"e{k}.y")))
    return out


def likeness(state: ChainState, k: int) -> Column:
    """sim_norm(y) * exp_sim(y, x); 1 for a constant attribute."""
    if state.index.attributes[k].is_constant:
        return F.lit(1.0)
    return F.col(f"e{k}.ny") * F.coalesce(F.element_at(f"s{k}", F.col(f"e{k}.y")), F.lit(1.0))


def total(columns: list[Column]) -> Column:
    out = F.lit(0.0)
    for c in columns:
        out = out + F.coalesce(c, F.lit(0.0))
    return out


def distorted_log_weight(state: ChainState) -> Column:
    """Log of the product over observed distorted attributes of prob(x) times likeness, for a joined row."""
    return total([F.when(~F.col(f"r{k}.sure"), F.log(F.col(f"r{k}.px")) + F.log(likeness(state, k))) for k in range(len(state.index.attributes))])


def collapsed_log_weight(state: ChainState) -> Column:
    """The same over all observed attributes, with the distortions summed out."""
    out = []
    for k in range(len(state.index.attributes)):
        r = lambda name, k=k: F.col(f"r{k}.{name}")
        kept = F.when(r("x") == F.col(f"e{k}.y"), 1 - r("theta")).otherwise(F.lit(0.0))
        out.append(F.when(r("x").isNotNull(), F.log(kept + r("theta") * r("px") * likeness(state, k))))
    return total(out)


def candidate_rows(state: ChainState, ents: DataFrame | None = None, recs: DataFrame | None = None) -> DataFrame:
    """Records' rows with those of the partition's entities that agree with all their sure values; with all of
    the partition's for records without one. A record is looked up by its rarest sure value alone. ents, recs: rows
    in place of entity_rows() and record_rows(), for what needs less of them."""
    ents, recs, count = ents or entity_rows(state), recs or record_rows(state), len(state.index.attributes)
    listed = ents.withColumn("at", F.explode(F.array(*[F.struct(F.lit(k).alias("attr"), F.col(f"e{k}.y").alias("value")) for k in range(count)])))
    sizes = listed.groupBy("partition_id", "at").agg(F.count(F.lit(1)).alias("size"))
    sure = F.filter(F.array(*[F.when(F.col(f"r{k}.sure"), F.struct(F.lit(k).alias("attr"), F.col(f"r{k}.x").alias("value"))) for k in range(count)]), lambda c: c.isNotNull())
    keyed = recs.withColumn("sure", sure)
    ways = keyed.select("rec_id", "partition_id", F.explode("sure").alias("at")).join(sizes, ["partition_id", "at"], "left")
    # a value that no entity has is the rarest of all: it leaves the record without candidates
    rarest = ways.groupBy("rec_id").agg(F.min(F.struct(F.coalesce("size", F.lit(0)).alias("size"), "at")).alias("way")).select("rec_id", F.col("way.at").alias("at"))
    met = recs.join(rarest, "rec_id").join(listed, ["partition_id", "at"]).drop("at").where(agreeing(state))
    free = keyed.where(F.size("sure") == 0).drop("sure").join(ents, "partition_id")
    return met.unionByName(free)


def scanned_rows(state: ChainState) -> DataFrame:
    """Records' rows with those of all entities of their partition."""
    return record_rows(state).join(entity_rows(state), "partition_id")


def candidates(state: ChainState) -> DataFrame:
    """(rec_id, partition_id, ent_id): entities of the record's partition that agree with each of its observed,
    not distorted values; all of the partition's where it has none."""
    count = len(state.index.attributes)
    ents = by_attribute(state.entities.withColumnRenamed("value_id", "y"), "ent_id", count, "e", "y").join(state.parts, "ent_id")
    cells = state.cells.where("value_id is not null").select("rec_id", "attr_id", F.col("value_id").alias("x"), (~F.col("distorted")).alias("sure"))
    own = state.links.join(state.parts, "ent_id").select("rec_id", "partition_id")
    recs = own.join(by_attribute(cells, "rec_id", count, "r", "x", "sure"), "rec_id", "left")
    return candidate_rows(state, ents, recs).select("rec_id", "partition_id", "ent_id")


def draw_link(state: ChainState, rows: DataFrame, log_weight: Column) -> DataFrame:
    """One entity of each record; a pair's weight and its draw are made where the pair is, and only the best of
    each record so far goes on."""
    weighted = rows.select("rec_id", "ent_id", log_weight.alias("lw"))
    return categorical(weighted, ["rec_id"], "ent_id", "lw", uniform(state.seed, state.iteration, "link", "rec_id", "ent_id"))


def links_by_candidates(state: ChainState) -> DataFrame:
    """Link update through the inverted index."""
    return draw_link(state, candidate_rows(state), distorted_log_weight(state))


def links_by_scan(state: ChainState) -> DataFrame:
    """Link update over all entities of the partition: those that contradict a value that isn't distorted have weight 0."""
    return draw_link(state, scanned_rows(state).where(agreeing(state)), distorted_log_weight(state))


def links_collapsed(state: ChainState) -> DataFrame:
    """Link update with the distortions summed out, over all entities of the partition."""
    return draw_link(state, scanned_rows(state), collapsed_log_weight(state))


def linked_cells(state: ChainState) -> DataFrame:
    """(ent_id, attr_id, rec_id, file_id, x, distorted) of observed cells."""
    cells = state.cells.where("value_id is not null").join(state.links, "rec_id")
    return cells.select("ent_id", "attr_id", "rec_id", "file_id", F.col("value_id").alias("x"), "distorted")


def base_draws(state: ChainState, keys: DataFrame) -> DataFrame:
    """keys (ent_id, attr_id, k) with a value of the base distribution, prob * sim_norm ** k."""
    base = state.index.bases(keys)
    cdf = cumulative(base, ["attr_id", "k"], "value_id", "base")
    return draw_from(keys, uniform(state.seed, state.iteration, "base", "ent_id", "attr_id"), cdf, ["attr_id", "k"], "value_id")


def perturbed(state: ChainState, keys: DataFrame, factors: DataFrame) -> DataFrame:
    """(ent_id, attr_id, value_id) in proportion to base_k(v) * exp(lf(v)), lf being 0 outside factors.

    keys: (ent_id, attr_id, k); factors: (ent_id, attr_id, v, lf) with lf >= 0. With W = sum of
    base * (exp(lf) - 1), a value comes from the base with probability 1 / (1 + W), else from what was added.
    """
    base = state.index.bases(keys).withColumnRenamed("value_id", "v")
    added = factors.join(keys, ["ent_id", "attr_id"]).join(base, ["attr_id", "k", "v"])
    # base * expm1(lf) in logs, as products over many records overflow
    log_c = F.log("base") + F.when(F.col("lf") > 30, F.col("lf")).otherwise(F.log(F.expm1("lf")))
    added = added.where("lf > 0").withColumn("lc", log_c)
    top = added.groupBy("ent_id", "attr_id").agg(F.max("lc").alias("m"))
    total = added.join(top, ["ent_id", "attr_id"]).groupBy("ent_id", "attr_id", "m").agg(F.sum(F.exp(F.col("lc") - F.col("m"))).alias("s"))
    # u < 1 / (1 + W), with W = s * exp(m)
    u = uniform(state.seed, state.iteration, "mixture", "ent_id", "attr_id")
    plain = F.log(1 / u - 1) > F.log("s") + F.col("m")
    turned = keys.join(total, ["ent_id", "attr_id"], "left").withColumn("plain", F.coalesce(plain, F.lit(True)))
    kept = base_draws(state, turned.where("plain").select("ent_id", "attr_id", "k"))
    extra = added.join(turned.where("not plain").select("ent_id", "attr_id"), ["ent_id", "attr_id"], "left_semi")
    picked = categorical(extra.withColumnRenamed("v", "value_id"), ["ent_id", "attr_id"], "value_id", "lc", uniform(state.seed, state.iteration, "added", "ent_id", "attr_id", "value_id"))
    return kept.select("ent_id", "attr_id", "value_id").unionByName(picked)


def value_keys(state: ChainState, linked: DataFrame) -> DataFrame:
    """(ent_id, attr_id, k): k observed linked cells, 0 where the base doesn't depend on their number."""
    k = linked.groupBy("ent_id", "attr_id").agg(F.count(F.lit(1)).alias("k"))
    all_keys = state.entities.select("ent_id", "attr_id").join(k, ["ent_id", "attr_id"], "left")
    return all_keys.withColumn("k", F.when(state.constant, F.lit(0)).otherwise(F.coalesce("k", F.lit(0))).cast("int"))


def split_pinned(state: ChainState) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Linked cells; values that a cell that isn't distorted fixes; keys of the rest."""
    linked = linked_cells(state)
    pinned = linked.where("not distorted").groupBy("ent_id", "attr_id").agg(F.min("x").alias("value_id"))
    return linked, pinned, value_keys(state, linked).join(pinned, ["ent_id", "attr_id"], "left_anti")


def values_plain(state: ChainState) -> DataFrame:
    """Value update given the distortions, by perturbing the base."""
    linked, pinned, keys = split_pinned(state)
    near = linked.join(sims(state.index, "x", "v"), ["attr_id", "x"]).groupBy("ent_id", "attr_id", "v").agg(F.sum(F.log("exp_sim")).alias("lf"))
    return pinned.unionByName(perturbed(state, keys, near))


def values_by_scan(state: ChainState) -> DataFrame:
    """Value update given the distortions, over the whole domain of each attribute."""
    linked, pinned, keys = split_pinned(state)
    near = linked.join(sims(state.index, "x", "v"), ["attr_id", "x"]).groupBy("ent_id", "attr_id", "v").agg(F.sum(F.log("exp_sim")).alias("lf"))
    rows = keys.join(domain_part(state.index, "v", "p", "n"), "attr_id").join(near, ["ent_id", "attr_id", "v"], "left")
    rows = rows.select("ent_id", "attr_id", F.col("v").alias("value_id"), (F.log("p") + F.col("k") * F.log("n") + F.coalesce("lf", F.lit(0.0))).alias("lw"))
    return pinned.unionByName(categorical(rows, ["ent_id", "attr_id"], "value_id", "lw", uniform(state.seed, state.iteration, "scan", "ent_id", "attr_id", "value_id")))


def values_collapsed(state: ChainState) -> DataFrame:
    """Value update with the distortions summed out, by perturbing the base."""
    linked = linked_cells(state).join(state.theta, ["attr_id", "file_id"]).join(domain_part(state.index, "x", "px", "nx"), ["attr_id", "x"])
    odds = (1 / F.col("theta") - 1) / F.col("px")
    flat = linked.where(state.constant).select("ent_id", "attr_id", F.col("x").alias("v"), F.log(1 + odds).alias("f"))
    near = linked.where(~state.constant).join(sims(state.index, "x", "v"), ["attr_id", "x"])
    near = near.select("ent_id", "attr_id", "v", F.log(F.col("exp_sim") + F.when(F.col("v") == F.col("x"), odds / F.col("nx")).otherwise(F.lit(0.0))).alias("f"))
    factors = flat.unionByName(near).groupBy("ent_id", "attr_id", "v").agg(F.sum("f").alias("lf"))
    return perturbed(state, value_keys(state, linked), factors)


def distortions(state: ChainState) -> DataFrame:
    """(rec_id, file_id, attr_id, value_id, distorted) given links, values and theta."""
    rows = state.cells.select("rec_id", "file_id", "attr_id", F.col("value_id").alias("x")).join(state.links, "rec_id")
    rows = rows.join(state.entities.withColumnRenamed("value_id", "y"), ["ent_id", "attr_id"]).join(state.theta, ["attr_id", "file_id"])
    rows = rows.join(domain_part(state.index, "x", "px", "nx"), ["attr_id", "x"], "left")
    self_sim = state.index.sim.where("v1 = v2").select("attr_id", F.col("v1").alias("x"), F.col("exp_sim").alias("sxx"))
    rows = rows.join(self_sim, ["attr_id", "x"], "left")
    like = F.when(state.constant, F.lit(1.0)).otherwise(F.col("nx") * F.coalesce("sxx", F.lit(1.0)))
    p1, p0 = F.col("theta") * F.col("px") * like, 1 - F.col("theta")
    p = F.when(F.col("x").isNull(), F.col("theta")).when(F.col("x") != F.col("y"), F.lit(1.0)).otherwise(F.when(p1 + p0 > 0, p1 / (p1 + p0)).otherwise(F.lit(0.0)))
    hit = bernoulli(p, uniform(state.seed, state.iteration, "distortion", "rec_id", "attr_id"))
    return rows.select("rec_id", "file_id", "attr_id", F.col("x").alias("value_id"), hit.alias("distorted"))


def aggregate_distortions(state: ChainState) -> DataFrame:
    """(attr_id, file_id, n): distorted cells, missing ones included."""
    return state.cells.groupBy("attr_id", "file_id").agg(F.count_if("distorted").alias("n"))


def record_distortions(state: ChainState) -> DataFrame:
    """(n_distorted, n): records by the number of their distorted cells."""
    per = state.cells.groupBy("rec_id").agg(F.count_if("distorted").alias("n_distorted"))
    return per.groupBy("n_distorted").agg(F.count(F.lit(1)).alias("n"))


def isolated(state: ChainState) -> DataFrame:
    """One row: n_isolates, entities without a record."""
    return state.parts.join(state.links, "ent_id", "left_anti").agg(F.count(F.lit(1)).alias("n_isolates"))


def log_likelihood(state: ChainState) -> DataFrame:
    """One row: log_likelihood, not normalised: entity values, distorted observed cells, distortion probabilities."""
    dom = domain_part(state.index, "value_id", "p", "n")
    values = state.entities.join(dom, ["attr_id", "value_id"]).agg(F.coalesce(F.sum(F.log("p")), F.lit(0.0)).alias("a"))
    cells = linked_cells(state).where("distorted").join(state.entities.withColumnRenamed("value_id", "y"), ["ent_id", "attr_id"])
    cells = cells.join(domain_part(state.index, "x", "px", "nx"), ["attr_id", "x"]).join(domain_part(state.index, "y", "py", "ny"), ["attr_id", "y"])
    cells = cells.join(sims(state.index, "y", "x"), ["attr_id", "y", "x"], "left")
    like = F.when(state.constant, F.lit(0.0)).otherwise(F.log("ny") + F.log(F.coalesce("exp_sim", F.lit(1.0))))
    second = cells.agg(F.coalesce(F.sum(F.log("px") + like), F.lit(0.0)).alias("b"))
    priors = F.array(*[F.struct(F.lit(k).alias("attr_id"), F.lit(float(a.prior.alpha)).alias("alpha"), F.lit(float(a.prior.beta)).alias("beta")) for k, a in enumerate(state.index.attributes)])
    shapes = state.index.files.select("file_id", "n", F.explode(priors).alias("p")).select("file_id", F.col("n").alias("size"), "p.*")
    terms = shapes.join(state.theta, ["attr_id", "file_id"]).join(aggregate_distortions(state), ["attr_id", "file_id"], "left")
    d = F.coalesce("n", F.lit(0))
    third = terms.agg(F.sum((F.col("alpha") + d - 1) * F.log("theta") + (F.col("beta") + F.col("size") - d - 1) * F.log(1 - F.col("theta"))).alias("c"))
    return values.join(second).join(third).select((F.col("a") + F.col("b") + F.col("c")).alias("log_likelihood"))  # one row each


def draw_theta(state: ChainState) -> DataFrame:
    """(attr_id, file_id, theta) from Beta(alpha + d, beta + n - d); keys are attributes times files, drawn in order."""
    sizes = {r["file_id"]: r["n"] for r in state.index.files.collect()}
    counts = {(r["attr_id"], r["file_id"]): r["n"] for r in aggregate_distortions(state).collect()}
    rng = np.random.default_rng(int(hashlib.md5(f"{state.seed}|{state.iteration}|theta".encode()).hexdigest()[:15], 16))
    rows = []
    for k, a in enumerate(state.index.attributes):
        for f in sorted(sizes):
            d = counts.get((k, f), 0)
            rows.append((k, f, float(rng.beta(a.prior.alpha + d, a.prior.beta + sizes[f] - d))))
    return state.cells.sparkSession.createDataFrame(rows, "attr_id int, file_id string, theta double")


def to_wide(entities: DataFrame) -> DataFrame:
    """(ent_id, values array by attribute)."""
    one = F.array_sort(F.collect_list(F.struct("attr_id", "value_id")))
    return entities.groupBy("ent_id").agg(F.transform(one, lambda s: s["value_id"]).alias("values"))


def place(entities: DataFrame, partitioner) -> DataFrame:
    return to_wide(entities).select("ent_id", partitioner.column("values").alias("partition_id"))


def step(state: ChainState, sampler: str = "PCG-I", keep=lambda df, name: df, theta: DataFrame | None = None) -> ChainState:
    """The next state: theta, links, values, distortions, partitions. keep: writes a table and reads it back.
    theta: probabilities to take in place of drawn ones."""
    if sampler not in SAMPLERS:
        raise ValueError(f"unknown sampler {sampler}")
    collapsed_links, collapsed_values, sequential = SAMPLERS[sampler]
    now = replace(state, iteration=state.iteration + 1)
    now.theta = keep(draw_theta(now), "theta") if theta is None else theta
    link = links_collapsed if collapsed_links else links_by_scan if sequential else links_by_candidates
    now.links = keep(link(now), "links")
    value = values_collapsed if collapsed_values else values_by_scan if sequential else values_plain
    now.entities = keep(value(now), "entities")
    now.cells = keep(distortions(now), "cells")
    now.parts = keep(place(now.entities, now.partitioner), "parts")
    return now


def linkage(state: ChainState) -> DataFrame:
    """(iteration, linkageStructure, partitionId): a row for each partition, isolated entities left out."""
    per = state.links.join(state.parts, "ent_id").groupBy("partition_id", "ent_id").agg(F.array_sort(F.collect_list("rec_id")).alias("c"))
    lists = per.groupBy("partition_id").agg(F.collect_list("c").alias("l"))
    rows = state.parts.select("partition_id").distinct().join(lists, "partition_id", "left")
    empty = F.array().cast("array<array<string>>")
    return rows.select(F.lit(state.iteration).cast("long").alias("iteration"), F.coalesce("l", empty).alias("linkageStructure"), F.col("partition_id").cast("int").alias("partitionId"))
