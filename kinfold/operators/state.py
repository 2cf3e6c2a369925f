"""Initial states of the chain, and states on disk."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinfold.functions.draws import cumulative, draw_from, uniform
from kinfold.sources import tables

from .records import Attribute, Index, build_index, encode, prior_theta, to_cells
from .transition import ChainState, place, to_wide


def numbered(cells: DataFrame, digits: int = 2) -> DataFrame:
    """(rec_id, pos): records numbered from 0 by salt (first hex digits of the id's md5) and id; a window holds
    one salt's records only, 16 ** digits salts in all."""
    recs = cells.where("attr_id = 0").select("rec_id", F.substring(F.md5("rec_id"), 1, digits).alias("salt"))
    sizes = recs.groupBy("salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("salt", (F.sum("n").over(Window.orderBy("salt")) - F.col("n")).alias("before"))  # a row a salt
    inside = F.row_number().over(Window.partitionBy("salt").orderBy("rec_id")) - 1
    return recs.withColumn("inside", inside).join(F.broadcast(before), "salt").select("rec_id", (F.col("before") + F.col("inside")).cast("long").alias("pos"))


def initial_tables(encoded: DataFrame, index: Index, seed: int, population: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entities, links and cells before the first step.

    Entity i takes the values of record i; records beyond the population are linked with entity pos mod
    population. Missing values, and all values of entities without a record, are drawn from the domains'
    probabilities. A cell is distorted where it is observed and differs from its entity's value.
    """
    order = numbered(encoded)
    count = order.count()
    size = population or count
    links = order.select("rec_id", (F.col("pos") % size).alias("ent_id"))
    firsts = order.where(F.col("pos") < size).select("rec_id", F.col("pos").alias("ent_id"))
    own = encoded.join(firsts, "rec_id").select("ent_id", "attr_id", "value_id")
    if size > count:
        attrs = F.explode(F.sequence(F.lit(0), F.lit(len(index.attributes) - 1)))
        own = own.unionByName(encoded.sparkSession.range(count, size).select(F.col("id").alias("ent_id"), attrs.alias("attr_id"), F.lit(None).cast("int").alias("value_id")))
    cdf = cumulative(index.domain, ["attr_id"], "value_id", "prob")
    drawn = draw_from(own.where("value_id is null").select("ent_id", "attr_id"), uniform(seed, 0, "initial", "ent_id", "attr_id"), cdf, ["attr_id"], "value_id")
    entities = own.where("value_id is not null").unionByName(drawn.select("ent_id", "attr_id", "value_id"))
    met = encoded.join(links, "rec_id").join(entities.withColumnRenamed("value_id", "y"), ["ent_id", "attr_id"])
    cells = met.select("rec_id", "file_id", "attr_id", "value_id", F.coalesce(F.col("value_id") != F.col("y"), F.lit(False)).alias("distorted"))
    return entities, links, cells


def initial_state(df: DataFrame, attributes: list[Attribute], partitioner, seed: int, rec_id: str = "rec_id", file_id: str | None = None, population: int | None = None, keep=tables.keep, most_power: int = -1) -> ChainState:
    cells = keep(to_cells(df, attributes, rec_id, file_id))
    index = build_index(cells, attributes, keep, most_power)
    encoded = keep(encode(cells, index.domain))
    entities, links, cells = initial_tables(encoded, index, seed, population)
    entities, links, cells = keep(entities), keep(links), keep(cells)
    partitioner.fit(to_wide(entities))
    parts = keep(place(entities, partitioner))
    return ChainState(0, seed, index, entities, parts, cells, links, keep(prior_theta(index.files, attributes)), partitioner)


TABLES = ("entities", "parts", "cells", "links", "theta")
INDEX = ("domain", "sim", "files", "powers")


def save_state(state: ChainState, path: str) -> ChainState:
    """Saves the chain's tables, the index and the fitted partitioner; returns the state as it is saved.

    state.json is written last and put in place at once, so that path holds the old state or the new one; then
    the folders that it doesn't name go. The index is saved once a chain.
    """
    spark = state.cells.sparkSession
    own = f"{state.iteration}-{uuid.uuid4().hex[:8]}"
    for name in TABLES:
        getattr(state, name).write.parquet(f"{path}/{own}/{name}")
    index = state.index
    if index.folder is None or not index.folder.startswith(f"{path}/"):
        index.folder = f"{path}/index-{uuid.uuid4().hex[:8]}"
        for name in INDEX:
            if getattr(index, name) is not None:
                getattr(index, name).write.parquet(f"{index.folder}/{name}")
    shared = index.folder.rsplit("/", 1)[1]
    said = {
        "iteration": state.iteration, "seed": state.seed, "tables": own, "index": shared, "powers": index.powers is not None, "mostPower": index.most_power,
        "attributes": [str(a) for a in index.attributes], "partitioner": state.partitioner.fitted(),
    }
    tables.write_lines(spark, json.dumps(said), f"{path}/state.json.new")
    tables.rename(spark, f"{path}/state.json.new", f"{path}/state.json")
    for name in tables.children(spark, path):
        if name not in ("state.json", own, shared) and not name.startswith("."):
            tables.remove(spark, f"{path}/{name}")
    return load_state(spark, path, index.attributes, state.partitioner)


def load_state(spark: SparkSession, path: str, attributes: list[Attribute], partitioner) -> ChainState | None:
    """The saved state, or None; index and partitioner come from the files, and no record is read."""
    if not tables.exists(spark, f"{path}/state.json"):
        return None
    said = json.loads(tables.read_lines(spark, f"{path}/state.json"))
    if said["attributes"] != [str(a) for a in attributes]:
        raise ValueError("the saved state is of other attributes")
    folder = f"{path}/{said['index']}"
    kept = {name: spark.read.parquet(f"{folder}/{name}") for name in INDEX if name != "powers" or said["powers"]}
    index = Index(attributes, **kept, most_power=said["mostPower"], folder=folder)
    own = {name: spark.read.parquet(f"{path}/{said['tables']}/{name}") for name in TABLES}
    return ChainState(said["iteration"], said["seed"], index, partitioner=partitioner.restore(said["partitioner"]), **own)
