"""Scans and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CHAIN_SCHEMA = "iteration long, linkageStructure array<array<string>>, partitionId int"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, local mode takes a temporary folder;
    on a cluster, whose nodes don't share one, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="kinfold-")
    return "file://" + _own[app]


def keep(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df in the shared folder and reads it back: short plans, and nothing to lose with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kinfold-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that a run needs for a while, in one folder of its own.

    A call writes a table and reads it back. step() opens the next generation and removes the one that is `most`
    older; generation 0, which holds what all steps read, stays until close().
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, most: int = 3) -> None:
        if most < 2:
            raise ValueError("a step reads the generation before")
        self.spark, self.most, self.generation = spark, most, 0
        self.root = f"{(folder or shared_dir(spark)).rstrip('/')}/kinfold-run-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.root}/{self.generation}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def step(self) -> None:
        self.generation += 1
        if self.generation > self.most:
            remove(self.spark, f"{self.root}/{self.generation - self.most}")

    def close(self) -> None:
        remove(self.spark, self.root)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if there is no such folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Moves a file within its file system, onto whatever is at the target."""
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(b):
        fs.delete(b, True)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"can't move {source} to {target}")


def copy(spark: SparkSession, source: str, target: str, overwrite: bool = False, delete_source: bool = False) -> bool:
    """Copies a file or folder between file systems; False if the source isn't there, or the target is and stays."""
    conf, hadoop = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs
    a, b = hadoop.Path(source), hadoop.Path(target)
    fa, fb = a.getFileSystem(conf), b.getFileSystem(conf)
    if not fa.exists(a) or fb.exists(b) and not overwrite:
        return False
    if fb.exists(b):
        fb.delete(b, True)
    return bool(hadoop.FileUtil.copy(fa, a, fb, b, delete_source, True, conf))


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, null_value: str = "") -> DataFrame:
    """A CSV file with a header, all strings, malformed rows dropped, one text standing for null.

    columns: the header's names if known, which saves reading the file for them.
    """
    reader = spark.read.option("header", True).option("nullValue", null_value).option("mode", "DROPMALFORMED")
    if columns is None:
        return reader.csv(path)
    return reader.schema(StructType([StructField(c, StringType()) for c in columns])).csv(path)


def read_chain(spark: SparkSession, path: str, from_iteration: int = 0) -> DataFrame | None:
    """A saved linkage chain from an iteration on; None if there is none or nothing is left."""
    if not exists(spark, path):
        return None
    chain = spark.read.schema(CHAIN_SCHEMA).parquet(path).where(F.col("iteration") >= from_iteration)
    return None if chain.isEmpty() else chain


def write_chain(chain: DataFrame, path: str, append: bool) -> None:
    chain.write.partitionBy("partitionId").mode("append" if append else "overwrite").parquet(path)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster) from text lines of record ids with commas between."""
    parts = F.transform(F.split("value", ","), lambda x: F.trim(x))
    return spark.read.text(path).select(F.array_sort(F.array_distinct(parts)).alias("cluster"))


def write_clusters(clusters: DataFrame, path: str, overwrite: bool = True) -> None:
    """One line a cluster, ids joined by ", "; without overwrite an existing folder stays as it is."""
    clusters.select(F.array_join("cluster", ", ").alias("value")).write.mode("overwrite" if overwrite else "ignore").text(path)


def read_lines(spark: SparkSession, path: str) -> str:
    """A whole small text file."""
    return spark.read.text(path, wholetext=True).first()[0]


def write_lines(spark: SparkSession, text: str, path: str) -> None:
    """A small text file of that very name, written through the path's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def append_csv(spark: SparkSession, rows: list[tuple], header: list[str], path: str) -> None:
    """Appends rows to one small CSV file; its header is written once. A new file takes the old one's place, so
    that a reader finds whole rows only."""
    text = read_lines(spark, path) if exists(spark, path) else ",".join(header) + "\n"
    write_lines(spark, text + "".join(",".join(map(str, r)) + "\n" for r in rows), f"{path}.new")
    rename(spark, f"{path}.new", path)


def one_file(frame: DataFrame, path: str, kind: str, empty: str) -> None:
    """The frame's one partition as a file of that very name; `empty` is the text of a frame that writes none."""
    spark, folder = frame.sparkSession, f"{path}-{uuid.uuid4().hex}"
    frame.write.option("header", True).format(kind).save(folder)
    parts = [n for n in children(spark, folder) if n.startswith("part-")]
    if parts:
        rename(spark, f"{folder}/{parts[0]}", path)
    else:
        write_lines(spark, empty, path)
    remove(spark, folder)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file of that very name, with a header, for tables of a row a sample; rows keep their order."""
    one_file(df.coalesce(1), path, "csv", ",".join(df.columns) + "\n")


def write_csv_lines(lines: DataFrame, order: str, path: str) -> None:
    """The same from lines (order, value), the header's order being null: for tables too wide for columns."""
    one_file(lines.repartition(1).sortWithinPartitions(F.col(order).asc_nulls_first()).select("value"), path, "text", "")
