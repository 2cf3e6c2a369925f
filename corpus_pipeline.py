"""The corpus pipeline: stages that are each written and read again.

Each stage takes and (but for the last) returns the columns of documents and works on all that its
predecessor kept. Rows with a null doc_id pass every stage; rows that repeat a doc_id stay or go together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import minhash, mixing, packing, secrets, toxicity
from kinfold.llm.queries import LANGUAGE_WEIGHTS, language_labels, table
from kinfold.llm.store import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id stays of each group of near-duplicates."""
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; no document goes."""
    keys, values = secrets.train_forest(secrets.labelled_findings(spark)), secrets.train_values(secrets.assigned_findings(spark))
    return secrets.redact(docs, keys, values_forest=values)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out at the rates that bring the languages' tokens to their weights."""
    return mixing.resample(docs, language_labels(docs, table(spark, sf_dir, "labels")), LANGUAGE_WEIGHTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in training sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_languages),
    ("packing", pack_sequences),
]

#: Models and tokenizers can't be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
