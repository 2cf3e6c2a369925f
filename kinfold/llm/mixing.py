"""Mixing sources to target weights by soft membership and projected-gradient least squares."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashedwords import BITS, Features, group_sums
from .store import materialize
from .textgrid import Grid, batch_text, pieces

#: Bounds of the training sample: labelled documents of each domain, domains.
SAMPLE_ROWS = 400
DOMAINS = 64
SHARPNESS = 12.0
ROUNDS = 8


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """domain, word (its hash), n of whole texts."""
    for b in batches:
        data, offs = batch_text(b)
        for lo, hi in pieces(offs):
            f = Features(data, offs[lo : hi + 1])
            for k in range(hi - lo):
                word, n = np.unique(f.index[0][f.grid.first[k] : f.grid.first[k + 1]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([b.column("domain")[lo + k].as_py()] * len(word), pa.string()), pa.array(word, pa.int32()), pa.array(n, pa.int64())], names=["domain", "word", "n"])


def fit_domains(docs: DataFrame, labelled: DataFrame, weighted: Iterable[str] = (), sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Domains and their smoothed log word rates, from a bounded sample of the documents that labelled
    (doc_id, domain) names.

    The domains are those of all labelled rows of docs with an id and a domain. Each domain's rows with words of
    least id hash are learnt from, whole texts of any length, by their words' counts. A domain
    of weighted without such a row is an error, unless docs has no labelled row at all; one without weight is left
    out. Texts are read for the sample's ids only.
    """
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), worded.alias("usable"))
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain")).where("doc_id is not null and domain is not null")
    rows = materialize(rows.groupBy("doc_id").agg(F.min("domain").alias("domain")).join(usable, "doc_id").groupBy("doc_id", "domain").agg(F.max("usable").alias("usable")), "labelled")
    found = {r["domain"]: r["usable"] for r in rows.groupBy("domain").agg(F.max("usable").alias("usable")).limit(DOMAINS + 1).collect()}
    if len(found) > DOMAINS:
        raise ValueError(f"more than {DOMAINS} domains")
    names = sorted(d for d, u in found.items() if u)
    lost = sorted(set(weighted) - set(names))
    if found and lost:
        raise ValueError(f"no labelled text to learn these weighted domains from: {', '.join(lost)}")
    counts = np.zeros((len(names), 1 << BITS), np.float64)
    if names:
        picked = None
        for name in names:
            part = rows.where((F.col("domain") == name) & F.col("usable")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
            picked = part if picked is None else picked.unionByName(part)
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
        sample = texts.join(F.broadcast(picked), "doc_id").select("domain", "text")  # sample_rows ids a domain at most
        words = sample.mapInArrow(word_counts, "domain string, word int, n long").groupBy("domain", "word").agg(F.sum("n").alias("n"))
        for part in words.toArrow().to_batches():  # 2**BITS rows a domain at most
            row = np.searchsorted(names, part.column("domain").to_pylist())
            np.add.at(counts, (row, part.column("word").to_numpy()), part.column("n").to_numpy())
    rate = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * (1 << BITS))
    return names, np.log(rate / rate.mean(axis=0)) if names else rate


def memberships(docs: DataFrame, log_rates: np.ndarray, sharpness: float = SHARPNESS) -> DataFrame:
    """doc_id, n_tokens (words) and posterior array<double> of every row of docs.

    The posterior is the softmax of the mean log rate of the text's words times the sharpness, so a
    mixed text keeps shares in several domains; a text without words is in all domains alike.
    """
    table = np.ascontiguousarray(log_rates.T.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = batch_text(b)
            tokens, post = [], []
            for lo, hi in pieces(offs):
                tokens.append(np.diff(Grid(data, offs[lo : hi + 1]).first))
                f = Features(data, offs[lo : hi + 1])
                first = f.grid.first
                sums = np.stack([group_sums(table[:, d][f.index[0]].astype(np.float64), first) for d in range(table.shape[1])], axis=1)
                z = sums / np.maximum(np.diff(first), 1)[:, None] * sharpness
                e = np.exp(z - z.max(axis=1, keepdims=True))
                post.append(e / e.sum(axis=1, keepdims=True))
            t = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            q = np.concatenate(post) if post else np.zeros((0, table.shape[1]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * table.shape[1]), pa.array(q.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(t.astype(np.int64)), lists], names=["doc_id", "n_tokens", "posterior"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>")


def fit_rates(scored: DataFrame, targets: np.ndarray, rounds: int = 40, tolerance: float = 1e-6) -> tuple[DataFrame, np.ndarray]:
    """Adds a nonnegative rate to (…, n_tokens, posterior): minimises the distance between the expected
    domain totals, sum of rate * n_tokens * posterior, and the targets.

    Projected gradient from rate 1 on the residual whitened by the documents' second moments: the step is
    then 1 for any data. A round is one aggregation to as many numbers as there are domains; a row's rate
    follows from the rounds' residuals, so nothing is kept for a row but its rate, written every few rounds.
    """
    size = len(targets)
    share = [F.col("n_tokens") * F.element_at("posterior", d + 1) for d in range(size)]
    moments = scored.agg(*[F.coalesce(F.sum(share[a] * share[b]), F.lit(0.0)) for a in range(size) for b in range(size)]).first()
    inverse = np.linalg.pinv(np.array(moments, float).reshape(size, size))
    now, rate, pending = scored.withColumn("rate", F.lit(1.0)), F.col("rate"), 0
    total = np.zeros(size)
    for k in range(rounds + 1):
        total = np.array(now.agg(*[F.coalesce(F.sum(rate * s), F.lit(0.0)) for s in share]).first(), float)
        gap = total - targets
        if np.abs(gap).max() <= tolerance * max(1.0, np.abs(targets).max()):
            break
        if k == rounds:
            warnings.warn(f"rates miss the targets by {np.abs(gap).max():.6g} tokens after {rounds} rounds", stacklevel=2)
            break
        move = inverse @ gap
        down = sum((s * F.lit(float(m)) for s, m in zip(share, move, strict=True)), F.lit(0.0))
        rate, pending = F.greatest(F.lit(0.0), rate - down), pending + 1
        if pending == ROUNDS:
            now, rate, pending = materialize(now.withColumn("rate", rate), "rates"), F.col("rate"), 0
    return now.withColumn("rate", rate), total


def uniform(*cols) -> F.Column:
    """In [0, 1), from a hash of the columns: the same in any partitioning and after any retry."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit("mixing")), 11).cast("double") / float(1 << 53)


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total: float | None = None) -> DataFrame:
    """doc_id, n_tokens, domain (of largest posterior), posterior, rate, copies for every row of docs.

    weights: target share of each domain's tokens, scaled to sum 1; domains of the labelled table that
    have no weight get 0, and a weighted domain without a labelled text is an error. total: tokens to reach, by default those there are. copies is the rate rounded
    at random by the row's hash, so that expected totals are the targets. Without labelled domains every
    rate is 1. Texts without words have no tokens and keep rate 1; rows that repeat are mixed each.
    """
    names, log_rates = fit_domains(docs, labelled, [d for d, x in weights.items() if x > 0])
    if not names:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")).cast("long").alias("n_tokens"), F.lit(None).cast("string").alias("domain"), F.array().cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
    scored = materialize(memberships(docs, log_rates), "memberships")
    there = float(scored.agg(F.sum("n_tokens")).first()[0] or 0)
    w = np.array([weights.get(n, 0.0) for n in names], float)
    if w.sum() <= 0:
        raise ValueError("no domain has a target weight")
    rated, _ = fit_rates(scored, w / w.sum() * (there if total is None else total))
    best = F.element_at(F.array(*map(F.lit, names)), F.array_position("posterior", F.array_max("posterior")).cast("int"))
    whole = F.floor("rate")
    copies = (whole + (uniform("doc_id") < F.col("rate") - whole).cast("int")).cast("int")
    return rated.select("doc_id", "n_tokens", best.alias("domain"), "posterior", "rate", copies.alias("copies"))


def resample(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total: float | None = None) -> DataFrame:
    """The rows of docs, each as many times as mix() gives copies, with their columns.

    Rows that repeat a doc_id are all repeated as often as the one with most copies.
    """
    key, times, copy = (name + "_".join(docs.columns) for name in ("id_", "times_", "copy_"))  # unlike any column
    mixed = mix(docs, labelled, weights, total).where("copies > 0").groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(times))
    rows = docs.join(mixed, docs["doc_id"].cast("long").eqNullSafe(mixed[key])).select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy))
    return rows.drop(copy)
