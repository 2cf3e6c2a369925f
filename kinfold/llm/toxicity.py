"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashedwords import BITS, Features, group_sums
from .store import release
from .textgrid import batch_text, pieces

#: Bounds of the training sample: rows of each label, and bytes of all its texts.
SAMPLE_ROWS = 2500
SAMPLE_BYTES = 16_000_000
#: Text whose features are made at a time in training.
TRAIN_BYTES = 500_000


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def train(texts: list[bytes], y: np.ndarray, share: np.ndarray, steps: int = 150, rate: float = 0.15, l1: float = 2e-5, bias: float = -8.0, least: int = 6, lift: float = 3.0) -> Model:
    """Maximises the documents' weighted log-likelihood under P = 1 - prod(1 - p_sentence), with an L1 penalty.

    The gradient for a sentence's logit is p * (1 - P) / P in a positive document and -p in a negative
    one: the sentences that explain a positive label get the credit. share: weight of each document.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    hold = np.zeros((2, 1 << BITS), np.int32)  # documents of each label that hold a feature
    parts, owners, n = [], [], 0
    for lo, hi in pieces(offs, TRAIN_BYTES):
        f = Features(data, offs[lo : hi + 1])
        for k, (a, e) in enumerate(zip(f.grid.first[:-1], f.grid.first[1:], strict=True)):
            hold[y[lo + k], np.unique(f.index[:, a:e])] += 1
        of_word = n + np.repeat(np.arange(len(f.sentence), dtype=np.int32), np.diff(np.append(f.sentence, f.index.shape[1])))
        parts.append((f.index, of_word))
        owners.append(lo + np.repeat(np.arange(hi - lo), np.diff(f.doc)))
        n += len(f.sentence)
    of_doc = np.concatenate(owners)
    # what a few documents hold can't be told from those documents; what clean ones hold as often says nothing
    common = (hold[1] >= least) & (hold[1] / max(1, (y == 1).sum()) > lift * (hold[0] + 0.5) / max(1, (y == 0).sum()))
    places = [np.nonzero(common[index]) for index, _ in parts]
    of_sentence = np.concatenate([of_word[w] for (_, of_word), (_, w) in zip(parts, places, strict=True)]).astype(np.int64)
    names, index = np.unique(np.concatenate([index[at] for (index, _), at in zip(parts, places, strict=True)]), return_inverse=True)
    w, b = np.zeros(len(names)), bias
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(of_sentence, w[index], n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(of_doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(texts))
        some = -np.expm1(none)
        credit = np.where(y == 1, np.exp(none) / np.maximum(some, 1e-12), -1.0) * share
        g = p * credit[of_doc]
        grad = np.append(np.bincount(index, g[of_sentence], len(names)), g.sum()) / share.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w + step[:-1], b + step[-1]
        shrink = rate * l1 / (np.sqrt(v[:-1] / (1 - 0.99**t)) + 1e-8)
        w = np.maximum(w - shrink, 0)  # words only add to a sentence's toxicity
        b = min(b, bias)  # a sentence of unknown words stays innocent, however many a text has
    full = np.zeros(1 << BITS)
    full[names] = w
    return Model(full, float(b))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Trains on at most sample_rows labelled rows of each label, those of least id hash, whose whole texts
    come to sample_bytes at most: a text that would go beyond is passed over, whatever its length.

    Rows held out and null labels take no part in training. A document whose label rows disagree counts as
    toxic; of rows that repeat a doc_id the text that sorts last is taken. Weights restore the labels' shares
    over the whole table.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    sample = texts.join(F.broadcast(picked), "doc_id")  # 2 * sample_rows ids at most
    sizes = sample.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("n"), F.xxhash64("doc_id").alias("h")).collect()
    fit_in, left = [], sample_bytes
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if r["n"] <= left:
            left -= r["n"]
            fit_in.append((r["doc_id"],))
    within = docs.sparkSession.createDataFrame(fit_in, "doc_id long")
    rows = sample.join(F.broadcast(within), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    # copies of one text say no more than one of them
    once = {r["text"]: r["toxic"] for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))}
    y = np.array(list(once.values()), np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS), -8.0)
    share = np.array([totals[c] / max(1, (y == c).sum()) for c in (0, 1)])[y]
    model = train([t.encode() for t in once], y, share * len(y) / share.sum())
    del rows, once
    release(docs.sparkSession)
    return model


def sentence_scores(f: Features, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Each sentence's probability, and each document's: the noisy-or of its sentences."""
    z = model.bias + f.sums(model.weights)
    total = -np.expm1(group_sums(-np.logaddexp(0, z), f.doc))
    return 1 / (1 + np.exp(-np.clip(z, -700, 700))), np.clip(total, 0.0, 1.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_sentences, n_offending (sentences of 0.5 or more), worst_start, worst_end, worst_score.

    worst_*: bytes of the sentence of highest score, from its first word to the end of its last; null
    without words. A null, empty or wordless text scores 0. One row for each row of docs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = batch_text(b)
            cols: list[list] = [[] for _ in range(6)]
            for lo, hi in pieces(offs):
                f = Features(data, offs[lo : hi + 1])
                p, total = sentence_scores(f, model)
                bad = group_sums((p >= 0.5).astype(float), f.doc)
                ends = np.append(f.sentence[1:], f.index.shape[1]) - 1
                for k in range(hi - lo):
                    a, e = f.doc[k], f.doc[k + 1]
                    worst = a + int(np.argmax(p[a:e])) if e > a else None
                    base = f.grid.offs[k]
                    row = (float(total[k]), int(e - a), int(bad[k]), *((None,) * 3 if worst is None else (int(f.grid.start[f.sentence[worst]] - base), int(f.grid.end[ends[worst]] - base), float(p[worst]))))
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            kinds = [pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "score", "n_sentences", "n_offending", "worst_start", "worst_end", "worst_score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, n_sentences long, n_offending long, worst_start long, worst_end long, worst_score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentence of every row of docs.

    Labels are learnt only from documents whose crc32 of the id's text isn't divisible by 5; only the text
    is scored. A null doc_id isn't held out. Without labels of both kinds every score is near 0.
    """
    s = score(docs, fit(docs, labels))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_sentences", "n_offending", "worst_start", "worst_end", "worst_score")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with their columns: scores stay beside their row."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = batch_text(b)
            clean = []
            for lo, hi in pieces(offs):
                f = Features(data, offs[lo : hi + 1])
                clean.append(sentence_scores(f, model)[1] < 0.5)
            yield b.filter(pa.array(np.concatenate(clean) if clean else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
