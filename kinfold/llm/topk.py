"""Exact top-k search by inner product with block-at-a-time pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_EXACT = 2.0**53
_MOST = 2**63 - 1
_NONE = np.iinfo(np.int64).min


def quantize(emb: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(id long, v array<double>): floor(scale * x) of each component.

    Vectors that are null or hold a null or non-finite component, and null ids, take no part. A product
    beyond double's range counts as its end. Of rows that repeat an id, the one whose integer vector sorts
    last stands for it.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = F.col(vector)
    whole = emb.where(F.col(key).isNotNull() & v.isNotNull()).where(F.forall(v, lambda x: F.coalesce(finite(x), F.lit(False))))
    end = F.lit(np.finfo(np.float64).max.item())
    scaled = F.transform(v, lambda x: F.greatest(F.least(F.lit(float(scale)) * x.cast("double"), end), -end))
    # from 2**52 on a double is whole, and may be beyond long's range
    parts = F.transform(scaled, lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y))
    return whole.select(F.col(key).cast("long").alias("id"), parts.alias("v")).groupBy("id").agg(F.max("v").alias("v"))


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as int64, exact; beyond its range, its ends (the least value is kept for "none")."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = q @ x.T
        large = np.abs(q).sum(axis=1)[:, None] * (np.abs(x).max(axis=1, initial=0))[None, :] >= _EXACT
    out = np.where(large, 0, s).astype(np.int64)
    for i, j in zip(*np.nonzero(large), strict=True):
        exact = sum(int(a) * int(b) for a, b in zip(q[i], x[j], strict=True))
        out[i, j] = max(-_MOST, min(_MOST, exact))
    return out


def score_group(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query position, candidate id, score) of each query's k best of `least` or more in one group of
    candidates, and how many (query, block) pairs were scored.

    Candidates are cut into ranges of ids. A range's bound for a query is the sum over the components of
    the largest product that any of its members can give. Queries go through the ranges by falling bound
    and leave when the next bound is below their k-th score (an equal bound may still hold a smaller id).
    Bounds from 2**53 on aren't exact and prune nothing.
    """
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    starts = np.arange(0, len(ids), block)
    high, low = np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        wide = np.abs(q).sum(axis=1)[:, None] * np.maximum(np.abs(high).max(axis=1, initial=0), np.abs(low).max(axis=1, initial=0))[None, :]
    bound = np.where(wide < _EXACT, bound, np.inf)
    turn = np.argsort(-bound, axis=1, kind="stable")
    best_s = np.full((len(q), k), _NONE)
    best_i = np.full((len(q), k), np.iinfo(np.int64).max)
    live, scored = np.arange(len(q)), 0
    for r in range(len(starts)):
        live = live[bound[live, turn[live, r]] >= np.maximum(best_s[live, -1], least[live])]
        if not len(live):
            break
        at = turn[live, r]
        scored += len(live)
        for b in np.unique(at):
            rows = live[at == b]
            own = ids[starts[b] : starts[b] + block]
            s = inner(q[rows], x[starts[b] : starts[b] + block])
            s[(q_ids[rows][:, None] == own[None, :]) | (s < least[rows][:, None])] = _NONE
            s = np.concatenate([best_s[rows], s], axis=1)
            i = np.concatenate([best_i[rows], np.broadcast_to(own, (len(rows), len(own)))], axis=1)
            top = np.lexsort((i, ~s), axis=1)[:, :k]  # ~s falls as s rises, without overflow
            best_s[rows], best_i[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
    qi, rank = np.nonzero(best_s != _NONE)
    return qi, best_i[qi, rank], best_s[qi, rank], scored


def top_k(emb: DataFrame, k: int = 20, every: int = 20, group_rows: int = 8192, block: int = 256, query_rows: int = 512, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by `every`; candidates every row but the query's own.
    Blocks of queries meet groups of candidates, both of bounded size. Each block of queries meets one
    group first; the k-th scores found there bound all other groups from below, and only scores that
    reach them go on. Vectors of unlike lengths are compared within their length only; empty ones score 0 with
    each other. Scores beyond long's range count as its ends. An empty table gives no rows.
    """
    found = scored_pairs(emb, k, every, group_rows, block, query_rows, scale).where("vec_id is not null")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scored_pairs(emb: DataFrame, k: int, every: int, group_rows: int, block: int, query_rows: int, scale: int = 64) -> DataFrame:
    """query_id, vec_id, score of what can be among the k best; a row of nulls for each pair of blocks, with
    how many (query, range of candidates) there were (ranges) and how many were scored."""
    parts = quantize(emb, scale=scale).withColumn("dim", F.size("v"))
    total = parts.count()
    groups, batches = max(1, -(-total // group_rows)), max(1, -(-total // (every * query_rows)))
    spread = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    cand = parts.withColumn("g", spread(groups)).groupBy("g", "dim").agg(F.collect_list(F.struct("id", "v")).alias("c"))
    query = parts.where(F.col("id") % every == 0).withColumn("b", spread(batches))
    first = F.pmod(F.xxhash64("b"), F.lit(groups)).cast("int")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for q, c in zip(f["q"], f["c"], strict=True):
                q_ids, ids, least = (np.array([r[n] for r in rows], np.int64) for rows, n in ((q, "id"), (c, "id"), (q, "least")))
                qv, cv = (np.array([r["v"] for r in rows], np.float64).reshape(len(rows), -1) for rows in (q, c))
                qi, vec, score, scored = score_group(q_ids, qv, least, ids, cv, k, block)
                yield pd.DataFrame({"query_id": q_ids[qi], "vec_id": vec, "score": score, "ranges": 0, "scored": 0})
                yield pd.DataFrame({"query_id": [None], "vec_id": [None], "score": [None], "ranges": [len(q) * -(-len(ids) // block)], "scored": [scored]})

    def met(queries: DataFrame, group, n: int) -> DataFrame:
        rows = queries.groupBy("b", "dim").agg(F.collect_list(F.struct("id", "v", "least")).alias("q")).withColumn("g", group)
        pairs = rows.join(cand, ["g", "dim"]).select("q", "c")
        return pairs.repartition(max(1, min(n, 4096))).mapInPandas(run, "query_id long, vec_id long, score long, ranges long, scored long")

    seed = met(query.withColumn("least", F.lit(_NONE)), first, batches).where("vec_id is not null")
    # a query's own k-th score in the first group; none where the group holds fewer
    seed = seed.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    bounded = query.join(seed, F.col("id") == F.col("query_id"), "left").withColumn("least", F.coalesce("least", F.lit(_NONE)))
    return met(bounded, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))), groups * batches)


def pruning(emb: DataFrame, k: int = 20, every: int = 20, group_rows: int = 8192, block: int = 256, query_rows: int = 512) -> tuple[int, int]:
    """How many pairs of a query and a range of candidates the search has, and how many of them it scores."""
    r = scored_pairs(emb, k, every, group_rows, block, query_rows).agg(F.sum("ranges"), F.sum("scored")).first()
    return int(r[0] or 0), int(r[1] or 0)
