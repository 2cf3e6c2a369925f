import math
import random

from kinfold.llm import topk as T


def brute(rows, k, every):
    one = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            v = [math.floor(64 * x) if abs(64 * x) < 2**52 else int(64 * x) for x in v]
            one[i] = max(one.get(i, v), v)
    clip = lambda s: max(1 - 2**63, min(2**63 - 1, s))
    out = []
    for q in sorted(i for i in one if i % every == 0):
        s = sorted((-clip(sum(a * b for a, b in zip(one[q], one[c]))), c) for c in one if c != q and len(one[c]) == len(one[q]))[:k]
        out += [(q, n + 1, c, -x) for n, (x, c) in enumerate(s)]
    return out


def test_huge_empty_repeated_and_null_ids(spark):
    r = random.Random(7)
    some = lambda n: [r.choice([0.0, 1.0, -0.3, 1e9, -2.0**30, 1e-9, 3e15, -1e17, r.random()]) for _ in range(n)]
    rows = [(i, some(2)) for i in range(60)] + [(100 + i, []) for i in range(25)] + [(20, some(2)), (21, some(2)), (None, some(2)), (200, [1e300, -1e300]), (220, [1e9, 1.0]), (240, some(5)), (241, some(5))]
    df = spark.createDataFrame([(*x, "c") for x in rows], "vec_id long, embedding array<double>, id string")
    for group_rows, block in ((16, 4), (1000, 256)):
        assert sorted(map(tuple, T.top_k(df, k=5, group_rows=group_rows, block=block, query_rows=2).collect())) == brute(rows, 5, 20)


def test_ranges_are_pruned(spark):
    """Vectors of many lengths: ranges of short ones can't reach the k-th score of the first group."""
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) * (20 if i < 64 else 0.1) for _ in range(4)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ranges, scored = T.pruning(df, k=5, every=50, group_rows=500, block=16)
    assert 0 < scored < ranges / 2
    assert T.pruning(df.limit(0)) == (0, 0)
