"""Near-duplicates: texts that stay where they are, and links contracted by tasks."""

import numpy as np

from kinfold.llm import graph, minhash


def by_hand(links):
    least = {}
    for a, b in links:
        least.setdefault(a, a), least.setdefault(b, b)
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_texts_are_not_exchanged(spark):
    docs = spark.range(0, 1000, 1, 4).selectExpr("id as doc_id", "concat('text ', id) as text")
    ids = spark.range(0, 2000, 7).withColumnRenamed("id", "id")
    found = minhash.with_ids(docs, ids)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    want = [(k, f"text {k}") for k in range(0, 1000, 7)]
    assert sorted(map(tuple, found.collect())) == want == sorted(map(tuple, minhash.with_ids(docs, ids, 10).collect()))


def test_stars_by_hand():
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(400, 500)]
    a, b = np.array(links).T
    node, low = graph.stars(a, b)
    assert {**{x: x for x in by_hand(links)}, **dict(zip(node.tolist(), low.tolist(), strict=True))} == by_hand(links)


def test_components_take_few_steps(spark, monkeypatch):
    """A long chain of links in few tables; also where tasks hold few links at a time."""
    links = [(k, k + 1) for k in range(300)] + [(1000, 1001), (1002, 1001)]
    df, made, write = spark.createDataFrame(links, "a long, b long"), [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda t, name: made.append(name) or write(t, name))
    want = by_hand(links)
    assert {r["id"]: r["component_id"] for r in graph.components(df.coalesce(1)).collect()} == want
    assert len(made) <= 4
    monkeypatch.setattr(graph, "LOCAL_ROWS", 5)
    assert {r["id"]: r["component_id"] for r in graph.components(df).collect()} == want


def test_a_step_of_components_joins_once(spark, monkeypatch):
    """Each half of a step takes its smallest neighbours from 2 joins, not from copies of the half before."""
    plans, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda t, name: plans.append(t._jdf.queryExecution().optimizedPlan().toString()) or write(t, name))
    links = [(k, k + 1) for k in range(50)] + [(7, 7), (None, 3), (90, 80)]
    got = graph.components(spark.createDataFrame(links, "a long, b long"))
    assert {r["id"]: r["component_id"] for r in got.collect()} == {**dict.fromkeys(range(51), 0), 90: 80, 80: 80}
    assert [p.count("Join Inner") for p in plans[1:]] == [2] * (len(plans) - 1)
