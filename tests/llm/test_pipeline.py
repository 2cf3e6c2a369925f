from collections import Counter, defaultdict

from brute import components, crc, token_ids
from test_models import brute_scan

import corpus_pipeline as P
from kinfold.llm import mixing, packing, secrets, toxicity
from kinfold.llm.queries import LANGUAGE_WEIGHTS, language_labels
from kinfold.llm.store import materialize


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    text = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    columns, seen = docs.columns, [docs]
    for name, stage in P.STAGES[:-1]:
        seen.append(materialize(stage(spark, seen[-1], sf), name))
        assert seen[-1].columns == columns
    tox, near, sec, mixed = seen[1:]
    bad = {r["doc_id"] for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    assert set(text(tox)) == set(text(docs)) - bad
    groups = components(list(text(tox).items()))
    assert set(text(near)) == {d for d, (_, c) in groups.items() if c == d}
    forest = secrets.train_forest(secrets.labelled_findings(spark))
    before, after = text(near), text(sec)
    assert set(before) == set(after)
    for d, t in before.items():
        hits = [c for _, c, s in brute_scan(t, forest) if s >= 0.5]
        assert after[d].count("[SECRET]") == len(hits) and (hits or after[d] == t)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(sec, language_labels(sec, labels), LANGUAGE_WEIGHTS).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == {d: n for d, n in copies.items() if n}
    rows = P.STAGES[-1][1](spark, mixed, sf).collect()
    want = dict(zip(after, token_ids(after.values(), packing.vocabulary_path())))
    pieces, sequences = Counter(), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids_crc32"] == crc(want[r["doc_id"]][r["start"] : r["start"] + r["length"]])
    assert pieces == {d: n * len(want[d]) for d, n in copies.items() if n}
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048


def test_run(spark, sf):
    assert {"doc_id", "sequence_id", "offset"} <= set(P.run(spark, sf).columns)
