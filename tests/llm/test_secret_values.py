import hashlib

import numpy as np
import pytest
from test_first_ops import frame

import corpus_pipeline as P
from kinfold.llm import queries as Q
from kinfold.llm import secrets

SECRETS = [
    ("password={}", "correcthorsebattery"), ('api_key: "{}"', "kQzVbWmXnRtYpLsDfGhJ"), ("pwd={}", "hunter2"), ('password="{}"', "P@ssw0rd!2024"),
    ("password={}", "Tr0ub4dor&3"), ("secret: '{}'", "qWmXnRtYpLsD"), ('{{"password": "{}"}}', "zebra%lamp#42"),
]
PLAIN = ["password: required", "the password is incorrect", "key: patience", "token = None", "password = os.environ.get('X')", "api_key: ${API_KEY}", "Key: value of the day", "token: string"]


@pytest.fixture(scope="module")
def docs():
    own = [(i, f"We set {form.format(value)} in the file, and more.") for i, (form, value) in enumerate(SECRETS)]
    odd = [(200, None), (201, ""), (202, "\x01!\x01- and password=hunter2 \x01!"), (203, f"{own[0][1]} commit abcdef12 {own[2][1]}"), (203, own[1][1])]
    return own + [(100 + i, f"We saw {t} in the file.") for i, t in enumerate(PLAIN)] + odd


def test_values_without_digits_and_with_marks(spark, docs, tmp_path):
    frame(spark, docs).select("doc_id", "text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = Q.op8_secrets(spark, str(tmp_path)).collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {(r["doc_id"], r["secret_sha256"]) for r in rows}
    first = [s for _, s in SECRETS]
    assert {g for g in got if g[0] < 100} == {(i, digest(s)) for i, s in enumerate(first)}
    assert not [g for g in got if 100 <= g[0] < 202]
    assert {g for g in got if g[0] >= 202} == {(202, digest("hunter2")), *[(203, digest(first[k])) for k in (0, 1, 2)]}
    assert sorted(r["ordinal"] for r in rows if r["doc_id"] == 203) == [0, 0, 2]
    clean = {(r["doc_id"], r["text"]) for r in P.mask_secrets(spark, frame(spark, docs), str(tmp_path)).collect()}
    want = set()
    for d, t in docs:
        for s in first if d < 100 or d >= 200 else []:
            t = t and t.replace(s, "[SECRET]")
        want.add((d, t))
    assert clean == want


def test_unseen_values(spark):
    forest = secrets.train_values(secrets.assigned_findings(spark, 2400))
    fresh = secrets.assigned_findings(spark, 4800).where("doc_id >= 2400")
    judged = fresh.select("secret", secrets.judged_values(fresh["text"], forest).alias("v"), secrets.values(fresh["text"]).alias("f")).collect()
    seen = [(max(v["score"] for v in r["v"]) >= 0.5, r["secret"]) for r in judged if r["v"] and any(v["length"] for v in r["f"])]
    assert len(seen) > 0.8 * len(judged)
    assert np.mean([p == bool(y) for p, y in seen]) > 0.95
