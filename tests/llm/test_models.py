import random
import re
import zlib

import numpy as np
import pytest
from test_first_ops import frame, odd_docs, read

from kinfold.llm import mixing, secrets, tokencount, toxicity
from kinfold.llm import queries as Q


@pytest.fixture(scope="module")
def counter():
    import public_tokenizers as P

    return tokencount.PieceCounter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_edits_by_brute_force(counter):
    r = random.Random(1)
    parts = ["a", "b", "the", " ", "  ", "\n", " \n", "'s", "'", "1", "23", ".", "!!", "é", "x'll", "\t"]
    some = lambda n: "".join(r.choice(parts) for _ in range(r.randrange(n)))
    for _ in range(3000):
        text = some(40)
        cuts = sorted(r.randrange(0, len(text) + 1) for _ in range(2 * r.randrange(1, 4)))
        edits = [(cuts[i], cuts[i + 1], some(4)) for i in range(0, len(cuts), 2)]
        want = text
        for a, b, new in reversed(edits):
            want = want[:a] + new + want[b:]
        doc = tokencount.CountedText(text, counter)
        assert doc.apply(edits) == want
        assert doc.total() == len(counter.encoding.encode_ordinary(want))


def test_segment_tree():
    r = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 100):
        leaves = r.integers(0, 9, n)
        tree = tokencount.SegmentTree(leaves)
        for _ in range(20):
            a = int(r.integers(0, n))
            new = r.integers(0, 9, int(r.integers(1, n - a + 1)))
            leaves[a : a + len(new)] = new
            tree.update(a, new)
            assert tree.total() == leaves.sum()
            assert all(tree.prefix(k) == leaves[:k].sum() for k in range(n + 1))


def test_token_counts(spark, sf, counter):
    docs = dict(read(spark, sf))
    rows = Q.op3_token_counts(spark, sf).collect()
    assert len(rows) == len(docs) and any(r["n_edits"] for r in rows)
    count = lambda t: len(counter.encoding.encode_ordinary(t))
    for r in rows:
        text = docs[r["doc_id"]]
        assert r["tokens_before"] == count(text)
        assert r["tokens_after"] == count(tokencount.SCRUB.sub(tokencount.MARK, text))
        assert r["pieces_encoded_again"] < 40 * max(1, r["n_edits"]) and (r["n_edits"] or not r["pieces_encoded_again"])
    assert tokencount.edited_counts(frame(spark, odd_docs())).count() == len(odd_docs())
    assert tokencount.edited_counts(frame(spark, odd_docs()).limit(0)).count() == 0


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = Q.op5_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    unseen = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == y for p, y in unseen]) > 0.95
    assert sum(p for p, y in unseen if not y) <= 0.02 * len(unseen)


def test_toxicity_finds_the_sentence(spark):
    r = random.Random(4)
    plain = lambda: " ".join(r.choice("abcdefghij") + str(r.randrange(20)) for _ in range(6)).capitalize() + ". "
    docs, labels = [], []
    for i in range(600):
        s = [plain() for _ in range(5)]
        if i % 4 == 0:
            s[i % 5] = f"You grobbl{'aeiou'[i % 5]} {r.randrange(20)}. "
        docs.append((i, "".join(s)))
        labels.append((i, int(i % 4 == 0)))
    docs += [(1000, None), (1001, ""), (1002, "...")]
    got = toxicity.toxicity(frame(spark, docs), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")).collect()
    by = {r["doc_id"]: r for r in got}
    for i, t in docs:
        if i < 600:
            assert by[i]["predicted"] == int(i % 4 == 0), (i, by[i])
            if i % 4 == 0:
                assert "grobbl" in t.encode()[by[i]["worst_start"] : by[i]["worst_end"]].decode()
        else:
            assert by[i]["score"] < 0.01 and by[i]["worst_start"] is None
    kept = toxicity.keep_clean(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in docs if i >= 600 or i % 4) and kept.columns == ["doc_id", "text", "h", "key", "n"]
    assert toxicity.toxicity(frame(spark, docs).limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def brute_rates(tokens, post, target, rounds=40):
    a = tokens[:, None] * post
    inv, r = np.linalg.pinv(a.T @ a), np.ones(len(tokens))
    for _ in range(rounds):
        gap = r @ a - target
        if np.abs(gap).max() <= 1e-6 * max(1.0, np.abs(target).max()):
            break
        r = np.maximum(0, r - a @ (inv @ gap))
    return r


def test_mixing(spark, sf):
    rows = Q.op7_mixing(spark, sf).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    names = sorted(Q.LANGUAGE_WEIGHTS)
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {d: len(re.findall(rb"[^\x20\x09-\x0D]+", x["text"].encode())) for d, x in docs.items()}
    assert np.mean([r["domain"] == docs[r["doc_id"]]["lang"] for r in rows if r["n_tokens"] > 20]) > 0.95
    t, q = np.array([r["n_tokens"] for r in rows], float), np.array([r["posterior"] for r in rows])
    target = np.array([Q.LANGUAGE_WEIGHTS[n] for n in names]) * t.sum()
    rate = np.array([r["rate"] for r in rows])
    assert (rate >= 0).all() and np.allclose((rate * t) @ q, target, rtol=1e-3)
    assert np.allclose(rate, brute_rates(t, q, target), atol=1e-6)
    assert all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in rows)


def test_mixing_that_clips(spark):
    rng = np.random.default_rng(0)
    q = rng.dirichlet([0.3] * 3, 200)
    t = rng.integers(1, 500, 200)
    target = np.array([0.02, 0.03, 0.95]) * t.sum()
    df = spark.createDataFrame([(i, int(t[i]), q[i].tolist()) for i in range(200)], "doc_id long, n_tokens long, posterior array<double>")
    rated, total = mixing.fit_rates(df, target, rounds=60)
    rate = np.array([r["rate"] for r in rated.orderBy("doc_id").collect()])
    assert (rate >= 0).all() and (rate == 0).any()
    assert np.allclose(rate, brute_rates(t.astype(float), q, target, 60), atol=1e-6)
    assert np.allclose(total, (rate * t) @ q)


def test_mixing_odd(spark):
    docs = frame(spark, odd_docs())
    labels = docs.selectExpr("doc_id", "if(doc_id % 2 = 0, 'even', null) as domain")
    got = mixing.mix(docs, labels, {"even": 1.0}).collect()
    assert len(got) == len(odd_docs())
    assert mixing.mix(docs, labels.limit(0), {"even": 1.0}).count() == len(odd_docs())
    assert mixing.mix(docs.limit(0), labels, {"even": 1.0}).count() == 0
    assert mixing.resample(docs, labels, {"even": 1.0}).columns == docs.columns


def brute_scan(text, forest):
    out = []
    found = list(re.finditer(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{8,}={0,2}", text or ""))
    for k, m in enumerate(found):
        c, n = m[0], float(len(m[0]))
        b = text[found[k - 1].end() if k else 0 : m.start()][-secrets.BEFORE :].lower()
        a = text[m.end() : found[k + 1].start() if k + 1 < len(found) else None][: secrets.AFTER].lower()
        kinds = "".join("A" if x.isupper() else "a" if x.islower() else "0" if x.isdigit() else "-" for x in c)
        has = lambda p, s: float(re.search(p, s, re.ASCII) is not None)
        f = {
            "length": n, "digits": sum(x.isdigit() for x in c) / n, "uppers": sum(x.isupper() for x in c) / n,
            "lowers": sum(x.islower() for x in c) / n, "marks": sum(not x.isalnum() for x in c) / n,
            "turns": len(re.sub(r"(.)\1+", r"\1", kinds)) / n, "distinct": len(set(c)) / min(n, 32.0),
            "hexadecimal": has(r"^([0-9a-f]+|[0-9A-F]+)\Z", c), "covered": 1 - len(re.sub(secrets.DICTIONARY, "", c.lower())) / n,
            "path": max(has(r"/[^/]*[a-z]{3}[^/]*/", c), has(r"^\.[a-z]{1,4}\b", a), has(r"(\w[.:]//?|[/.@\\])\Z", b), has(r"^[@\\]", a)),
            "near_secret": has(secrets.SECRET_WORDS[:-1] + r"\Z", b), "near_plain": has(secrets.PLAIN_WORDS[:-1] + r"\Z", b),
            "assigned": has("[=:]\\s*[\"']?\\Z", b), "quoted": has("[\"']\\Z", b) * has("^[\"']", a),
            "prefix": has("^(AKIA|ASIA|ghp_|gho_|sk_|xox[abp]-|eyJ)", c),
        }

        def leaf(t, f=f):
            while isinstance(t, tuple):
                t = t[2] if f[secrets.FEATURES[t[0]]] <= t[1] else t[3]
            return t

        out.append((k, c, sum(map(leaf, forest)) / len(forest)))
    return out


def test_secrets(spark):
    import hashlib

    forest = secrets.train_forest(secrets.labelled_findings(spark, 2400))
    fresh = secrets.labelled_findings(spark, 3600).where("doc_id >= 2400").collect()
    judged = [(max([s for _, _, s in brute_scan(r["text"], forest)], default=0) >= 0.5, r["secret"]) for r in fresh]
    assert np.mean([p == bool(y) for p, y in judged]) > 0.97
    docs = read(spark, "/root/testdata/sf0.01") + [(5000 + i, t) for i, (_, t) in enumerate(odd_docs())] + [(r["doc_id"] + 9000, r["text"]) for r in fresh[:200]]
    want = sorted((d, k, len(c), hashlib.sha256(c.encode()).hexdigest(), round(s, 6)) for d, t in docs for k, c, s in brute_scan(t, forest) if s >= 0.5)
    assert sorted(map(tuple, secrets.scan(frame(spark, docs), forest).collect())) == want
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(frame(spark, docs), forest).collect()}
    for d, t in docs:
        bad = [c for _, c, s in brute_scan(t, forest) if s >= 0.5]
        assert clean[d] == t if not bad else clean[d].count("[SECRET]") == len(bad) and not any(c in clean[d] for c in bad)
    assert secrets.scan(frame(spark, docs).limit(0), forest).count() == 0
    assert secrets.train_forest(secrets.labelled_findings(spark).limit(0)) == [0.0]
