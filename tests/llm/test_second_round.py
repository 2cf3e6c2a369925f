"""Odd inputs: hashes that must tell words apart, repeated batches of edits, media headers, clashing names."""

import random
import zlib

import numpy as np
import pytest
from brute import byte_repeats, components, word_repeats
from test_first_ops import frame, odd_docs
from test_models import counter  # noqa: F401

from kinfold.llm import byterepeats, hashedwords, media, minhash, mixing, textgrid, tokencount, toxicity, wordrepeats


def thue_morse(bits, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(1 << bits))


@pytest.mark.parametrize("bits", [10, 12])
def test_complementary_words(spark, bits):
    """A polynomial hash modulo 2**64 takes these words for one, whatever its base."""
    x, y = thue_morse(bits, "a", "b"), thue_morse(bits, "b", "a")
    docs = [(1, " ".join([x] * 60)), (2, " ".join([y] * 60)), (3, f"{x} one two three four five"), (4, f"{y} one two three four five")]
    got = wordrepeats.remove_repeated_words(frame(spark, docs)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == word_repeats(docs)
    got = minhash.near_duplicates(frame(spark, docs)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(docs)
    short = [(1, x[:200] + "#" + y), (2, y[:200] + "#" + x), (3, y[3:90])]
    got = byterepeats.remove_repeated_bytes(frame(spark, short)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == byte_repeats(short)


def test_word_hashes():
    words = [b"a", b"ab", b"a\0", b"12345678", b"123456789", b"1234567", b"x" * 64, b"x" * 65, b"x" * 66, b"y" * 500]
    data = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size) - size
    one, two = textgrid.word_hashes(data, start, size, 2)
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(words)
    again = textgrid.word_hashes(np.concatenate([np.zeros(3, np.uint8), data[::-1], data]), start + len(data) + 3, size, 2)
    assert (again[0] == one).all() and (again[1] == two).all()


def test_repeats_of_rows_with_other_texts(spark):
    """Rows that share a doc_id are one document for the comparison; each is answered by its own text."""
    p, q = "0123456789" * 6, " ".join(f"w{i}" for i in range(60))
    docs = [(1, p), (1, q), (2, p + q), (2, "x" + q), (3, q + p)]
    got = byterepeats.remove_repeated_bytes(frame(spark, docs)).collect()
    gone = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got)
    assert gone == sorted([(1, 60, 0), (1, len(q), 0), (2, 60 + len(q), 60 + len(q)), (2, 1 + len(q), len(q)), (3, 60 + len(q), 60 + len(q))])
    rows = wordrepeats.remove_repeated_words(frame(spark, [*docs, (None, q)])).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in rows) == [("1", 1, 0), ("1", 60, 0), ("2", 60, 59), ("2", 60, 59), ("3", 60, 59), ("None", 60, 0)]


def test_edits_in_batches(counter):  # noqa: F811
    r = random.Random(11)
    parts = ["a", "b", "the", " ", "  ", "\n", "'s", "1", "23", ".", "é", "\t"]
    some = lambda n: "".join(r.choice(parts) for _ in range(r.randrange(n)))
    for _ in range(600):
        text = some(40)
        doc = tokencount.CountedText(text, counter)
        for _ in range(4):
            cuts = sorted(r.randrange(0, len(text) + 1) for _ in range(2 * r.randrange(1, 4)))
            edits = [(cuts[i], cuts[i + 1], some(4)) for i in range(0, len(cuts), 2)]
            for a, b, new in reversed(edits):
                text = text[:a] + new + text[b:]
            assert doc.apply(edits) == doc.text == text
            assert doc.total() == len(counter.encoding.encode_ordinary(text))


def test_media_headers(spark):
    bad = [b"P5\n99999999999999999999 9999999999\n255\n", b"P2\n1 1\n255\n99999999999999999999999", b"P5\n0 4\n255\n", b"P5\n2 2\n0\nabcd", b"P6\n2 2\n255\nabc", b"BM" + b"\xff" * 60, b"BM"]
    df = spark.createDataFrame([(i, m, "x") for i, m in enumerate(bad)] + [(9, media.encode_pgm(np.zeros((1, 1), np.uint8)), None)], "_media int, cell binary, media string")
    rows = media.media_tiles(df, "cell", ["_media", "media"]).collect()
    assert sorted(r["_media"] for r in rows if r["media_error"]) == list(range(len(bad)))
    assert [r["media_height"] for r in rows if not r["media_error"]] == [1]


def test_text_media_goes_through_tiles(spark):
    docs = odd_docs() + [(700, "long " * 9000), (700, "long " * 9000), (None, "x")]
    rows = media.text_media(frame(spark, docs)).collect()
    assert len(rows) == len(docs) and media.text_media(frame(spark, docs).limit(0)).count() == 0
    for r in rows:
        assert r["n_tiles"] == -(-r["payload_bytes"] // 4096)
    by = {}
    for d, t in docs:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        image = np.frombuffer(padded, np.uint8).reshape(-1, 64).astype(float)
        fine = np.kron(image, np.ones((8, 9)))  # each of 8 x 9 cells is as many fine samples as the image
        cells = fine.reshape(8, len(image), 9, 64).mean(axis=(1, 3)).round(6)
        by[d, len(raw)] = f"{len(image)}:{np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()}"
    assert {(r["doc_id"], r["n_bytes"]): r["feature"] for r in rows} == by


def test_scores_by_brute_force(spark):
    """A document's score is the noisy-or of its sentences', from its own words alone."""
    r = random.Random(3)
    model = toxicity.Model(np.abs(np.random.default_rng(0).normal(0, 1.2, 1 << hashedwords.BITS)), -8.0)
    docs = [(i, " ".join(r.choice(["ab", "Cd.", "é", "x!", "grobbl"]) + str(r.randrange(9)) for _ in range(r.randrange(60)))) for i in range(80)] + [(90, None), (91, "")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame(spark, docs), model).collect()}
    for d, t in docs:
        raw = (t or "").encode()
        f = hashedwords.Features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        ends = [*f.sentence[1:], f.index.shape[1]]
        clean = 1.0
        for a, e in zip(f.sentence, ends):
            clean *= 1 - 1 / (1 + np.exp(-(model.bias + sum(model.weights[f.index[:, w]].sum() for w in range(a, e)))))
        assert abs(got[d] - (1 - clean)) < 1e-9


def test_resample_with_clashing_names(spark):
    docs = spark.createDataFrame([(i, f"a{i} b c", 1, 2, 3) for i in range(20)], "doc_id long, text string, _id int, _copies int, _copy int")
    labels = docs.selectExpr("doc_id", "if(doc_id % 2 = 0, 'p', 'q') as domain")
    assert mixing.resample(docs, labels, {"p": 0.5, "q": 0.5}).columns == docs.columns
    with pytest.warns(UserWarning, match="miss the targets"):
        q = spark.createDataFrame([(1, 10, [1.0, 0.0])], "doc_id long, n_tokens long, posterior array<double>")
        mixing.fit_rates(q, np.array([5.0, 5.0]), rounds=2)


def test_sample_of_long_texts(spark):
    docs = [(i, "grobbl. " * (2 if i % 2 else 1) + "ok fine. " * 3000) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    rows = toxicity.toxicity(frame(spark, [*docs, docs[0]]), labels).collect()
    assert len(rows) == 41 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert toxicity.fit(frame(spark, docs), labels, sample_bytes=10).weights.sum() == 0
