import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from brute import components, crc, token_ids, topk, word_repeats

from kinfold.llm import media, minhash, packing
from kinfold.llm import queries as Q
from kinfold.llm import topk as T
from kinfold.llm import wordrepeats


def read(spark, sf, name="documents"):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select("doc_id", "text").collect()]


WORDS = ["ab", "Cd", "été", "x.", "y,", "zz", "Ab", "q"]


def odd_docs(seed=3):
    """Nulls, empty and short texts, copies, near copies, shared passages, ties."""
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n))
    base, passage = text(150), text(70)
    docs = [None, "", " \t\n", "one", "ONE", "a b c d", "A b  c\td", "a b c d e", base, base, base.upper(), base + " tail"]
    for _ in range(12):
        w = base.split(" ")
        for _ in range(r.randrange(1, 6)):
            w[r.randrange(len(w))] = "edit" + str(r.randrange(99))
        docs.append(" ".join(w))
    docs += [text(20) + " " + passage + " " + text(30), passage + text(5), text(9) + " " + passage, passage, text(4000) + "\n" + passage + " " + passage]
    docs += ["word " * 200, "word " * 120, "é" * 130, "é" * 49 + "x"]
    ids = list(range(len(docs)))
    r.shuffle(ids)
    return list(zip(ids, docs))


def frame(spark, docs):
    """With columns that clash with names used inside."""
    return spark.createDataFrame([(d, t, "k", 1, 2) for d, t in docs], "doc_id long, text string, h string, key int, n int")


def test_topk(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(map(tuple, Q.op1_topk(spark, sf).collect()))
    assert got == topk(rows)


def test_topk_odd(spark):
    r = random.Random(1)
    rows = [(i, [float(r.randrange(-1, 2)) for _ in range(3)]) for i in range(70)]
    rows += [(100, None), (120, [1.0, float("nan"), 0.0]), (140, [1.0, None, 2.0]), (160, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame([(*x, "c") for x in rows], "vec_id long, embedding array<float>, score string")
    assert sorted(map(tuple, T.top_k(df, k=5, group_rows=16, block=4, query_rows=2).collect())) == topk(rows, 5)
    assert T.top_k(df.limit(0)).count() == 0


def test_near_duplicates(spark, sf):
    docs = read(spark, sf)
    want = components(docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in Q.op6_minhash(spark, sf).collect()}
    assert got == want


def test_near_duplicates_odd(spark):
    docs = odd_docs()
    got = minhash.near_duplicates(frame(spark, docs)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(docs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert minhash.near_duplicates(frame(spark, docs[:0] or [(0, "")]).limit(0)).count() == 0


def test_near_duplicates_repeated_rows(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")]
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in minhash.near_duplicates(frame(spark, docs)).collect())
    assert [x[0] for x in got] == ["1", "2", "None"] and [x[1] for x in got][:2] == [1, 1]


def test_unlike_bucket(spark):
    """Members of one bucket that aren't linked with its smallest are still compared with each other."""
    base = [f"w{i}" for i in range(100)]
    a, b, c = list(base), list(base), list(base)
    for i in range(0, 12, 6):
        a[i + 10] = "x"
    for i in range(0, 24, 6):
        b[i + 40] = "y"
    c = b + ["z"]
    docs = [(i, " ".join(w)) for i, w in enumerate((base, a, b, c))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, docs), bands=40, rows=1).collect()}
    assert got == components(docs)


def test_word_repeats(spark, sf):
    got = {r[0]: tuple(r)[1:] for r in Q.op10_word_repeats(spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    assert got == word_repeats(read(spark, sf))


@pytest.mark.parametrize("length", [50, 7, 2])
def test_word_repeats_odd(spark, length):
    docs = odd_docs()
    got = wordrepeats.remove_repeated_words(frame(spark, docs), length).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == word_repeats(docs, length)
    assert wordrepeats.remove_repeated_words(frame(spark, docs).limit(0)).count() == 0


def check_packing(rows, docs):
    want = dict(zip([d for d, _ in docs], token_ids([t for _, t in docs], packing.vocabulary_path())))
    seqs, by = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids_crc32"] == crc(want[r["doc_id"]][r["start"] : r["start"] + r["length"]])
        assert r["doc_tokens"] == len(want[r["doc_id"]])
    for d, ids in want.items():
        at = 0
        for r in sorted(by[d], key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(ids)
    totals = []
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert 0 < at <= 2048
        totals.append(at)
    return totals


def test_packing(spark, sf):
    totals = check_packing(Q.op2_packing(spark, sf).collect(), read(spark, sf))
    assert sum(2048 - t for t in totals if t & (t - 1)) < 2 * 2048


def test_packing_odd(spark):
    docs = odd_docs() + [(900, "a\x1cb. c\x1e.d"), (901, "ΣΑΣ <|endoftext|> é  x ÅÅ İ"), (902, "don't I'LL 123 4.5!!")]
    check_packing(packing.pack(frame(spark, docs), share=7).collect(), docs)
    assert packing.pack(frame(spark, docs).limit(0)).count() == 0


def test_fill_window_is_tightest():
    r = random.Random(5)
    for _ in range(200):
        counts = {r.randrange(1, 40): r.randrange(1, 4) for _ in range(5)}
        one = packing.fill_window(counts, 50)
        seed = max(counts)
        assert one.get(seed, 0) >= 1 and all(v <= counts[k] for k, v in one.items())
        sums = {seed}
        for k, v in counts.items():
            sums |= {s + k * j for s in sums for j in range(v - (k == seed) + 1) if s + k * j <= 50}
        pad = lambda t: 0 if t & (t - 1) == 0 else 50 - t
        got = sum(k * v for k, v in one.items())
        assert got in sums and (got == 50 or 50 not in sums) and (got == 50 or pad(got) == min(map(pad, sums)))


def test_text_media(spark, sf):
    docs = odd_docs()
    rows = {r["doc_id"]: r for r in media.text_media(frame(spark, docs)).collect()}
    for d, t in docs:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = rows[d]
        stored = b"P5\n64 %d\n255\n" % (len(padded) // 64) + padded
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(padded), len(stored))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["media_sha256"] == hashlib.sha256(stored).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(padded[-64:])


def test_media_formats(spark):
    rng = np.random.default_rng(0)
    grey, rgb = rng.integers(0, 256, (70, 131), np.uint8), rng.integers(0, 256, (65, 67, 3), np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(media.encode_bmp(rgb)) == rgb).all()
    assert (media.decode(b"P6 # note\n67 65\n255\n" + rgb.tobytes()) == rgb).all()
    assert (media.decode(b"P1\n3 2\n1 0 1\n010") == [[0, 255, 0], [255, 0, 255]]).all()
    assert (media.decode(b"P4\n9 1\n" + bytes([0b10000000, 0b10000000])) == [[0, *[255] * 7, 0]]).all()
    assert (media.decode(b"P2\n2 1\n9\n3 4") == [[3, 4]]).all()
    big = rng.integers(0, 60000, (5, 4)).astype(">u2")
    assert (media.decode(b"P5\n4 5\n60000\n" + big.tobytes()) == big).all()
    small = media.area_resize(grey, 7, 13)
    brute = np.zeros((7, 13))
    fine = np.kron(grey.astype(float), np.ones((1, 13)))  # each target cell is 131 fine columns
    for i in range(7):
        for j in range(13):
            brute[i, j] = fine[i * 10 : i * 10 + 10, j * 131 : (j + 1) * 131].mean()
    assert np.allclose(small, brute)
    df = spark.createDataFrame([(1, media.encode_pgm(grey)), (2, media.encode_bmp(rgb)), (3, None), (4, b"junk")], "id int, m binary")
    rows = media.media_tiles(df, "m", ["id"]).collect()
    parts = {(r["id"], r["tile_row"], r["tile_col"]): r["tile_npy"] for r in rows if r["tile_npy"]}
    import io

    load = lambda k: np.load(io.BytesIO(parts[k]))
    back = np.block([[load((1, i, j)) for j in range(3)] for i in range(2)])
    assert (back == grey).all() and sum(r["media_error"] is not None for r in rows) == 2
