"""Plain single-process versions of the operators' contracts."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def topk(rows, k=20, every=20):
    ok = {i: [math.floor(64 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in ok if i % every == 0):
        s = sorted((-sum(a * b for a, b in zip(ok[q], ok[c])), c) for c in ok if c != q)[:k]
        out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s)]
    return out


def shingles(text, width=5):
    w = WORD.findall((text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or {tuple(w)}


def components(docs, percent=85):
    sets = {d: shingles(t) for d, t in docs}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for o in by[x]:
                if o > d:
                    common[o] += 1
        for o, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = sorted((find(d), find(o)))
                parent[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


def word_repeats(docs, length=50):
    words = {d: WORD.findall((t or "").encode()) for d, t in docs}
    low = {}
    for d in sorted(words):
        for i in range(len(words[d]) - length + 1):
            low.setdefault(tuple(words[d][i : i + length]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if low[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        kept = [x for x, g in zip(w, gone) if not g]
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def byte_repeats(docs, length=50):
    raw = {d: (t or "").encode() for d, t in docs}
    low = {}
    for d in sorted(raw):
        b = raw[d]
        for i in range(len(b) - length + 1):
            low.setdefault(b[i : i + length], d)
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if low[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        runs = len(re.findall(b"\1+", gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def token_ids(texts, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
