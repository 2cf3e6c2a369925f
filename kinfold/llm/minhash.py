"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import materialize, trim
from .textgrid import Grid, batch_text, mix, pieces, stirred

#: Members of a family and their shingles in a block.
BLOCK = 512
BLOCK_SHINGLES = 500_000
#: Pairs of one hub that meet its set in one place.
HUB_ROWS = 500
#: Ids of documents to be verified that every task may hold; beyond, they are joined by an exchange of the texts.
HELD_IDS = 2_000_000
_MULT = np.uint64(0xD1342543DE82EF95)


def shingle_sets(grid: Grid, width: int) -> Iterator[np.ndarray]:
    """Each document's distinct shingle hashes, sorted; a text of fewer words is one shingle."""
    h, first = grid.lanes[0], grid.first
    n = len(h)
    s = np.zeros(n, np.uint64)
    for j in range(width):
        s[: n - j] = s[: n - j] * _MULT + h[j:]
    s = mix(s)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            yield np.unique(s[a : b - width + 1])
        elif b > a:
            short = np.uint64(b - a)
            for x in h[a:b]:
                short = mix(np.array([short]) * _MULT + np.array([x]))[0]
            yield np.array([short])
        else:
            yield h[:0]


class Circulant:
    """Signature coordinate k is the least pi(sigma(x) + k) over a set: one permutation places an element,
    circular shifts of a second one give all coordinates. Both are bijections of 64 bits, by arithmetic."""

    def __init__(self, coordinates: int):
        self.shifts = np.arange(coordinates, dtype=np.uint64)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        at = mix(hashes * _MULT)
        out = np.full(len(self.shifts), np.uint64(2**64 - 1))
        for k in range(0, len(at), 1024):
            np.minimum(out, stirred(at[k : k + 1024, None] + self.shifts, self.shifts * 0).min(axis=0), out=out)
        return out


def signatures(docs: DataFrame, bands: int, rows: int, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, digest (of the whole set), bands array<long>; null digest and bands for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = Circulant(bands * rows)
        salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            data, offs = batch_text(b)
            for lo, hi in pieces(offs):
                size, digest, keys = [], [], []
                for s in shingle_sets(Grid(data, offs[lo : hi + 1], lower=True, lanes=1), width):
                    size.append(len(s))
                    if not len(s):
                        digest.append(None)
                        keys.append(None)
                        continue
                    p = mix(s)
                    digest.append(p.sum().tobytes() + mix(s ^ salt[0]).sum().tobytes() + np.uint64(len(s)).tobytes())
                    key = salt.copy()
                    for col in circulant.signature(s).reshape(bands, rows).T:
                        key = mix(key * _MULT + col)
                    keys.append(key.view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "bands"])
        trim()  # a worker that waits for its next task holds nothing

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def full_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id and the sorted distinct shingle hashes of its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = batch_text(b)
            for lo, hi in pieces(offs):
                sets = [s.view(np.int64) for s in shingle_sets(Grid(data, offs[lo : hi + 1], lower=True, lanes=1), width)]
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], lists], names=["doc_id", "shingles"])
        trim()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |A and B| >= percent * |A or B|, counted on full sets. a has many pairs
    where it is a hub: they are dealt by salt, and its set goes to the salts that there are."""
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(HUB_ROWS))).cast("int").alias("salts"))
    most = hubs.agg(F.max("salts")).first()[0] or 1
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(most)).cast("int"))
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")).join(salted.select("a", "salt").distinct(), "a")
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    near = F.least(F.size("sa"), F.size("sb")) * 100 >= F.greatest(F.size("sa"), F.size("sb")) * percent
    both = salted.join(right, "b").join(left, ["a", "salt"]).where(near)
    common = both.withColumn("n", F.size(F.array_intersect("sa", "sb")))
    return common.where(100 * F.col("n") >= percent * (F.size("sa") + F.size("sb") - F.col("n"))).select("a", "b")


def linked_blocks(percent: int):
    """For two blocks (id, component, shingles): a link for each two components of which members are linked."""

    def dense(rows: np.ndarray, cols: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        out = np.zeros(shape, np.float32)
        out[rows, cols] = 1
        return out

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sides = []
        for t in (left, right):
            t = t.rename_columns(["family", "l", "r", "id", "component", "shingles"])
            lists = t.column("shingles").combine_chunks()
            size = np.asarray(lists.value_lengths())
            sides.append((np.asarray(t.column("id")), np.asarray(t.column("component")), size, np.repeat(np.arange(len(size)), size), np.asarray(lists.flatten())))
        (ida, ca, na, ra, sa), (idb, cb, nb, rb, sb) = sides
        both = np.intersect1d(sa, sb)
        common = np.zeros((len(ida), len(idb)), np.float32)
        for k in range(0, len(both), 4096):
            part = both[k : k + 4096]
            own = []
            for r, s, n in ((ra, sa, len(ida)), (rb, sb, len(idb))):
                at = np.minimum(np.searchsorted(part, s), len(part) - 1)
                hit = part[at] == s
                own.append(dense(r[hit], at[hit], (n, len(part))))
            common += own[0] @ own[1].T
        n = common.astype(np.int64)
        i, j = np.nonzero((100 * n >= percent * (na[:, None] + nb[None, :] - n)) & (ca[:, None] != cb[None, :]))
        _, once = np.unique(np.stack([ca[i], cb[j]], axis=1), axis=0, return_index=True) if len(i) else (None, np.zeros(0, np.int64))
        return pa.table({"a": pa.array(ida[i[once]], pa.int64()), "b": pa.array(idb[j[once]], pa.int64())})

    return run


def cross_links(families: DataFrame, comp: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links between the components of a family: all members outside its largest component against all its
    members, in blocks of about `block` rows and `shingles` shingles a side. families, comp: (id, component_id)."""
    member = families.select("id", F.col("component_id").alias("family")).join(comp.withColumnRenamed("component_id", "component"), "id", "left")
    member = member.withColumn("component", F.coalesce("component", "id"))
    member = member.join(sets.select(F.col("doc_id").alias("id"), F.size("shingles").alias("size")), "id")
    sized = member.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    shape = sized.groupBy("family").agg(F.sum("n").alias("all"), F.sum("size").alias("size"), F.max(F.struct("n", "component", "size")).alias("main"))
    blocks = lambda n, size: F.greatest(F.ceil(n / F.lit(float(block))), F.ceil(size / F.lit(float(shingles)))).cast("int")
    left_side = blocks(F.col("all") - F.col("main.n"), F.col("size") - F.col("main.size"))
    shape = shape.where("all > main.n").select("family", F.col("main.component").alias("main"), left_side.alias("nl"), blocks(F.col("all"), F.col("size")).alias("nr"))
    rows = materialize(member.drop("size").join(materialize(shape, "families"), "family"), "members").join(sets.withColumnRenamed("doc_id", "id"), "id")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("component <> main").withColumn("l", own("nl")).withColumn("r", every("nr")).select("family", "l", "r", "id", "component", "shingles")
    right = rows.withColumn("r", own("nr")).withColumn("l", every("nl")).select("family", "l", "r", "id", "component", "shingles")
    left, right = left.toDF(*[f"{c}1" for c in left.columns]), right.toDF(*[f"{c}2" for c in right.columns])
    met = left.groupBy("family1", "l1", "r1").cogroup(right.groupBy("family2", "l2", "r2")).applyInArrow(linked_blocks(percent), "a long, b long")
    return materialize(met, "links")


def with_ids(docs: DataFrame, ids: DataFrame, held: int = HELD_IDS) -> DataFrame:
    """(doc_id, text) of the documents among ids (id). Up to `held` ids go to the texts; else both are exchanged."""
    right = ids.select(F.col("id").alias("doc_id"))
    if ids.limit(held + 1).count() <= held:
        right = F.broadcast(right)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(right, "doc_id", "left_semi")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, bands: int = 20, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Rows with equal shingle sets form a class, of which the smallest doc_id alone is compared with others.
    Members of a bucket are verified against the bucket's smallest member first; what that links is
    contracted. Classes that buckets tie together are a family. Where a family still has several
    components, its members outside the largest one meet all its members in blocks, on full sets, and a
    link is given for two components, not for each pair. At 85 percent, 20 bands of 4 coordinates miss a link
    with a chance of about 4e-7.

    Texts without words are linked with nothing. A null text counts as empty; rows with a null doc_id are
    answered as unlinked and kept. Rows that repeat a doc_id count as one document, whose text is
    the one that sorts last; the result has one row a doc_id then.
    """
    sig = signatures(docs, bands, rows, width)
    sig = materialize(sig, "signatures")
    if sig.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        one = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("text").alias("text"))
        docs = one.unionByName(docs.where(F.col("doc_id").isNull()))
        sig = materialize(signatures(docs, bands, rows, width), "signatures")
    named = sig.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"))
    classes = materialize(classes, "classes")
    keyed = classes.select(F.col("rep").alias("id"), F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub")
    bucket = materialize(keyed.join(shared, "key"), "buckets")
    sets = materialize(full_sets(with_ids(docs, bucket.select("id").distinct()), width), "sets")

    pairs = materialize(bucket.where("id > hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = materialize(verified(pairs, sets, percent), "verified")
    comp = materialize(components(links), "components")
    # stars of what is linked so far, and links between them
    stars = comp.select(F.col("id").alias("a"), F.col("component_id").alias("b"))
    more = stars.unionByName(cross_links(components(pairs), comp, sets, percent))
    comp = materialize(components(more), "components")

    of_class = classes.select("digest", "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component_id", "rep").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
