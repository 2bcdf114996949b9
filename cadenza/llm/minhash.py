"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's set has a 64-bit hash for each distinct shingle. One permutation scatters the hashes over the circle of 64-bit
integers; a second one, shifted circularly by a fixed step for each coordinate, gives all coordinates of the signature as
minima. Equal sets collapse to a class first. Classes that share a band are candidates, and every link is confirmed on the
full sets.

No group is expanded into its pairs. In large buckets, classes with so many shingles of their own that no link there is
possible leave first. In a bucket each class is compared with one pivot, the most central class. Buckets whose classes the
links leave in different components are then compared in full, in blocks of bounded size, by inverted indexes: links
found so far save the comparisons within a component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, fits, map_documents, written
from .graph import components

#: Coordinates in a band, and the probability with which a link at just the threshold may share no band.
ROWS, MISSED = 4, 1e-6
#: Ids of documents whose sets are needed are broadcast up to this many; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Bytes of shingles in a block of a bucket that is compared in full.
BLOCK_BYTES = 8 << 20
#: Classes in a bucket up to which shingles of their own aren't counted.
SMALL = 8
#: Word hashes that a task remembers.
REMEMBERED = 200_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31, _S32 = (np.uint64(x) for x in (30, 27, 31, 32))


def scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation of the 64-bit integers."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def shifted(x: np.ndarray, k: int, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The second permutation after a circular shift by k steps, in place."""
    np.add(x, np.uint64(k * int(_STEP) & 0xFFFFFFFFFFFFFFFF), out=out)
    for shift, factor in ((_S32, _M2), (_S30, _M1)):
        np.right_shift(out, shift, out=spare)
        np.bitwise_xor(out, spare, out=out)
        np.multiply(out, factor, out=out)
    np.right_shift(out, _S32, out=spare)
    return np.bitwise_xor(out, spare, out=out)


def bands_for(threshold: float, rows: int = ROWS, missed: float = MISSED) -> int:
    return math.ceil(math.log(missed) / math.log1p(-(threshold**rows)))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[str], size: int, known: _WordHashes | None = None) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of size words, or of all words where there are fewer; none without words."""
    known = _WordHashes() if known is None else known
    words = [t.encode("utf-8").lower().split() for t in texts]  # bytes: only A-Z and ASCII white space count
    flat = np.fromiter((known[w] for ws in words for w in ws), dtype=np.uint64, count=sum(map(len, words)))
    out, at = [], 0
    n = len(flat)
    rolled = np.zeros(max(0, n - size + 1), dtype=np.uint64)
    for j in range(size):
        rolled += (flat[j : n - size + 1 + j] if n >= size else flat[:0]) * np.uint64((2 * j + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF)
    rolled = scatter(rolled)
    for ws in words:
        k = len(ws)
        if k >= size:
            out.append(np.unique(rolled[at : at + k - size + 1]))
        elif k:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=k)], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += k
    return out


def signatures(sets: list[np.ndarray], coordinates: int, block: int = 1 << 17) -> np.ndarray:
    """coordinates x len(sets) minima; no set may be empty. Works on blocks that stay in the cache."""
    out = np.empty((coordinates, len(sets)), dtype=np.uint64)
    start = 0
    while start < len(sets):
        end, held = start, 0
        while end < len(sets) and (end == start or held + len(sets[end]) <= block):
            held += len(sets[end])
            end += 1
        base = scatter(np.concatenate(sets[start:end]))
        offsets = np.cumsum([0] + [len(s) for s in sets[start : end - 1]])
        room, spare = np.empty_like(base), np.empty_like(base)
        for k in range(coordinates):
            out[k, start:end] = np.minimum.reduceat(shifted(base, k, room, spare), offsets)
        start = end
    return out


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit bucket for each band (rows of the result: documents), the band's number mixed in."""
    bands = signature.shape[0] // rows
    out = np.empty((signature.shape[1], bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(signature.shape[1], (b + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            h = scatter(h + signature[k])
        out[:, b] = h
    return out


def digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest() if len(s) else None


def signed(docs: DataFrame, size: int, bands: int, rows: int = ROWS) -> DataFrame:
    """doc_id, same, digest (null without words), n, bands of each row of docs (doc_id, same, text)."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        known = _WordHashes()

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch.column("text").to_pylist(), size, known)
            full = [k for k, s in enumerate(sets) if len(s)]
            hashes: list[list[int] | None] = [None] * len(sets)
            if full:
                found = band_hashes(signatures([sets[k] for k in full], bands * rows), rows).astype(np.int64)
                for k, h in zip(full, found):
                    hashes[k] = h
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("same"), pa.array(map(digest, sets), pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["doc_id", "same", "digest", "n", "bands"]
            )

        return kernel

    return map_documents(docs, make, "doc_id long, same long, digest binary, n long, bands array<long>")


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """digest, set of each row of docs with words."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        known = _WordHashes()

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [s for s in shingle_sets(batch.column("text").to_pylist(), size, known) if len(s)]
            return pa.RecordBatch.from_arrays([pa.array(map(digest, sets), pa.binary()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], ["digest", "set"])

        return kernel

    return map_documents(docs, make, "digest binary, set array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets overlap by percent of their union at least."""
    left, right = sets.select(F.col("digest").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("digest").alias("b"), F.col("set").alias("set_b"))
    shared = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return pairs.join(left, "a").join(right, "b").where(100 * shared >= percent * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def bounded(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members (bucket, digest, n, size) with own, less those of large buckets that can't have a link there.

    own counts, for members of large buckets, the shingles that no other such member has: they are in no overlap within the
    bucket, so it bounds the similarity of any pair from above. In small buckets own is 0, which bounds nothing.
    """
    small = members.where(F.col("size") <= SMALL).select("bucket", "digest", "n", F.lit(0).cast("long").alias("own"))
    large = members.where(F.col("size") > SMALL)
    of_large = sets.join(large.select("digest").distinct(), "digest", "left_semi")
    single = of_large.select("digest", F.explode("set").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("sets"), F.min("digest").alias("digest")).where("sets = 1")
    own = single.groupBy("digest").agg(F.count("*").alias("own"))
    least = large.groupBy("bucket").agg(F.min("n").alias("least"))
    large = large.join(own, "digest", "left").withColumn("own", F.coalesce("own", F.lit(0).cast("long"))).join(least, "bucket")
    shared = F.col("n") - F.col("own")
    large = large.where(100 * shared >= percent * (F.col("n") + F.greatest("least", shared) - shared))
    return small.union(large.select("bucket", "digest", "n", "own"))


def settled(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components within buckets, enough to connect what is linked.

    members has bucket, digest, n, label. A bucket is cut into blocks of at most about BLOCK_BYTES of shingles by the hash of the
    digest, and every two blocks meet in a group, so no group grows with the data. In a group, the classes outside its
    largest component are looked up in the inverted index of all; no pairs are made but the links found.
    """
    blocks = F.ceil(F.sum("n") * 8 / BLOCK_BYTES)
    m = members.join(members.groupBy("bucket").agg(blocks.alias("blocks")), "bucket")
    m = m.withColumn("block", F.pmod(F.xxhash64("digest", F.lit(7)), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    m = m.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "digest", "label").join(sets, "digest")

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        xs = [np.asarray(x, dtype=np.int64) for x in f["set"]]
        digests, of = f["digest"].tolist(), pd.factorize(f["label"])[0]
        sizes = np.array([len(x) for x in xs])
        flat, owner = np.concatenate(xs), np.repeat(np.arange(len(xs)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        found = []
        for k in np.flatnonzero(of != np.bincount(of).argmax()).tolist():
            low, high = np.searchsorted(flat, xs[k], "left"), np.searchsorted(flat, xs[k], "right")
            count = high - low
            shared = np.bincount(owner[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())], minlength=len(xs))
            linked = np.flatnonzero((100 * shared >= percent * (sizes + sizes[k] - shared)) & (of != of[k]))
            # One link to each other component connects it.
            found += [(digests[k], digests[j]) for j in linked[np.unique(of[linked], return_index=True)[1]].tolist()]
        return pd.DataFrame(found, columns=["a", "b"])

    return m.groupBy("bucket", "i", "j").applyInPandas(compare, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = ROWS, missed: float = MISSED) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash for each row of docs (doc_id, text; other columns are ignored).

    Documents are linked if their sets share percent of their union or more. component_id is the smallest id of what links
    reach; kept is whether that is the row's own. A null or empty text, or one without words, links with nothing and is
    kept. Rows with a null id take part; their component is that of the others they reach, or null and kept. Rows that
    repeat an id are each returned and each kept where that id leads its component.
    """
    bands = bands_for(percent / 100, rows, missed)
    d = documents(docs)
    s = written(signed(d.withColumn("same", F.xxhash64("text")), size, bands, rows), "signatures")
    classes = written(s.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    # Buckets with two classes or more, and the classes in them.
    rows_of = classes.select(F.explode("bands").alias("bucket"), "digest", "n")
    shared = rows_of.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = written(rows_of.join(shared, "bucket"), "members")
    labels = None
    if not members.isEmpty():
        wanted = written(members.select("digest").distinct().join(classes.select("digest", "rep"), "digest").select("rep").distinct(), "wanted")
        same = d["doc_id"].eqNullSafe(wanted["rep"])
        some = d.join(F.broadcast(wanted) if fits(wanted, BROADCAST_IDS) else wanted, same, "left_semi")
        # An id that repeats may bring the same set more than once.
        sets = written(sets_of(some, size).groupBy("digest").agg(F.first("set").alias("set")), "sets")
        shared_buckets = members
        members = written(bounded(members, sets, percent), "members")
        discard(shared_buckets)
        discard(wanted)
        # The pivot is the class with the fewest shingles of its own: the most central one.
        pivot = members.groupBy("bucket").agg(F.min(F.struct("own", "digest", "n")).alias("pivot"))
        overlap = F.least(F.col("n") - F.col("own"), F.col("pivot.n") - F.col("pivot.own"))
        possible = 100 * overlap >= percent * (F.col("n") + F.col("pivot.n") - overlap)
        pairs = members.join(pivot, "bucket").where(possible & (F.col("digest") != F.col("pivot.digest")))
        links = written(verified(pairs.select(F.col("digest").alias("a"), F.col("pivot.digest").alias("b")).distinct(), sets, percent), "verified")
        labels = components(links)
        # Buckets of two have been compared; of the others, those that still hold different components are compared in full.
        rest = members.join(labels.select(F.col("node").alias("digest"), "label"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
        rest = written(rest.join(pivot.select("bucket", F.col("pivot.digest").alias("digest")), ["bucket", "digest"], "left_anti"), "rest")
        open_buckets = rest.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("bucket")
        more = written(settled(rest.join(open_buckets, "bucket", "left_semi"), sets, percent), "verified")
        if not more.isEmpty():
            labels = components(links.union(more))
        for t in (members, rest, sets):
            discard(t)
    of_class = classes.select("digest", "rep")
    if labels is not None:
        grouped = of_class.join(labels.select(F.col("node").alias("digest"), "label"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
        least = grouped.groupBy("label").agg(F.min("rep").alias("component_id"))
        of_class = grouped.join(least, "label").select("digest", "component_id")
    else:
        of_class = of_class.withColumnRenamed("rep", "component_id")
    out = s.select("doc_id", "same", "digest", "n").join(of_class, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), F.col("same").alias("text_hash"))


def brute_force(texts: dict[int, str | None], size: int, percent: int) -> dict[int, tuple[int, int, bool]]:
    """n_shingles, component_id, kept by id, over all pairs of documents; for tests."""
    import re

    sets: dict[int, set] = {}
    for i, t in texts.items():
        words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    component = {i: i for i in sets}

    def top(i: int) -> int:
        while component[i] != i:
            i = component[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                x, y = sorted((top(i), top(j)))
                component[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}
