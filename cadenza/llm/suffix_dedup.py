"""Removes every byte covered by a string of some length (400 bytes) that starts twice or more anywhere in the table.

Each window of that length has an anchor: its smallest hashed 32-byte gram, the leftmost if several are as small. The anchor
depends on the window's bytes alone, so equal windows have equal anchors at equal places, and consecutive windows of a text
with one anchor form a run. Runs whose anchor gram is the only one of its kind hold no repeat. Runs with equal bytes repeat as a
whole. Only runs that share a gram but differ are compared window by window:

* They are dealt by gram, and each task keeps a logarithmic family of suffix arrays: a new batch of runs gets a suffix array,
  is merge-scanned against every level for matches of full length, and levels of equal size merge.
* A gram with very many different runs is dealt by windows instead. Blocks of eight neighbouring windows are counted by digest:
  a block that repeats settles all eight, a block whose common core is unique settles them too, and only the windows
  of what is left are counted one by one. Rows are linear in the bytes, and counts are combined before they move.

`Index` keeps such a family of levels for batches of documents in the shared folder: a level is a table of runs in the order of
their grams, a new batch is scanned against all levels, and levels of equal size merge.

Texts are copied once, as they are read, into a table whose files are known by number. From then on only places move:
a task that needs texts gets the places in some of the files, and reads those files itself.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, map_documents, open_filesystem, small_batches, tidy, workspace, written
from .minhash import scatter

LENGTH, GRAM = 400, 32
#: Different runs of a gram beyond which its windows are counted by hash.
HOT = 2_048
#: Windows in a block.
BLOCK = 8
#: Bytes of runs in a batch of the family, and in a task.
BATCH_BYTES, TASK_BYTES = 1 << 20, 8 << 20
#: Bytes of text in a row group of the copy, which a reader holds at once.
GROUP_BYTES = 16 << 20
_PLACE = np.uint64((1 << 30) - 1)


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each place on."""
    n = len(data) - GRAM + 1
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    at = np.ndarray((len(data),), dtype="<u8", buffer=padded, strides=(1,))
    h = at[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k, f in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
        h ^= h >> np.uint64(29)
        h += at[k : k + n]
        h *= np.uint64(f)
    return scatter(h)


def _sliding_places(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost smallest hash (of its upper 34 bits) in each window of width hashes."""
    n = len(h)
    room = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    room[:n] = h & ~_PLACE | np.arange(n, dtype=np.uint64)
    blocks = room.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & _PLACE).astype(np.int64)


def runs(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of (text number, first window, last window, anchor less first window, gram hash) and the joined bytes with each text's start."""
    long = [k for k, t in enumerate(texts) if len(t) >= length]
    if not long:
        return
    data = np.frombuffer(b"".join(texts[k] for k in long), dtype=np.uint8)
    sizes = np.array([len(texts[k]) for k in long])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    h = _grams(data)
    places = _sliding_places(h, length - GRAM + 1)
    inside = np.zeros(len(data) + 1, dtype=np.int32)
    inside[begins] += 1
    np.add.at(inside, ends - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside)[: len(places)])
    anchor = places[starts]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))
    first = starts[new]
    last = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
    of = np.searchsorted(ends, first, side="right")
    yield np.array(long)[of], first - begins[of], last - begins[of], anchor[new] - first, h[anchor[new]], data, first, last


def run_table(texts: DataFrame, length: int) -> DataFrame:
    """row, s0, s1, rel, gram, digest: the runs of texts (row, text)."""

    def make() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for of, s0, s1, rel, gram, data, first, last in runs(batch.column("text").cast(pa.binary()).to_pylist(), length):
                raw = data.tobytes()
                digests = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())]
                columns = [batch.column("row").take(pa.array(of)), *(pa.array(x.astype(np.int32)) for x in (s0, s1, rel)), pa.array(gram.astype(np.int64)), pa.array(digests, pa.binary())]
                out = pa.RecordBatch.from_arrays(columns, ["row", "s0", "s1", "rel", "gram", "digest"])
                for at in range(0, out.num_rows, 100_000):
                    yield out.slice(at, 100_000)

        return kernel

    return map_documents(texts, make, "row long, s0 int, s1 int, rel int, gram long, digest binary")


def _ranks(high: np.ndarray, low: np.ndarray | None) -> np.ndarray:
    """Dense ranks of pairs (or of numbers below 2**32, without low).

    Up to 2**20 numbers fit one integer with their place, so that a plain sort, which is far faster than one that tracks
    places, gives the order.
    """
    n = len(high)
    small = n <= 1 << 20
    if low is not None and not small:
        return np.unique(high * np.uint64(n + 2) + low, return_inverse=True)[1].astype(np.uint64)
    key = high if low is None else high << np.uint64(21) | low
    if not small:
        return np.unique(key, return_inverse=True)[1].astype(np.uint64)
    key = np.sort(key << np.uint64(20) | np.arange(n, dtype=np.uint64))
    place = (key & np.uint64((1 << 20) - 1)).astype(np.int64)
    key >>= np.uint64(20)
    rank = np.empty(n, dtype=np.uint64)
    rank[place] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]).astype(np.uint64) if n else rank
    return rank


class Family:
    """A logarithmic family of suffix arrays over the windows of runs.

    All bytes lie in one array; a level is the places of windows in the order of their first `length` bytes.
    """

    def __init__(self, length: int):
        self.length, self.levels = length, []  # (batches, places)
        self.data = np.zeros(1 << 16, dtype=np.uint8)
        self.used = 0
        self.repeats = np.zeros(1 << 16, dtype=bool)

    def _key(self, places: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k + 8 of windows as integers in the order of the bytes (what is past the window is cut off)."""
        at = np.ndarray((len(self.data) - 8,), dtype=">u8", buffer=self.data, strides=(1,))
        key = at[places + 8 * k].astype(np.uint64)
        rest = self.length - 8 * k
        return key if rest >= 8 else key >> np.uint64(8 * (8 - rest))

    def _array(self, start: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """places in the order of their windows, and whether each equals the one before: ranks of 8 bytes, doubled up to the length."""
        end = self.used
        four = np.ndarray((len(self.data) - 8,), dtype=">u4", buffer=self.data, strides=(1,))[start:end].astype(np.uint64)
        n = end - start
        rank = _ranks(four, None)
        reach = 4
        while reach < self.length:
            step = min(reach, self.length - reach)
            after = np.zeros(n, dtype=np.uint64)
            after[: n - step] = rank[step:] + np.uint64(1)
            rank = _ranks(rank, after)
            reach += step
        own = rank[places - start]
        order = np.argsort(own, kind="stable")
        own = own[order]
        return places[order], np.append(False, own[1:] == own[:-1])

    def _scan(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the sorted windows a, the first place in the sorted b that isn't smaller, and whether it is equal."""
        key = self._key(b, 0)
        ours = self._key(a, 0)
        low, high = np.searchsorted(key, ours, "left"), np.searchsorted(key, ours, "right")
        words = -(-self.length // 8)
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            left = np.arange(len(open_))
            less = np.zeros(len(open_), dtype=bool)  # whether b's window is smaller
            for k in range(1, words):
                x, y = self._key(b[middle[left]], k), self._key(a[open_[left]], k)
                less[left[x < y]] = True
                left = left[x == y]
                if not len(left):
                    break
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        equal = np.flatnonzero(low < len(b))
        for k in range(words):
            equal = equal[self._key(b[low[equal]], k) == self._key(a[equal], k)]
        found = np.zeros(len(a), dtype=bool)
        found[equal] = True
        return low, found

    def add(self, contents: list[bytes]) -> list[int]:
        """A new batch of runs; gives the place of each."""
        raw = b"".join(contents)
        need = self.used + len(raw) + self.length + 16
        if need > len(self.data):
            grown = max(need, 2 * len(self.data))
            self.data, self.repeats = np.resize(self.data, grown), np.resize(self.repeats, grown)
            self.data[self.used :], self.repeats[self.used :] = 0, False
        start = self.used
        self.data[start : start + len(raw)] = np.frombuffer(raw, dtype=np.uint8)
        self.used += len(raw)
        sizes = np.array([len(c) for c in contents])
        begins = start + np.cumsum(sizes) - sizes
        windows = sizes - self.length + 1
        places = np.repeat(begins - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
        places, same = self._array(start, places)
        self.repeats[places[same]] = True
        self.repeats[places[np.append(same[1:], False)]] = True
        for _, level in self.levels:
            low, found = self._scan(places, level)
            self.repeats[places[found]] = True
            self.repeats[level[low[found]]] = True
        self.levels.append((1, places))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (m, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((n + m, np.insert(b, self._scan(a, b)[0], a)))
        return begins.tolist()

    def spans(self, begin: int, size: int) -> list[tuple[int, int]]:
        """Bytes of a run (from its start) that repeated windows cover."""
        starts = np.flatnonzero(self.repeats[begin : begin + size - self.length + 1])
        return covered(starts, self.length)


def covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The union of [s, s + length) over sorted starts, as maximal spans."""
    if not len(starts):
        return []
    cut = np.flatnonzero(starts[1:] > starts[:-1] + length)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist()))


def family_spans(contents: DataFrame, length: int, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """row, lo, hi: repeated bytes of the single runs among contents (row, s0, copies, content), all of a gram in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, keys, places, waiting = Family(length), [], [], []

        def flush() -> None:
            places.extend(zip(family.add(waiting), map(len, waiting)))
            waiting.clear()

        held = 0
        for batch in batches:
            keys.append(batch.select(["row", "s0", "copies"]))
            for c in batch.column("content").to_pylist():
                if waiting and held + len(c) > batch_bytes:
                    flush()
                    held = 0
                waiting.append(c)
                held += len(c)
        if waiting:
            flush()
        at = 0
        for k in keys:
            rows = [(row, s0 + lo, s0 + hi) for (row, s0, copies), place in zip(zip(*(c.to_pylist() for c in k.columns)), places[at:]) if copies == 1 for lo, hi in family.spans(*place)]
            at += k.num_rows
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32()))], ["row", "lo", "hi"])
        del family, keys, places
        tidy()

    return contents.mapInArrow(run, "row long, lo int, hi int")


_RUN = ["gram", "row", "s0", "rel", "copies"]
_RUN_SCHEMA = "gram long, row long, s0 int, rel int, copies long"


def _blocks(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """For each run and block of windows (by distance to the anchor): digest of the bytes that all its windows share, and of all their bytes."""
    rows = []
    for k, (content, rel) in enumerate(zip(batch.column("content").to_pylist(), batch.column("rel").to_pylist())):
        nearest = rel - (len(content) - length)  # distance of the last window to the anchor
        for g in range(nearest // BLOCK, rel // BLOCK + 1):
            core = xxhash.xxh3_128_digest(content[max(0, rel - g * BLOCK) : max(0, rel - g * BLOCK - BLOCK + 1 + length)])
            whole = nearest <= g * BLOCK and g * BLOCK + BLOCK - 1 <= rel
            rows.append((k, g, core, xxhash.xxh3_128_digest(content[rel - g * BLOCK - BLOCK + 1 : rel - g * BLOCK + length]) if whole else None))
    of, g, core, all_ = zip(*rows)
    return pa.RecordBatch.from_arrays([*batch.select(_RUN).take(pa.array(of)).columns, pa.array(g, pa.int32()), pa.array(core, pa.binary()), pa.array(all_, pa.binary())], [*_RUN, "block", "core", "whole"])


def _windows(batch: pa.RecordBatch, length: int) -> pa.RecordBatch | None:
    """For each run the windows of its listed blocks: distance to the anchor, and digest."""
    rows = []
    for k, (content, rel, blocks) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("content", "rel", "blocks")))):
        for g in blocks:
            for t in range(max(g * BLOCK, rel - (len(content) - length)), min(g * BLOCK + BLOCK - 1, rel) + 1):
                rows.append((k, t, xxhash.xxh3_128_digest(content[rel - t : rel - t + length])))
    if not rows:
        return None
    of, t, h = zip(*rows)
    return pa.RecordBatch.from_arrays([*batch.select(_RUN).take(pa.array(of)).columns, pa.array(t, pa.int32()), pa.array(h, pa.binary())], [*_RUN, "distance", "digest"])


def hot_spans(contents: DataFrame, length: int) -> DataFrame:
    """The same as family_spans for grams with very many runs (gram, row, s0, rel, copies, content), dealt by digests of blocks and windows."""
    blocks = written(map_documents(contents, lambda: lambda b: _blocks(b, length), f"{_RUN_SCHEMA}, block int, core binary, whole binary", column="content"), "blocks")
    twice = lambda df, *by: written(df.groupBy(*by).count().where("count > 1").drop("count"), "twice")
    settled = written(blocks.join(twice(blocks.where("whole IS NOT NULL"), "gram", "block", "whole"), ["gram", "block", "whole"], "left_semi"), "settled")
    at = lambda less, more: (F.col("s0") + F.col("rel") - less + more).cast("int")
    spans = settled.where("copies = 1").select("row", at(F.col("block") * BLOCK + BLOCK - 1, 0).alias("lo"), at(F.col("block") * BLOCK, length).alias("hi"))
    cores = twice(blocks, "gram", "block", "core")
    left = blocks.join(settled.select("row", "s0", "block"), ["row", "s0", "block"], "left_anti").join(cores, ["gram", "block", "core"], "left_semi")
    # A window in question may equal one that its own block has settled, so both sides' blocks with that core are counted.
    asked = blocks.join(written(left.select("gram", "block", "core").distinct(), "asked"), ["gram", "block", "core"], "left_semi")
    listed = contents.join(asked.groupBy("row", "s0").agg(F.collect_list("block").alias("blocks")), ["row", "s0"])
    windows = written(map_documents(listed, lambda: lambda b: _windows(b, length), f"{_RUN_SCHEMA}, distance int, digest binary", column="content"), "windows")
    found = windows.join(twice(windows, "gram", "distance", "digest"), ["gram", "distance", "digest"], "left_semi").where("copies = 1")
    return spans.union(found.select("row", at(F.col("distance"), 0), at(F.col("distance"), length)))


def with_texts(files: DataFrame, rows: DataFrame, make: Callable[[], Callable], schema: str, every: bool) -> DataFrame:
    """Brings places to the texts: files has part and path, rows has row and more columns; the row's upper bits are its part.

    make() gives a kernel for (doc_id, text in bytes, list of the text's rows), called for each text in turn (without every: for those
    that have rows), which returns rows of schema and their size in bytes. Only rows move; texts are read from the files by the task that has their places.
    """
    spark = rows.sparkSession
    payload = [c for c in rows.columns if c != "row"]
    part = F.shiftright("row", 33).cast("int").alias("part")
    # Each part's paths come before its rows.
    marks = files.select("part", F.lit(-1).cast("long").alias("row"), "path", *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in payload))
    dealt = marks.unionByName(rows.select(part, "row", F.lit(None).cast("string").alias("path"), *payload))
    # Rows are dealt by number, so parts are spread evenly.
    dealt = dealt.repartitionById(max(1, files.agg(F.max("part")).first()[0] + 1), "part").sortWithinPartitions("part", "row", "path")
    names, kinds = zip(*(x.rsplit(" ", 1) for x in schema.split(", ")))
    types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[k] for k in kinds]

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("part", "row", "path", *payload)))

    def texts(paths: list[str]) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        for path in paths:
            fs, name = open_filesystem(path)
            with fs.open_input_file(name) as f:
                for batch in pq.ParquetFile(f).iter_batches(batch_size=256, columns=["row", "doc_id", "text"]):
                    yield from zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, out, held = make(), [], 0
        as_batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], list(names))
        for _, some in groupby(events(batches), key=lambda e: e[0]):
            paths, event = [], next(some, None)
            while event and event[1] == -1:
                paths.append(event[2])
                event = next(some, None)
            for row, doc_id, text in texts(paths):
                own = []
                while event and event[1] == row:
                    own.append(event[3:])
                    event = next(some, None)
                if own or every:
                    made, size = kernel(doc_id, text.encode("utf-8"), own)
                    out += made
                    held += size
                    if held > 4 << 20 or len(out) >= 50_000:
                        yield as_batch()
                        out, held = [], 0
                if event is None and not every:
                    break
            if event:
                raise RuntimeError(f"no text for row {event[1]}")
        if out:
            yield as_batch()
        del kernel, out
        tidy()

    small_batches(spark)
    return dealt.mapInArrow(run, schema)


class Index:
    """A family of levels over batches of documents, in the shared folder; what is found is spans (row, lo, hi) of any batch's rows.

    A level is a table of runs by bytes (gram, digest, copies, and where the first one is) in the order of the grams, dealt by gram. A new
    batch is scanned against all levels, becomes a level itself, and levels of as many batches merge.
    """

    def __init__(self, spark: SparkSession, length: int = LENGTH, hot: int = HOT):
        self.spark, self.length, self.hot = spark, length, hot
        self.files: DataFrame | None = None  # part, path
        self.parts = 0
        self.levels: list[tuple[int, DataFrame]] = []

    def copied(self, docs: DataFrame) -> DataFrame:
        """row, doc_id, text: the batch as a table whose files are known by part; row is unique over all batches."""
        path = workspace(self.spark, "texts")
        d = documents(docs).withColumn("row", F.monotonically_increasing_id() + F.lit(self.parts << 33))
        d.select("row", "doc_id", "text").write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(path)
        copy = self.spark.read.schema("row long, doc_id long, text string").parquet(path)
        files = written(copy.select(F.shiftright("row", 33).cast("int").alias("part"), F.col("_metadata.file_path").alias("path")).distinct(), "files")
        self.files = files if self.files is None else self.files.union(files)
        self.parts = (files.agg(F.max("part")).first()[0] or 0) + 1
        return copy

    def alike(self, wanted: DataFrame) -> DataFrame:
        """The wanted runs (row, s0, s1, rel, gram, copies) that can share a window with another of their gram, with kinds, how many of the gram there are.

        A window has more than its gram, and half of the rest at least lies on one side of it. So runs that share a window have the same
        bytes as far as that on the left or on the right, wherever the window lies; a hash of them tells the others apart.
        """
        length = self.length
        half = (length - GRAM + 1) // 2

        def cut(_: int | None, raw: bytes, runs: list[tuple]) -> tuple[list[tuple], int]:
            out = []
            for row, s0, s1, rel, gram, copies in runs:
                at = s0 + rel
                left = xxhash.xxh3_64_intdigest(raw[at - half : at + GRAM]) - (1 << 63) if rel >= half else None
                right = xxhash.xxh3_64_intdigest(raw[at : at + GRAM + half]) - (1 << 63) if at + GRAM + half <= s1 + length else None
                out.append((row, s0, s1, rel, gram, copies, left, right))
            return out, 64 * len(out)

        rows = wanted.select("row", F.col("row").alias("of"), "s0", "s1", "rel", "gram", "copies")
        sides = written(with_texts(self.files, rows, lambda: cut, "row long, s0 int, s1 int, rel int, gram long, copies long, left long, right long", every=False), "sides")
        shared = lambda side: written(sides.where(F.col(side).isNotNull()).groupBy("gram", side).count().where("count > 1").drop("count"), "shared-sides")
        columns = ["row", "s0", "s1", "rel", "gram", "copies"]
        found = sides.join(shared("left"), ["gram", "left"], "left_semi").select(columns).union(sides.join(shared("right"), ["gram", "right"], "left_semi").select(columns))
        kept = written(found.distinct(), "alike")
        per_gram = written(kept.groupBy("gram").agg(F.count("*").alias("kinds")), "per-gram")
        return kept.join(per_gram, "gram")

    def contents(self, wanted: DataFrame) -> DataFrame:
        """gram, row, s0, rel, copies, kinds, content of the wanted runs (row, s0, s1, rel, gram, copies, kinds)."""
        length = self.length

        def cut(_: int | None, raw: bytes, runs: list[tuple]) -> tuple[list[tuple], int]:
            out = [(gram, row, s0, rel, copies, kinds, raw[s0 : s1 + length]) for row, s0, s1, rel, gram, copies, kinds in runs]
            return out, sum(len(x[-1]) for x in out)

        rows = wanted.select("row", F.col("row").alias("of"), "s0", "s1", "rel", "gram", "copies", "kinds")
        return with_texts(self.files, rows, lambda: cut, f"{_RUN_SCHEMA}, kinds long, content binary", every=False)

    def add(self, texts: DataFrame, keep: bool = True) -> DataFrame:
        """Spans (row, lo, hi; may overlap or come again) that repeat now that texts (copied before) are there; keep: scan later batches against it too."""
        length = self.length
        r = written(run_table(texts.select("row", "text"), length), "runs")
        grams = written(r.groupBy("gram").count(), "grams")
        wanted = grams.where("count > 1").select("gram")
        old = None
        if self.levels:
            level = self.levels[0][1]
            for _, more in self.levels[1:]:
                level = level.union(more)
            old = written(level.join(grams.select("gram"), "gram", "left_semi"), "old")
            wanted = wanted.union(old.select("gram")).distinct()
        shared = written(r.join(written(wanted, "twice"), "gram", "left_semi"), "shared")
        found = shared.groupBy("gram", "digest").agg(F.count("*").alias("copies"), F.min(F.struct("row", "s0", "s1", "rel")).alias("first"))
        if old is not None:
            found = merged_runs(found.union(old))
        kinds = written(found, "kinds")
        again = written(kinds.where("copies > 1").select("gram", "digest"), "again")
        # Equal runs repeat as a whole.
        span = lambda df: df.select("row", F.col("s0").alias("lo"), (F.col("s1") + length).cast("int").alias("hi"))
        spans = span(shared.join(again, ["gram", "digest"], "left_semi"))
        if old is not None:
            spans = spans.union(span(old.join(again, ["gram", "digest"], "left_semi").select("first.*")))
        per_gram = written(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1"), "per-gram")
        differing = kinds.join(per_gram.select("gram"), "gram", "left_semi").select("gram", "copies", "first.*")
        contents = written(self.contents(self.alike(differing)), "contents")
        few = contents.where(F.col("kinds") <= self.hot)
        size = few.agg(F.sum(F.length("content"))).first()[0] or 0
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_BYTES))
        spans = spans.union(family_spans(few.select("gram", "row", "s0", "copies", "content").repartition(parts, "gram"), length))
        very = contents.where(F.col("kinds") > self.hot).drop("kinds")
        if not very.isEmpty():
            spans = spans.union(hot_spans(very, length))
        if keep:
            self._keep(r.groupBy("gram", "digest").agg(F.count("*").alias("copies"), F.min(F.struct("row", "s0", "s1", "rel")).alias("first")))
        out = written(spans, "spans")
        for t in (r, grams, shared, kinds, contents):
            discard(t)
        return out

    def _keep(self, level: DataFrame) -> None:
        ordered = lambda df: written(df.repartition("gram").sortWithinPartitions("gram", "digest"), "level")
        self.levels.append((1, ordered(level)))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (m, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((n + m, ordered(merged_runs(a.union(b)))))
            discard(a)
            discard(b)


def merged_runs(runs: DataFrame) -> DataFrame:
    """gram, digest, copies, first of several tables of them."""
    return runs.groupBy("gram", "digest").agg(F.sum("copies").alias("copies"), F.min("first").alias("first"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def removed(files: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept of every text of files, less its spans (row, lo, hi)."""

    def cut(doc_id: int | None, raw: bytes, found: list[tuple]) -> tuple[list[tuple], int]:
        gone = merged(found)
        ends = [0, *(hi for _, hi in gone)]
        kept = b"".join(raw[a:b] for a, b in zip(ends, [*(lo for lo, _ in gone), len(raw)]))
        return [(doc_id, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept)], len(kept)

    return with_texts(files, spans, lambda: cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", every=True)


def without_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes), has_repeat (whether bytes were removed) of each row of docs (doc_id, text).

    Rows are judged on the input. A null or empty text has no bytes; texts shorter than length lose nothing; repeated rows
    repeat each other's bytes, so long ones lose all; null ids are kept; other columns are ignored.
    """
    index = Index(docs.sparkSession, length, hot)
    texts = index.copied(docs)
    if texts.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, has_repeat boolean")
    return removed(index.files, index.add(texts, keep=False)).withColumn("has_repeat", F.col("n_removed") > 0)


def brute_force(texts: list[str | None], length: int) -> pd.DataFrame:
    """n_bytes, n_removed, n_spans, kept_sha256 by counting all strings of that length; for tests."""
    raws = [(t or "").encode("utf-8") for t in texts]
    seen: dict[bytes, int] = {}
    for raw in raws:
        for k in range(len(raw) - length + 1):
            seen[raw[k : k + length]] = seen.get(raw[k : k + length], 0) + 1
    rows = []
    for raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(bool(g) and not (k and gone[k - 1]) for k, g in enumerate(gone))
        rows.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
