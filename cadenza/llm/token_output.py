"""Token ids as binary shards: each document is one zstandard frame made with a dictionary that all shards share.

A data set is a folder with one dictionary file and shards in ascending doc_id order. A shard is

    magic, id width (1 byte), sha256 of the dictionary (32 bytes)     header
    one frame per document                                            payload
    doc_id (int64), null flag (uint8), frame offset (uint64), ids (uint64), for each document     index, by column
    index offset, documents, ids (uint64 each), magic                 footer

all little-endian. A reader gets one document with the footer, the index and one ranged read.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, open_filesystem, slices, small_batches, tidy, workspace, written

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MAGIC = b"TOKSHRD1"
#: The id appended to each document.
END_ID = 0
#: The dictionary is fitted on so many documents at most (drawn with a fixed seed; it affects sizes only), so many characters of each.
SAMPLE_DOCUMENTS, SAMPLE_CHARACTERS, SEED = 400, 16_384, 11
DICTIONARY_BYTES = 64 << 10
#: A shard ends at the first document that takes it past this size.
SHARD_BYTES = 128 << 20
#: Text bytes that are encoded at once.
ENCODED_BYTES = 16 << 20
#: Words whose tokens are Python objects at a time.
WORDS = 4_096

# Texts with white space other than blank, tab and line feed are encoded whole (patterns of Arrow's RE2).
_UNUSUAL = r"[\x00-\x08\x0b-\x1f\x7f-\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]|<\|"
_WIDE = r"[ \t\n][ \t\n]|\A[ \t\n]|[ \t\n]\z"
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_TAIL = ".,!?*#$%&|;:"
_BLANK = "\u0120"
# Characters that stand for bytes (fixed values of the format): the visible ones of Latin-1 for themselves, from U+0100 on for the rest in order; a blank parts words here.
_HIDDEN = [x for x in range(256) if x <= 0x20 or 0x7F <= x <= 0xA0 or x == 0xAD]
_ALPHABET = "".join(" " if x == 0x20 else chr(0x100 + _HIDDEN.index(x)) if x in _HIDDEN else chr(x) for x in range(256))
_ID = attrgetter("id")


def _after(texts: pa.Array, heads: pa.Array) -> pa.Array:
    """What follows the heads (each text starts with its own) in texts."""
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    skipped = pc.binary_length(heads).to_numpy().astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    begin = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts)].astype(np.int64) if len(texts) else np.zeros(0, dtype=np.int64)
    left = sizes - skipped
    ends = np.cumsum(left)
    at = np.repeat(begin + skipped - ends + left, left) + np.arange(ends[-1] if len(ends) else 0)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data[at]))


class ByteEncoder:
    """The ids of a tokenizers file, piece by piece.

    A blank between two characters that are not white space always starts a new pre-token, and so does the punctuation after
    letters; the ids of a text are those of its pieces cut there. Pieces repeat: of each batch of texts, each distinct one is
    encoded by the tokenizers library once, and numpy puts the texts' ids together. Nothing is kept between batches.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize = self.tokenizer.model.tokenize

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        ids = self.whole(texts)
        return np.frombuffer(b"".join(ids), dtype="<u4"), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words (letters only), each after a blank: such a word is one pre-token, so the library's model gets it as it is, in the byte alphabet."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_buffer()
        spelt = charmap_decode(joined, "strict", _ALPHABET)[0].split(" ") if len(words) else []
        ids, sizes = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(spelt), WORDS):
            tokens = [self.tokenize(_BLANK + x) for x in spelt[at : at + WORDS]]
            sizes.append(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)))
            ids.append(np.fromiter(map(_ID, chain.from_iterable(tokens)), dtype="<u4", count=int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def _pieces(self, heads: list[str], later: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of each entry, as bytes; a row of two entries for each piece: those of later (after a blank), then heads (as they are)."""
        cores = pc.utf8_rtrim(later, characters=_TAIL)
        plain = pc.utf8_is_alpha(cores).to_numpy(zero_copy_only=False)
        words = cores.filter(pa.array(plain)).dictionary_encode()
        tails = _after(later, cores).filter(pa.array(plain)).dictionary_encode()
        odd = later.filter(pa.array(~plain)).to_pylist()
        parts = [self._words(words.dictionary), self._each(tails.dictionary.to_pylist()), self._each([" " + x for x in odd]), self._each(heads)]
        sizes = np.concatenate([[0], *(n for _, n in parts)])  # the first entry has no ids
        base = np.cumsum([1, *(len(n) for _, n in parts)])
        rows = np.zeros((len(later) + len(heads), 2), dtype=np.int64)
        at = np.flatnonzero(plain)
        rows[at, 0], rows[at, 1] = base[0] + words.indices.to_numpy(), base[1] + tails.indices.to_numpy()
        rows[np.flatnonzero(~plain), 0] = base[2] + np.arange(len(odd))
        rows[len(later) :, 0] = base[3] + np.arange(len(heads))
        ids = np.concatenate([x for x, _ in parts])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(4 * np.append(0, np.cumsum(sizes))), pa.py_buffer(ids)]), rows

    def encode_array(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (none null) as little-endian 32-bit integers."""
        if not len(texts):
            return []
        whole = pc.match_substring_regex(texts, _UNUSUAL).to_numpy(zero_copy_only=False)
        wide = pc.match_substring_regex(texts, _WIDE).to_numpy(zero_copy_only=False) & ~whole
        out: list[bytes] = [b""] * len(texts)
        at = np.flatnonzero(whole)
        for k, ids in zip(at.tolist(), self.whole(texts.take(pa.array(at)).to_pylist())):
            out[k] = ids
        # Texts in a row as lists of pieces.
        at = np.flatnonzero(~(whole | wide))
        lists = [(at, pc.split_pattern(texts.take(pa.array(at)), " "))] if len(at) else []
        at = np.flatnonzero(wide)
        if len(at):
            lists.append((at, pa.array([_BETWEEN.split(x) for x in texts.take(pa.array(at)).to_pylist()], pa.list_(pa.string()))))
        for at, split in lists:
            starts = split.offsets.to_numpy()[:-1].astype(np.int64) - split.offsets[0].as_py()
            values = split.flatten()
            coded = values.dictionary_encode()
            index = coded.indices.to_numpy().astype(np.int64)
            first = values.take(pa.array(starts)).dictionary_encode()
            # What stands only at the start of texts has no ids after a blank.
            later = np.ones(len(index), dtype=bool)
            later[starts] = False
            used = np.flatnonzero(np.bincount(index[later], minlength=len(coded.dictionary)))
            place = np.zeros(len(coded.dictionary), dtype=np.int64)
            place[used] = np.arange(len(used))
            index = place[index]
            index[starts] = len(used) + first.indices.to_numpy()
            pieces, rows = self._pieces(first.dictionary.to_pylist(), coded.dictionary.take(pa.array(used)))
            ids = pieces.take(pa.array(rows[index].ravel()))
            offsets = np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset :]
            stops = offsets[2 * np.append(starts[1:], len(index))]
            data, last = memoryview(ids.buffers()[2] or b""), 0
            for k, stop in zip(at.tolist(), stops.tolist()):
                out[k] = data[last:stop].tobytes()
                last = stop
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.string()))


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    """One for each worker process, which serves many tasks."""
    return ByteEncoder(path)


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"\0" * 8 + b"".join(samples))[-size:]


def packed(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()


def unpacked(data: bytes, width: int) -> bytes:
    return data if width == 4 else np.frombuffer(data, dtype="<u2").astype("<u4").tobytes()


class ShardWriter:
    """Writes one shard; it appears under its name only once it is complete."""

    def __init__(self, uri: str, dictionary: bytes, width: int, attempt: str):
        self.fs, self.path = open_filesystem(uri)
        self.temporary = f"{self.path}.{attempt}.tmp"
        self.width, self.rows, self.ids, self.at = width, [], 0, 0
        self.out = self.fs.open_output_stream(self.temporary)
        self._put(MAGIC + bytes([width]) + hashlib.sha256(dictionary).digest())

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, frame: bytes, n: int) -> None:
        self.rows.append((doc_id or 0, doc_id is None, self.at, n))
        self.ids += n
        self._put(frame)

    def close(self) -> tuple[int, int]:
        at, columns = self.at, list(zip(*self.rows)) or [(), (), (), ()]
        for values, kind in zip(columns, ("<i8", "u1", "<u8", "<u8")):
            self._put(np.array(values, dtype=kind).tobytes())
        self._put(struct.pack("<QQQ", at, len(self.rows), self.ids) + MAGIC)
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return len(self.rows), self.ids


class Shard:
    """Reads one shard: all of it in order, or one document."""

    def __init__(self, uri: str, dictionary: bytes):
        fs, path = open_filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.index_at, self.n, self.ids, magic = struct.unpack("<QQQ8s", self.file.read_at(32, size - 32))
        head = self.file.read_at(41, 0)
        if magic != MAGIC or head[:8] != MAGIC:
            raise ValueError(f"{uri} is no shard")
        if head[9:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        self.width = head[8]
        index = self.file.read_at(25 * self.n, self.index_at)
        part = lambda kind, at: np.frombuffer(index, dtype=kind, count=self.n, offset=at * self.n)
        self.doc_ids, self.null, self.at, self.counts = part("<i8", 0), part("u1", 8), part("<u8", 9), part("<u8", 17)
        self.ends = np.append(self.at[1:], np.uint64(self.index_at))
        self.starts = np.cumsum(self.counts) - self.counts
        self.decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress

    def frame(self, k: int) -> bytes:
        return self.file.read_at(int(self.ends[k] - self.at[k]), int(self.at[k]))

    def document(self, k: int, frame: bytes | None = None) -> bytes:
        """Ids of the k-th document, as little-endian 32-bit integers."""
        return unpacked(self.decompress(self.frame(k) if frame is None else frame, max_output_size=int(self.counts[k]) * self.width), self.width)

    def find(self, doc_id: int) -> list[int]:
        """Where a document is (more than one place if its id repeats)."""
        real = np.flatnonzero(self.null == 0)
        lo, hi = np.searchsorted(self.doc_ids[real], [doc_id, doc_id + 1])
        return real[lo:hi].tolist()

    def walk(self, block: int = 4 << 20) -> Iterator[tuple[int, bytes]]:
        """All documents, read in blocks of many frames."""
        k = 0
        while k < self.n:
            last = max(k + 1, int(np.searchsorted(self.ends, self.at[k] + np.uint64(block), side="right")))
            base, data = int(self.at[k]), self.file.read_at(int(self.ends[last - 1] - self.at[k]), int(self.at[k]))
            for j in range(k, last):
                yield j, self.document(j, data[int(self.at[j]) - base : int(self.ends[j]) - base])
            k = last


def gathered(batches: Iterator[pa.RecordBatch], limit: int = ENCODED_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in fewer ones, of limit bytes at most where several come together: pieces repeat within them."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if held and size + batch.nbytes > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, bytes]:
    """Encodes docs (doc_id, text) into shards below folder; gives the manifest (part, shard, path, documents, ids) and the dictionary.

    Documents are dealt by ranges of (doc_id, hash of the text), nulls first, so rows that share an id stay in one order
    whatever the number of tasks. A null or empty text is a document with just the end id.
    """
    spark = docs.sparkSession
    folder = folder or workspace(spark, "tokens")
    d = documents(docs)
    # Rows are drawn before anything moves, so that however many partitions there are, few rows and no whole text reach the driver.
    share = min(1.0, 2 * SAMPLE_DOCUMENTS / max(1, d.count()))
    drawn = d.select(F.substring("text", 1, SAMPLE_CHARACTERS).alias("text"), F.rand(SEED).alias("drawn")).where(F.col("drawn") < share)
    sample = drawn.orderBy("drawn").limit(SAMPLE_DOCUMENTS).collect()
    local = ByteEncoder(tokenizer_path)
    width = 2 if local.tokenizer.get_vocab_size() <= 1 << 16 else 4
    end = np.array([end_id], dtype="<u4").tobytes()
    dictionary = train_dictionary([packed(x + end, width) for x in local.encode([r["text"] for r in sample])])
    fs, path = open_filesystem(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/dictionary-{hashlib.sha256(dictionary).hexdigest()}") as out:
        out.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        encode = encoder(tokenizer_path)
        compress = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)).compress
        part, shards, shard = task.partitionId(), [], None

        def done() -> None:
            shards.append((part, len(shards), f"{folder}/shard-{part:06d}-{len(shards):05d}", *shard.close()))

        for batch in gathered(batches):
            for some in slices(batch, limit=ENCODED_BYTES):
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), encode.encode_array(some.column("text"))):
                    shard = shard or ShardWriter(f"{folder}/shard-{part:06d}-{len(shards):05d}", dictionary, width, str(task.taskAttemptId()))
                    shard.add(doc_id, compress(packed(ids + end, width)), len(ids) // 4 + 1)
                    if shard.at >= shard_bytes:
                        done()
                        shard = None
        if shard:
            done()
        tidy()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*shards)) or [()] * 5, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["part", "shard", "path", "documents", "ids"])

    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = d.withColumn("same", F.xxhash64("text")).repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "same").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "same")
    manifest = written(d.select("doc_id", "text").mapInArrow(write, "part int, shard int, path string, documents long, ids long"), "manifest")
    return manifest, dictionary


def read_shards(manifest: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone; start counts the ids of all documents before it."""
    # One row per shard: the running sum needs one task, whose rows are as many as files.
    before = F.sum("ids").over(Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).alias("base")).repartition(max(1, manifest.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns)):
                shard = Shard(path, dictionary)
                crc = np.zeros(shard.n, dtype=np.int64)
                for k, ids in shard.walk():
                    crc[k] = zlib.crc32(ids)
                for at in range(0, shard.n, 50_000):
                    s = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.doc_ids[s], mask=shard.null[s] == 1), pa.array((shard.starts[s] + np.uint64(base)).astype(np.int64)), pa.array(shard.counts[s].astype(np.int64)), pa.array(crc[s])],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, **options: object) -> DataFrame:
    """Writes docs as shards and reads them back: doc_id, start, n_tokens, ids_crc32.

    Null or empty texts are one end id; null ids come first; repeated rows each have their place; an empty table gives no
    shard and no row; columns besides doc_id and text are ignored.
    """
    return read_shards(*write_shards(docs, tokenizer_path, **options))
