"""Secret scans: base patterns on the text, then a worklist of decoded layers until nothing new decodes.

A layer is a piece of text with, for each of its characters, the span of the original text it came from. URL and Unicode
escapes are unwrapped in the words that hold them, together with as many words around as a pattern can reach over, base64 words are decoded, and each
layer is scanned and decoded again. Bytes of base64 words, of escapes and of decompressed streams are decompressed wherever
a gzip or zlib stream starts; long streams come in overlapping blocks. Layers already seen in the document are not entered twice, so cycles end.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, map_documents, small_batches, tidy

#: The base patterns.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
# A run shorter than LEAST_HEX can't contain a longer one, so long runs are found directly; likewise access keys.
_LONG_ACCESS, _LONG_HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
_HINT = re.compile(r"(?ai:pass(?:word|wd)|secret|token|api_?key)")

# "%25" stands for "%", so a chain of them is taken down to its end at once (the layers between differ in the chain's length alone).
_URL = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_ESCAPE = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
_UNIT = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
_NEXT_WORD = re.compile(r"\x20+\S+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A compressed layer with more bytes is scanned in blocks of so many (its document's oversize counts those), which overlap by so many.
LAYER_BYTES, OVERLAP = 32 << 20, 1 << 20
# Bytes as they are written: escapes, and characters that stand for themselves.
_BYTES = [re.compile(url + r"([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})|\\U000000([0-9A-Fa-f]{2})|\\([nrtabfv0\\'\"])|(.)", re.S) for url in ("%", "%(?:25)*")]
_SIMPLE = dict(zip("nrtabfv0\\'\"", b"\n\r\t\a\b\f\v\0\\'\""))
_BINARY = re.compile(r"(?:%(?:25)*|\\x|\\u00|\\U000000)(?:[01][0-9A-Fa-f]|[89A-Fa-f][0-9A-Fa-f])")
_STREAM = re.compile(rb"\x1f\x8b\x08|[\x08\x18\x28\x38\x48\x58\x68\x78][\x00-\xff]")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end) of the base patterns in text, sorted."""
    found = []
    if _HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _LONG_ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]] | list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_WORD_END = re.compile(r"\s|\Z")


def _segments(text: str) -> list[tuple[int, int, int]]:
    """Words with escapes and two words on each side, across blanks only, as start, end and the end of the last word with an escape;
    those that touch are one.

    A base pattern has at most two runs of blanks (around = or :) and no other white space, so one that needs a decoded word
    lies within such a piece, and decoding pieces finds what decoding the whole text would. Escapes are looked for first and
    widened then, no further back than the piece before, so that a text is read a bounded number of times.
    """
    out: list[list[int]] = []
    for m in _ESCAPE.finditer(text):
        if out and m.start() < out[-1][2]:
            continue
        a, b = m.start(), _WORD_END.search(text, m.end()).start()
        floor = out[-1][1] if out else 0
        while a > floor and not text[a - 1].isspace():
            a -= 1
        for _ in range(2):
            k = a
            while k > floor and text[k - 1] == " ":
                k -= 1
            if k == a or k == 0:
                break
            while k > floor and not text[k - 1].isspace():
                k -= 1
            a = k
        if out and a <= out[-1][1]:
            a = out.pop()[0]
        last = b
        for _ in range(2):
            after = _NEXT_WORD.match(text, b)
            if not after:
                break
            b = after.end()
        out.append([a, b, last])
    return [(a, b, last) for a, b, last in out]


class Layer:
    """Text with the original span of each character (arrays lo and hi; None: it is the original), or one span for all."""

    __slots__ = ("hi", "lo", "text", "whole")

    def __init__(self, text: str, lo: np.ndarray | None = None, hi: np.ndarray | None = None, whole: tuple[int, int] | None = None):
        self.text, self.lo, self.hi, self.whole = text, lo, hi, whole

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The original span of text[start:end], which isn't empty."""
        return self.whole or ((start, end) if self.lo is None else (int(self.lo[start]), int(self.hi[end - 1])))


def _unescaped(layer: Layer, start: int, end: int) -> Layer:
    """Escapes of text[start:end] decoded once."""
    text: list[str] = []
    places: list[np.ndarray] = []  # first and last place in the layer of each new character
    last = start

    def plain(a: int, b: int) -> None:
        text.append(layer.text[a:b])
        places.append(np.stack([np.arange(a, b)] * 2))

    for m in _ESCAPE.finditer(layer.text, start, end):
        if m.start() > last:
            plain(last, m.start())
        last = m.end()
        first, final, characters = [], [], []
        if m[0][0] == "%":
            units = [(u.start() + m.start(), u.end() + m.start() - 1) for u in _URL.finditer(m[0])]
            k = 0
            for c in bytes(int(u[1], 16) for u in _URL.finditer(m[0])).decode("utf-8", "surrogateescape"):
                n = len(c.encode("utf-8", "surrogateescape"))
                characters.append(c if not "\ud800" <= c <= "\udfff" else "\ufffd")
                first.append(units[k][0])
                final.append(units[k + n - 1][1])
                k += n
        else:
            units = [(int(u[1] or u[2] or u[3], 16), u.start() + m.start(), u.end() + m.start() - 1) for u in _UNIT.finditer(m[0])]
            k = 0
            while k < len(units):
                code, a, b = units[k]
                if 0xD800 <= code < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1][0] < 0xE000:
                    code, b, k = 0x10000 + ((code - 0xD800) << 10) + units[k + 1][0] - 0xDC00, units[k + 1][2], k + 1
                characters.append(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd")
                first.append(a)
                final.append(b)
                k += 1
        text.append("".join(characters))
        places.append(np.array([first, final], dtype=np.int64))
    plain(last, end)
    first, final = np.concatenate(places, axis=1)
    if layer.whole:
        return Layer("".join(text), whole=layer.whole)
    return Layer("".join(text), first if layer.lo is None else layer.lo[first], final + 1 if layer.hi is None else layer.hi[final])


def _compressed(raw: bytes) -> bool:
    """Whether raw starts as gzip or zlib streams do."""
    return raw[:2] == b"\x1f\x8b" or len(raw) > 2 and raw[0] & 15 == 8 and raw[0] >> 4 < 8 and (raw[0] << 8 | raw[1]) % 31 == 0


def _inflated(raw: bytes, limit: int) -> Iterator[bytes]:
    """What the sound streams (gzip members) at raw's start hold together, in one piece of up to limit bytes or else in overlapping ones.

    A stream that breaks off or is damaged is left out if it is in the first piece; later on, what came of it until then is in.
    """
    overlap, held, fresh, given = min(OVERLAP, limit // 2), b"", 0, False
    while _compressed(raw):
        d, part, start = zlib.decompressobj(47), raw, fresh
        pieces, long = [held], False
        size = len(held)
        try:
            while not d.eof:
                got = d.decompress(part, max(1, limit - size))
                part = d.unconsumed_tail
                if not got and not part and not d.eof:
                    raise zlib.error
                pieces.append(got)
                size, fresh = size + len(got), fresh + len(got)
                if size >= limit and not (d.eof and not _compressed(d.unused_data)):
                    block = b"".join(pieces)
                    yield block
                    given, long, fresh = True, True, 0
                    pieces = [block[-overlap:] if overlap else b""]
                    size = len(pieces[0])
        except zlib.error:
            if long:
                held = b"".join(pieces)
            else:
                fresh = start
            break
        held, raw = b"".join(pieces), d.unused_data
        # Members may be padded.
        raw = raw.lstrip(b"\0") if raw[:1] == b"\0" else raw
    if held and (fresh or not given):
        yield held


def _escaped_bytes(unit: re.Pattern, text: str, start: int, end: int) -> tuple[bytes, list[int]]:
    """The bytes that text[start:end] writes with escapes, and the place of each."""
    raw, at = bytearray(), []
    for m in unit.finditer(text, start, end):
        code = m[1] or m[2] or m[3] or m[4]
        c = int(code, 16) if code else _SIMPLE[m[5]] if m[5] else ord(m[6])
        raw.append(c if c < 256 else 63)
        at.append(m.start())
    return bytes(raw), at


# What has none of these holds no secret and no layer.
_ANY = re.compile(rb"(?i:pass(?:word|wd)|secret|token|api_?key)|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_-]{16}|%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f]{2}")


def _as_text(raw: bytes) -> str | None:
    """raw as text (bytes that aren't UTF-8 as Latin-1, so that ASCII stays what it is), if it can hold anything."""
    if not _ANY.search(raw):
        return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _unpacked(word: str) -> bytes | None:
    """The bytes in a base64 word."""
    core = word.rstrip("=").replace("-", "+").replace("_", "/")
    if len(core) % 4 == 1:
        return None
    try:
        return base64.b64decode(core + "=" * (-len(core) % 4))
    except (binascii.Error, ValueError):
        return None


class _Blocks:
    """Blocks of a decompressed stream, taken one by one; all have the span of the whole."""

    def __init__(self, raw: bytes, whole: tuple[int, int], limit: int):
        self.blocks, self.whole, self.taken = _inflated(raw, limit), whole, 0


def scan(text: str, limit: int = LAYER_BYTES) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans, further spans from decoded layers, and how many compressed layers were too large to be scanned in one piece."""
    base = base_spans(text)
    found, oversize = set(base), 0
    work: list[Layer | _Blocks] = [Layer(text)]
    seen = {text}

    def new(raw: bytes, whole: tuple[int, int]) -> bool:
        # The same words elsewhere in the document give other spans, so where they are is part of what was seen.
        key = (hashlib.sha256(raw).digest(), whole)
        known = key in seen
        seen.add(key)
        return not known

    def enter(x: Layer) -> None:
        if x.text and new(x.text.encode("utf-8", "replace"), x.span(0, len(x.text))):
            for a, k, b in base_spans(x.text):
                s, e = x.span(a, b)
                found.add((s, k, e))
            work.append(x)

    while work:
        layer = work.pop()
        if isinstance(layer, _Blocks):
            raw = next(layer.blocks, None)
            if raw is None:
                continue
            layer.taken += 1
            oversize += layer.taken == 2
            # The rest of the stream waits until this block is done.
            work.append(layer)
            if layer.taken == 1 and _compressed(raw) and new(b"stream" + raw, layer.whole):
                work.append(_Blocks(raw, layer.whole, limit))
            plain = _as_text(raw)
            if plain is not None:
                enter(Layer(plain, whole=layer.whole))
            continue
        if "%" in layer.text or "\\" in layer.text:
            for a, b, last in _segments(layer.text):
                enter(_unescaped(layer, a, b))
                # Escaped once, or in chains.
                for unit in _BYTES[: 1 + ("%25" in layer.text)] if _BINARY.search(layer.text, a, b) else ():
                    raw, at = _escaped_bytes(unit, layer.text, a, b)
                    for m in _STREAM.finditer(raw):
                        k = m.start()
                        if at[k] < last and _compressed(raw[k : k + 3]) and next(_inflated(raw[k:], min(limit, 1 << 16)), None):
                            if new(b"stream" + raw[k:], whole := layer.span(at[k], last)):
                                work.append(_Blocks(raw[k:], whole, limit))
        for m in _BASE64.finditer(layer.text):
            raw = _unpacked(m[0])
            if raw is None:
                continue
            whole = layer.span(m.start(), m.end())
            if _compressed(raw) and new(b"stream" + raw, whole):
                work.append(_Blocks(raw, whole, limit))
            plain = _as_text(raw)
            if plain is not None:
                enter(Layer(plain, whole=whole))
    return base, sorted(_not_covered(found.difference(base), base)), oversize


def _not_covered(spans: set[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """The spans that no base span of their kind (they don't overlap each other) covers."""
    by_kind: dict[int, tuple[list[int], list[int]]] = {}
    for a, k, b in base:
        starts, ends = by_kind.setdefault(k, ([], []))
        starts.append(a)
        ends.append(b)
    for a, k, b in spans:
        starts, ends = by_kind.get(k, ([], []))
        at = bisect.bisect_right(starts, a) - 1
        if at < 0 or ends[at] < b:
            yield a, k, b


def secret_scan(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_decoded, oversize.

    Base spans count in n_*; spans has these and the spans of secrets in decoded layers (those that no base span of the kind covers).
    A null or empty text has none, spans is then empty; repeated rows are each scanned; other columns are ignored.
    """
    def make():
        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch.column("text").to_pylist():
                base, more, oversize = scan(text)
                n = [sum(k == x for _, x, _ in base) for k in range(3)]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)), len(more), oversize))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded", "oversize"])

        return kernel

    return map_documents(documents(docs), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long, oversize long")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by mark; texts without secrets and all other columns stay as they are."""
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for k, text in enumerate(texts):
                if text:
                    base, more, _ = scan(text)
                    out, last = [], 0
                    for a, _, b in sorted(base + more):
                        if a >= last:
                            out += [text[last:a], mark]
                        last = max(last, b)
                    texts[k] = "".join(out) + text[last:] if base or more else text
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)
        tidy()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)
