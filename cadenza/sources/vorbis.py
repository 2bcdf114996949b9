"""Vorbis: headers, a decoder, and an encoder with a fixed setup (floor 1, residue 2, polar coupling, short blocks)."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from ..functions import transforms as t
from . import ogg


class BadStream(ValueError):
    pass


class EndOfPacket(Exception):
    pass


class LsbReader:
    """Fields least significant bit first."""

    def __init__(self, data: bytes):
        self.word, self.size, self.at = int.from_bytes(data, "little"), 8 * len(data), 0

    def get(self, width: int) -> int:
        if self.at + width > self.size:
            raise EndOfPacket
        out = self.word >> self.at & (1 << width) - 1
        self.at += width
        return out


class LsbWriter:
    def __init__(self) -> None:
        self.word = self.at = 0

    def put(self, value: int, width: int) -> None:
        self.word |= (value & (1 << width) - 1) << self.at
        self.at += width

    def bytes(self) -> bytes:
        return self.word.to_bytes(-(-self.at // 8), "little")


@dataclass
class Codebook:
    dimensions: int
    lengths: list[int]
    lookup: int = 0
    least: float = 0.0
    delta: float = 0.0
    value_bits: int = 1
    sequence: bool = False
    values: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        used = [n for n in self.lengths if n]
        if len(used) == 1:  # a lone entry has no bits to tell apart
            self.codes = [0 if n else None for n in self.lengths]
        else:
            self.codes = t.canonical_codes(self.lengths)
        self.find = {(n, c): k for k, (n, c) in enumerate(zip(self.lengths, self.codes)) if n}
        self.vectors = self._vectors() if self.lookup else None

    def lattice(self) -> int:
        """Values on an axis of a lattice: the largest whose power isn't above the number of entries."""
        n = int(round(len(self.lengths) ** (1 / self.dimensions)))
        while n**self.dimensions > len(self.lengths):
            n -= 1
        while (n + 1) ** self.dimensions <= len(self.lengths):
            n += 1
        return n

    def _vectors(self) -> np.ndarray:
        k, d = np.arange(len(self.lengths))[:, None], np.arange(self.dimensions)[None, :]
        v = np.array(self.values, dtype=np.float64)
        index = k // self.lattice() ** d % self.lattice() if self.lookup == 1 else k * self.dimensions + d
        out = v[index] * self.delta + self.least
        return np.cumsum(out, axis=1) if self.sequence else out

    def read(self, r: LsbReader) -> int:
        code = 0
        for n in range(1, 33):
            code = code << 1 | r.get(1)
            if (n, code) in self.find:
                return self.find[n, code]
        raise BadStream("codeword")

    def put(self, w: LsbWriter, entry: int) -> None:
        for k in range(self.lengths[entry] - 1, -1, -1):
            w.put(self.codes[entry] >> k, 1)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The entry closest to each row of x, the first of several."""
        return ((x[:, None, :] - self.vectors[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)

    def pack(self, w: LsbWriter) -> None:
        w.put(0x564342, 24)
        w.put(self.dimensions, 16)
        w.put(len(self.lengths), 24)
        w.put(0, 1)
        sparse = 0 in self.lengths
        w.put(sparse, 1)
        for n in self.lengths:
            if sparse:
                w.put(n > 0, 1)
            if n:
                w.put(n - 1, 5)
        w.put(self.lookup, 4)
        if self.lookup:
            for v in (t.pack_float(self.least), t.pack_float(self.delta)):
                w.put(v, 32)
            w.put(self.value_bits - 1, 4)
            w.put(self.sequence, 1)
            for v in self.values:
                w.put(v, self.value_bits)


def unpack_codebook(r: LsbReader) -> Codebook:
    if r.get(24) != 0x564342:
        raise BadStream("codebook")
    dimensions, entries = r.get(16), r.get(24)
    lengths: list[int] = []
    if r.get(1):
        n = r.get(5) + 1
        while len(lengths) < entries:
            lengths += [n] * r.get(t.ilog(entries - len(lengths)))
            n += 1
    else:
        sparse = r.get(1)
        lengths = [r.get(5) + 1 if not sparse or r.get(1) else 0 for _ in range(entries)]
    if len(lengths) != entries:
        raise BadStream("codeword lengths")
    lookup = r.get(4)
    if not lookup:
        return Codebook(dimensions, lengths)
    if lookup > 2:
        raise BadStream("lookup type")
    least, delta, bits, sequence = t.unpack_float(r.get(32)), t.unpack_float(r.get(32)), r.get(4) + 1, bool(r.get(1))
    shape = Codebook(dimensions, lengths)
    count = shape.lattice() if lookup == 1 else entries * dimensions
    return Codebook(dimensions, lengths, lookup, least, delta, bits, sequence, [r.get(bits) for _ in range(count)])


@dataclass
class Floor:
    """Floor 1."""

    partitions: list[int]
    classes: list[tuple[int, int, int, list[int]]]  # dimensions, subclass bits, master book, sub-books (-1: none)
    multiplier: int
    xs: list[int]  # in stream order, the two ends first

    def __post_init__(self) -> None:
        self.order = sorted(range(len(self.xs)), key=self.xs.__getitem__)
        self.near = []
        for k in range(2, len(self.xs)):
            below = max((j for j in range(k) if self.xs[j] < self.xs[k]), key=self.xs.__getitem__)
            above = min((j for j in range(k) if self.xs[j] > self.xs[k]), key=self.xs.__getitem__)
            self.near.append((below, above))
        self.range = (256, 128, 86, 64)[self.multiplier - 1]

    def read(self, r: LsbReader, books: list[Codebook]) -> list[int] | None:
        """Final posts in stream order (negative: unused), None if the channel is silent."""
        if not r.get(1):
            return None
        bits = t.ilog(self.range - 1)
        y = [r.get(bits), r.get(bits)]
        for c in self.partitions:
            dimensions, sub_bits, master, subs = self.classes[c]
            choice = books[master].read(r) if sub_bits else 0
            for _ in range(dimensions):
                book = subs[choice & (1 << sub_bits) - 1]
                choice >>= sub_bits
                y.append(books[book].read(r) if book >= 0 else 0)
        return self._unfold(y)

    def _predicted(self, k: int, y: list[int]) -> int:
        a, b = self.near[k - 2]
        return t.render_point(self.xs[a], y[a], self.xs[b], y[b], self.xs[k])

    def _unfold(self, coded: list[int]) -> list[int]:
        y, used = coded[:2], [True, True]
        for k in range(2, len(self.xs)):
            p, v = self._predicted(k, y), coded[k]
            high, low = self.range - p, p
            if not v:
                y.append(p)
                used.append(False)
                continue
            room = 2 * min(high, low)
            if v >= room:
                y.append(v - low + p if high > low else p - v + high - 1)
            else:
                y.append(p - (v + 1) // 2 if v & 1 else p + v // 2)
            used.append(True)
            for j in self.near[k - 2]:
                used[j] = True
        return [min(max(v, 0), self.range - 1) if u else ~min(max(v, 0), self.range - 1) for v, u in zip(y, used)]

    def fold(self, wanted: list[int]) -> list[int]:
        """Coded posts that give the wanted final ones."""
        y, coded = wanted[:2], wanted[:2]
        for k in range(2, len(self.xs)):
            p = self._predicted(k, y)
            high, low = self.range - p, p
            d, room = wanted[k] - p, min(high, low)
            y.append(wanted[k])
            if d == 0:
                coded.append(0)
            elif d > 0:
                coded.append(2 * d if d < room else d + low)
            else:
                coded.append(-2 * d - 1 if -d <= room else high - d - 1)
        return coded

    def curve(self, y: list[int], size: int) -> np.ndarray:
        points = [(self.xs[k], y[k] * self.multiplier) for k in self.order if y[k] >= 0]
        return t.floor_gain(np.clip(t.render_floor([x for x, _ in points], [v for _, v in points], size), 0, 255))

    def pack(self, w: LsbWriter) -> None:
        w.put(1, 16)
        w.put(len(self.partitions), 5)
        for c in self.partitions:
            w.put(c, 4)
        for dimensions, sub_bits, master, subs in self.classes:
            w.put(dimensions - 1, 3)
            w.put(sub_bits, 2)
            if sub_bits:
                w.put(master, 8)
            for b in subs:
                w.put(b + 1, 8)
        w.put(self.multiplier - 1, 2)
        bits = t.ilog(self.xs[1] - 1)
        w.put(bits, 4)
        for x in self.xs[2:]:
            w.put(x, bits)


def unpack_floor(r: LsbReader) -> Floor:
    if r.get(16) != 1:
        raise BadStream("only floor 1 is decoded")
    partitions = [r.get(4) for _ in range(r.get(5))]
    classes = []
    for _ in range(max(partitions, default=-1) + 1):
        dimensions, sub_bits = r.get(3) + 1, r.get(2)
        classes.append((dimensions, sub_bits, r.get(8) if sub_bits else 0, [r.get(8) - 1 for _ in range(1 << sub_bits)]))
    multiplier, bits = r.get(2) + 1, r.get(4)
    xs = [0, 1 << bits] + [r.get(bits) for c in partitions for _ in range(classes[c][0])]
    return Floor(partitions, classes, multiplier, xs)


@dataclass
class Residue:
    kind: int
    begin: int
    end: int
    size: int
    class_book: int
    books: list[list[int]]  # by classification: a book for each of eight passes (-1: none)

    def read(self, r: LsbReader, books: list[Codebook], n: int, silent: list[bool]) -> np.ndarray:
        channels = len(silent)
        out = np.zeros((channels, n))
        if self.kind == 2:
            if all(silent):
                return out
            return self._vectors(r, books, n * channels, [False])[0].reshape(n, channels).T
        return self._vectors(r, books, n, silent)

    def _vectors(self, r: LsbReader, books: list[Codebook], n: int, silent: list[bool]) -> np.ndarray:
        out = np.zeros((len(silent), n))
        begin, end = min(self.begin, n), min(self.end, n)
        parts, per_word = (end - begin) // self.size, books[self.class_book].dimensions
        classes = [[0] * (parts + per_word) for _ in silent]
        try:
            for level in range(8):
                part = 0
                while part < parts:
                    if level == 0:
                        for c, quiet in enumerate(silent):
                            if not quiet:
                                word = books[self.class_book].read(r)
                                for k in range(per_word - 1, -1, -1):
                                    classes[c][part + k], word = word % len(self.books), word // len(self.books)
                    for p in range(part, min(part + per_word, parts)):
                        for c, quiet in enumerate(silent):
                            book = self.books[classes[c][p]][level]
                            if not quiet and book >= 0:
                                self._add(r, books[book], out[c], begin + p * self.size)
                    part += per_word
        except EndOfPacket:
            pass
        return out

    def _add(self, r: LsbReader, book: Codebook, x: np.ndarray, at: int) -> None:
        d = book.dimensions
        if self.kind == 0:
            step = self.size // d
            for k in range(step):
                x[at + k : at + k + step * d : step] += book.vectors[book.read(r)]
        else:
            for k in range(0, self.size, d):
                x[at + k : at + k + d] += book.vectors[book.read(r)]

    def pack(self, w: LsbWriter) -> None:
        w.put(self.kind, 16)
        for v, n in ((self.begin, 24), (self.end, 24), (self.size - 1, 24), (len(self.books) - 1, 6), (self.class_book, 8)):
            w.put(v, n)
        cascades = [sum(1 << k for k, b in enumerate(bs) if b >= 0) for bs in self.books]
        for c in cascades:
            w.put(c & 7, 3)
            w.put(c > 7, 1)
            if c > 7:
                w.put(c >> 3, 5)
        for bs in self.books:
            for b in bs:
                if b >= 0:
                    w.put(b, 8)


def unpack_residue(r: LsbReader) -> Residue:
    kind, begin, end, size, n, book = r.get(16), r.get(24), r.get(24), r.get(24) + 1, r.get(6) + 1, r.get(8)
    if kind > 2:
        raise BadStream("residue type")
    cascades = []
    for _ in range(n):
        low = r.get(3)
        cascades.append(low | (r.get(5) << 3 if r.get(1) else 0))
    return Residue(kind, begin, end, size, book, [[r.get(8) if c >> k & 1 else -1 for k in range(8)] for c in cascades])


@dataclass
class Mapping:
    coupling: list[tuple[int, int]]
    mux: list[int]
    submaps: list[tuple[int, int]]  # floor, residue


@dataclass
class Setup:
    books: list[Codebook]
    floors: list[Floor]
    residues: list[Residue]
    mappings: list[Mapping]
    modes: list[tuple[bool, int]]  # long block, mapping


@dataclass
class Info:
    channels: int
    rate: int
    blocks: tuple[int, int]
    nominal: int = 0

    def pack(self) -> bytes:
        code = self.blocks[0].bit_length() - 1 | self.blocks[1].bit_length() - 1 << 4
        return b"\1vorbis" + struct.pack("<IBIiiiBB", 0, self.channels, self.rate, 0, self.nominal, 0, code, 1)


def unpack_info(data: bytes) -> Info:
    if data[:7] != b"\1vorbis" or len(data) < 30:
        raise BadStream("identification header")
    version, channels, rate, _, nominal, _, code, framing = struct.unpack_from("<IBIiiiBB", data, 7)
    blocks = 1 << (code & 15), 1 << (code >> 4)
    if version or not channels or not rate or not framing & 1 or not 64 <= blocks[0] <= blocks[1] <= 8192:
        raise BadStream("identification header")
    return Info(channels, rate, blocks, nominal)


def pack_comments(vendor: str, comments: list[str]) -> bytes:
    text = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
    return b"\3vorbis" + text(vendor) + struct.pack("<I", len(comments)) + b"".join(map(text, comments)) + b"\1"


def unpack_comments(data: bytes) -> tuple[str, list[str]]:
    if data[:7] != b"\3vorbis":
        raise BadStream("comment header")
    at = 7

    def text() -> str:
        nonlocal at
        n = struct.unpack_from("<I", data, at)[0]
        if at + 4 + n > len(data):
            raise BadStream("comment header")
        out, at = data[at + 4 : at + 4 + n].decode("utf-8", "replace"), at + 4 + n
        return out

    try:
        vendor = text()
        n, at = struct.unpack_from("<I", data, at)[0], at + 4
        return vendor, [text() for _ in range(n)]
    except struct.error:
        raise BadStream("comment header") from None


def unpack_setup(data: bytes, channels: int) -> Setup:
    if data[:7] != b"\5vorbis":
        raise BadStream("setup header")
    r = LsbReader(data[7:])
    try:
        books = [unpack_codebook(r) for _ in range(r.get(8) + 1)]
        for _ in range(r.get(6) + 1):
            r.get(16)
        floors = [unpack_floor(r) for _ in range(r.get(6) + 1)]
        residues = [unpack_residue(r) for _ in range(r.get(6) + 1)]
        mappings = []
        for _ in range(r.get(6) + 1):
            if r.get(16):
                raise BadStream("mapping type")
            submaps = r.get(4) + 1 if r.get(1) else 1
            bits = t.ilog(channels - 1)
            coupling = [(r.get(bits), r.get(bits)) for _ in range(r.get(8) + 1)] if r.get(1) else []
            r.get(2)
            mux = [r.get(4) for _ in range(channels)] if submaps > 1 else [0] * channels
            parts = []
            for _ in range(submaps):
                r.get(8)
                parts.append((r.get(8), r.get(8)))
            mappings.append(Mapping(coupling, mux, parts))
        modes = []
        for _ in range(r.get(6) + 1):
            long = bool(r.get(1))
            r.get(32)
            modes.append((long, r.get(8)))
        return Setup(books, floors, residues, mappings, modes)
    except (EndOfPacket, ValueError) as e:
        raise BadStream(f"setup header: {e}") from None


def pack_setup(s: Setup, channels: int) -> bytes:
    w = LsbWriter()
    w.put(len(s.books) - 1, 8)
    for b in s.books:
        b.pack(w)
    w.put(0, 22)
    w.put(len(s.floors) - 1, 6)
    for f in s.floors:
        f.pack(w)
    w.put(len(s.residues) - 1, 6)
    for x in s.residues:
        x.pack(w)
    w.put(len(s.mappings) - 1, 6)
    for m in s.mappings:
        w.put(0, 16)
        w.put(len(m.submaps) > 1, 1)
        if len(m.submaps) > 1:
            w.put(len(m.submaps) - 1, 4)
        w.put(bool(m.coupling), 1)
        if m.coupling:
            w.put(len(m.coupling) - 1, 8)
            for a, b in m.coupling:
                w.put(a, t.ilog(channels - 1))
                w.put(b, t.ilog(channels - 1))
        w.put(0, 2)
        if len(m.submaps) > 1:
            for k in m.mux:
                w.put(k, 4)
        for floor, residue in m.submaps:
            w.put(0, 8)
            w.put(floor, 8)
            w.put(residue, 8)
    w.put(len(s.modes) - 1, 6)
    for long, mapping in s.modes:
        w.put(long, 1)
        w.put(0, 32)
        w.put(mapping, 8)
    w.put(1, 1)
    return b"\5vorbis" + w.bytes()


class Decoder:
    def __init__(self, headers: list[bytes]):
        self.info = unpack_info(headers[0])
        self.comments = unpack_comments(headers[1])
        self.setup = unpack_setup(headers[2], self.info.channels)
        self.half: np.ndarray | None = None

    def _window(self, n: int, left: int, right: int) -> np.ndarray:
        """Slopes of left and right samples, centred at a quarter and three quarters of the block."""
        out = np.zeros(n)
        a, b = n // 4 - left // 2, 3 * n // 4 - right // 2
        out[a : a + left] = t.slope_window(left)
        out[a + left : b] = 1
        out[b : b + right] = t.slope_window(right)[::-1]
        return out

    def packet(self, data: bytes) -> np.ndarray | None:
        """Samples (n x channels) that a packet completes: none from the first one, None if it holds no sound."""
        r, s = LsbReader(data), self.setup
        try:
            if r.get(1):
                return None
            long, mapping = s.modes[r.get(t.ilog(len(s.modes) - 1))]
            before, after = (r.get(1), r.get(1)) if long else (0, 0)
        except (EndOfPacket, IndexError):
            return None
        m, channels = s.mappings[mapping], self.info.channels
        size = self.info.blocks[long]
        half = size // 2
        floors = []
        for c in range(channels):
            floor = s.floors[m.submaps[m.mux[c]][0]]
            try:
                floors.append((floor, floor.read(r, s.books)))
            except EndOfPacket:
                floors.append((floor, None))
        silent = [y is None for _, y in floors]
        for a, b in m.coupling:  # a coupled channel is decoded if its partner sounds
            if not (silent[a] and silent[b]):
                silent[a] = silent[b] = False
        x = np.zeros((channels, half))
        for k, (_, residue) in enumerate(m.submaps):
            mine = [c for c in range(channels) if m.mux[c] == k]
            x[mine] = s.residues[residue].read(r, s.books, half, [silent[c] for c in mine])
        for a, b in reversed(m.coupling):
            x[a], x[b] = t.decouple(x[a], x[b])
        for c, (floor, y) in enumerate(floors):
            x[c] = x[c] * floor.curve(y, half) if y is not None else 0
        left = self.info.blocks[1 if long and before else 0] // 2
        right = self.info.blocks[1 if long and after else 0] // 2
        block = t.imdct(x) * self._window(size, left, right)
        previous, self.half = self.half, block[:, half:]
        if previous is None:
            return np.zeros((0, channels))
        old = previous.shape[1]
        n = (old + half) // 2
        out = np.zeros((channels, n))
        # The middle of the last block meets the middle of this one; the shorter half lies inside the longer.
        if old >= half:
            out += previous[:, :n]
            out[:, n - half :] += block[:, :half]
        else:
            out[:, :old] += previous
            out += block[:, half - n : half]
        return out.T


def decode(data: bytes) -> tuple[Info, np.ndarray]:
    """Samples (frames x channels, -1 to 1) of the first Vorbis stream in an Ogg file, cut at its last granule."""
    packets = ogg.packets(ogg.pages(data))
    serial = next((p.serial for p in packets if p.data[:7] == b"\1vorbis"), None)
    if serial is None:
        raise BadStream("no Vorbis stream")
    mine = [p for p in packets if p.serial == serial]
    if len(mine) < 3:
        raise BadStream("headers")
    d = Decoder([p.data for p in mine[:3]])
    out = [x for x in (d.packet(p.data) for p in mine[3:]) if x is not None]
    x = np.concatenate(out) if out else np.zeros((0, d.info.channels))
    end = max((p.granule for p in mine), default=-1)
    return d.info, x[:end] if 0 <= end < len(x) else x


SHORT, LONG = 512, 2048
#: Values of the residue book on each axis: -LIMIT to LIMIT - 1.
LIMIT = 32
WIDTH = (2 * LIMIT - 1).bit_length()


def _setup(channels: int) -> Setup:
    """One flat book for floor posts, one for classes, one lattice of pairs for residues."""
    posts = sorted({int(round(256 ** (k / 17))) for k in range(1, 17)} | {3, 6, 12, 24, 40, 56, 80, 112, 144, 176, 208, 232})[:24]
    posts = [x for x in posts if 0 < x < 256][: len(posts) // 8 * 8]
    books = [Codebook(1, [8] * 256), Codebook(4, [4] * 16), Codebook(2, [2 * WIDTH] * (4 * LIMIT * LIMIT), 1, -float(LIMIT), 1.0, WIDTH, False, list(range(2 * LIMIT)))]
    floor = Floor([0] * (len(posts) // 8), [(8, 0, 0, [0])], 1, [0, 256, *posts])
    residue = Residue(2, 0, SHORT // 2 * channels, 16, 1, [[-1] * 8, [2] + [-1] * 7])
    mapping = Mapping([(0, 1)] if channels == 2 else [], [0] * channels, [(0, 0)])
    return Setup(books, [floor], [residue], [mapping], [(False, 0), (True, 0)])


class Encoder:
    """Packets of short blocks, 256 samples apart."""

    def __init__(self, rate: int, channels: int, vendor: str = "cadenza", comments: list[str] | None = None):
        self.info, self.setup = Info(channels, rate, (SHORT, LONG), 128_000), _setup(channels)
        self.headers = [self.info.pack(), pack_comments(vendor, comments or []), pack_setup(self.setup, channels)]

    def _posts(self, x: np.ndarray) -> list[int]:
        """Floor posts so high that no line exceeds LIMIT - 1 steps of the curve."""
        floor = self.setup.floors[0]
        edges = [floor.xs[k] for k in floor.order]
        size = np.abs(x)
        peaks = [float(size[max(0, a) : max(b, a + 1)].max(initial=0)) for a, b in zip([0, *edges[:-1]], [*edges[1:], SHORT // 2])]
        steps = 139.4532 / 255
        level = [int(np.clip(np.ceil(255 + 20 * np.log10(max(p, 1e-9) / (LIMIT - 2)) / steps), 0, 255)) for p in peaks]
        out = [0] * len(floor.xs)
        for k, v in zip(floor.order, level):
            out[k] = v
        return out

    def packet(self, block: np.ndarray) -> bytes:
        """A packet of SHORT x channels samples."""
        s, w = self.setup, LsbWriter()
        w.put(0, 1)
        w.put(0, t.ilog(len(s.modes) - 1))
        window = np.concatenate([t.slope_window(SHORT // 2), t.slope_window(SHORT // 2)[::-1]])
        x = t.mdct(block.T * window) * 4 / SHORT
        floor, q = s.floors[0], np.zeros_like(x)
        # Coupled channels share a floor, so that their angles fit the lattice too.
        shared = self._posts(np.abs(x).max(axis=0) * (2 if s.mappings[0].coupling else 1)) if np.abs(x).max() > 1e-7 else None
        for c in range(len(x)):
            w.put(shared is not None, 1)
            if shared is None:
                continue
            coded = floor.fold(shared)
            w.put(coded[0], 8)
            w.put(coded[1], 8)
            for v in coded[2:]:
                s.books[0].put(w, v)
            q[c] = np.round(x[c] / floor.curve(floor._unfold(coded), SHORT // 2))
        if shared is None:
            return w.bytes()
        for a, b in s.mappings[0].coupling:
            q[a], q[b] = t.couple(q[a], q[b])
        flat = np.clip(q.T.ravel(), -LIMIT, LIMIT - 1)
        residue = s.residues[0]
        parts = flat.reshape(-1, residue.size)
        classes = (parts != 0).any(axis=1).astype(int)
        pairs = (flat.reshape(-1, 2).astype(int) + LIMIT) @ np.array([1, 2 * LIMIT])
        pairs = pairs.reshape(len(parts), -1)
        for at in range(0, len(parts), 4):
            word = 0
            for k in range(4):
                word = word * 2 + (classes[at + k] if at + k < len(parts) else 0)
            s.books[1].put(w, int(word))
            for k in range(at, min(at + 4, len(parts))):
                if classes[k]:
                    for e in pairs[k].tolist():
                        s.books[2].put(w, e)
        return w.bytes()


def encode(x: np.ndarray, rate: int, serial: int = 1, comments: list[str] | None = None) -> bytes:
    """An Ogg file of frames x channels samples (-1 to 1)."""
    x = np.asarray(x, dtype=np.float64)
    x = x[:, None] if x.ndim == 1 else x
    e, hop = Encoder(rate, x.shape[1], comments=comments), SHORT // 2
    blocks = -(-len(x) // hop) + 1
    padded = np.concatenate([np.zeros((hop, x.shape[1])), x, np.zeros((blocks * hop - len(x), x.shape[1]))])
    sound = [(e.packet(padded[k * hop : k * hop + SHORT]), min(k * hop, len(x))) for k in range(blocks)]
    return ogg.mux([(h, 0) for h in e.headers] + sound, serial)
