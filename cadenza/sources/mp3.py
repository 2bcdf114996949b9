"""MPEG audio layer III: files to samples and back.

Frames are parsed one by one (side information, bit reservoir, scale factors, prefix codes); requantisation, stereo, alias
reduction, transforms and the polyphase filter bank go over all granules of a file at once, as array operations.

Tables of 256 codewords and the filter bank's window of 512 values aren't stated here: `Tables` builds them by rules (codes for
exponentially falling magnitudes; a Kaiser window made power complementary), or takes them from a file. Streams whose
encoder used the tables 13, 15, or 16 to 31 of the standard need that file; with tables up to 12 alone they don't.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from ..functions import transforms as t
from ..functions.bits import Packer
from ..functions.pcm import MP3_KBPS_V1, MP3_KBPS_V2, MP3_RATES
from ..functions.prefix import Bits, PrefixCode

# Codewords of the tables by (x, y) in row order, and of the first table of quadruples by (v, w, x, y).
WORDS = {
    1: "1 001 01 000",
    2: "1 010 000001 011 001 00001 00011 00010 000000",
    3: "11 10 000001 001 01 00001 00011 00010 000000",
    5: "1 010 000110 0000101 011 001 000100 0000100 000111 000101 0000111 00000001 0000110 000001 0000001 00000000",
    6: "111 011 00101 0000001 110 10 0011 00010 0101 0100 00100 000001 000011 00011 000010 0000000",
    7: "1 010 001010 00010011 00010000 000001010 011 0011 000111 0001010 0000101 00000011 001011 00100 0001101 00010001 00001000 000000100 "
    "0001100 0001011 00010010 000001111 000001011 000000010 0000111 0000110 00001001 000001110 000000011 0000000001 00000110 00000100 000000101 "
    "0000000011 0000000010 0000000000",
    8: "11 100 000110 00010010 00001100 000000101 101 01 0010 00010000 00001001 00000011 000111 0011 000101 00001110 00000111 000000011 "
    "00010011 00010001 00001111 000001101 000001010 0000000100 00001101 0000101 00001000 000001011 0000000101 0000000001 000001100 00000100 "
    "000000100 000000001 00000000001 00000000000",
    9: "111 101 01001 001110 00001111 000000111 110 100 0101 00101 000110 00000111 0111 0110 01000 001000 0001000 00000101 001111 00110 "
    "001001 0001010 0000101 00000001 0001011 000111 0001001 0000110 00000100 000000001 00001110 0000100 00000110 00000010 000000110 000000000",
    10: "1 010 001010 00010111 000100011 000011110 000001100 0000010001 011 0011 001000 0001100 00010010 000010101 00001100 00000111 001011 "
    "001001 0001111 00010101 000100000 0000101000 000010011 000000110 0001110 0001101 00010110 000100010 0000101110 0000010111 000010010 "
    "0000000111 00010100 00010011 000100001 0000101111 0000011011 0000010110 0000001001 0000000011 000011111 000010110 0000101001 0000011010 "
    "00000010101 00000010100 0000000101 00000000011 00001110 00001101 000001010 0000001011 0000010000 0000000110 00000000101 00000000001 "
    "000001001 00001000 000000111 0000001000 0000000100 00000000100 00000000010 00000000000",
    11: "11 100 01010 0011000 00100010 000100001 00010101 000001111 101 011 0100 001010 00100000 00010001 0001011 00001010 01011 00111 "
    "001101 0010010 00011110 000011111 00010100 00000101 0011001 001011 0010011 000111011 00011011 0000010010 00001100 000000101 00100011 "
    "00100001 00011111 000111010 000011110 0000010000 000000111 0000000101 00011100 00011010 000100000 0000010011 0000010001 00000001111 "
    "0000001000 00000001110 00001110 0001100 0001001 00001101 000001110 0000001001 0000000100 0000000001 00001011 0000100 00000110 000000110 "
    "0000000110 0000000011 0000000010 0000000000",
    12: "1001 110 10000 0100001 00101001 000100111 000100110 000011010 111 101 0110 01001 0010111 0010000 00011010 00001011 10001 0111 "
    "01011 001110 0010101 00011110 0001010 00000111 010001 01010 001111 001100 0010010 00011100 00001110 00000101 0100000 001101 0010110 "
    "0010011 00010010 00010000 00001001 000000101 00101000 0010001 00011111 00011101 00010001 000001101 00000100 000000010 00011011 0001100 "
    "0001011 00001111 00001010 000000111 000000100 0000000001 000011011 00001100 00001000 000001100 000000110 000000011 000000001 0000000000",
}
QUADS = "1 0101 0100 00101 0110 000101 00100 000100 0111 00011 00110 000000 00111 000010 000011 000001"
# Extra bits of values from 15 on, of tables 16 to 31.
LINBITS = [1, 2, 3, 4, 6, 8, 10, 13, 4, 5, 6, 7, 8, 9, 11, 13]
# Offsets of scale factor bands by rate, of long blocks and of one window of short blocks.
LONG_BANDS = {
    44100: [0, 4, 8, 12, 16, 20, 24, 30, 36, 44, 52, 62, 74, 90, 110, 134, 162, 196, 238, 288, 342, 418, 576],
    48000: [0, 4, 8, 12, 16, 20, 24, 30, 36, 42, 50, 60, 72, 88, 106, 128, 156, 190, 230, 276, 330, 384, 576],
    32000: [0, 4, 8, 12, 16, 20, 24, 30, 36, 44, 54, 66, 82, 102, 126, 156, 194, 240, 296, 364, 448, 550, 576],
    22050: [0, 6, 12, 18, 24, 30, 36, 44, 54, 66, 80, 96, 116, 140, 168, 200, 238, 284, 336, 396, 464, 522, 576],
    24000: [0, 6, 12, 18, 24, 30, 36, 44, 54, 66, 80, 96, 114, 136, 162, 194, 232, 278, 332, 394, 464, 540, 576],
    16000: [0, 6, 12, 18, 24, 30, 36, 44, 54, 66, 80, 96, 116, 139, 168, 200, 238, 284, 336, 396, 464, 522, 576],
    11025: [0, 6, 12, 18, 24, 30, 36, 44, 54, 66, 80, 96, 116, 140, 168, 200, 238, 284, 336, 396, 464, 522, 576],
    12000: [0, 6, 12, 18, 24, 30, 36, 44, 54, 66, 80, 96, 116, 140, 168, 200, 238, 284, 336, 396, 464, 522, 576],
    8000: [0, 12, 24, 36, 48, 60, 72, 88, 108, 132, 160, 192, 232, 280, 336, 400, 476, 566, 568, 570, 572, 574, 576],
}
SHORT_BANDS = {
    44100: [0, 4, 8, 12, 16, 22, 30, 40, 52, 66, 84, 106, 136, 192],
    48000: [0, 4, 8, 12, 16, 22, 28, 38, 50, 64, 80, 100, 126, 192],
    32000: [0, 4, 8, 12, 16, 22, 30, 42, 58, 78, 104, 138, 180, 192],
    22050: [0, 4, 8, 12, 18, 24, 32, 42, 56, 74, 100, 132, 174, 192],
    24000: [0, 4, 8, 12, 18, 26, 36, 48, 62, 80, 104, 136, 180, 192],
    16000: [0, 4, 8, 12, 18, 26, 36, 48, 62, 80, 104, 134, 174, 192],
    11025: [0, 4, 8, 12, 18, 26, 36, 48, 62, 80, 104, 134, 174, 192],
    12000: [0, 4, 8, 12, 18, 26, 36, 48, 62, 80, 104, 134, 174, 192],
    8000: [0, 8, 16, 24, 36, 52, 72, 96, 124, 160, 162, 164, 166, 192],
}
# Widths of scale factors by their code, in the lower and the upper bands, and what preflag adds.
WIDTHS = ([0, 0, 0, 0, 3, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4], [0, 1, 2, 3, 0, 1, 2, 3, 1, 2, 3, 1, 2, 3, 2, 3])
PRETAB = [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 3, 3, 3, 2, 0]
#: Long bands that share a flag for scale factors of the granule before.
SHARED = [(0, 6), (6, 11), (11, 16), (16, 21)]

LINES, BANDS, SLOTS = 576, 32, 18
LONG, START, SHORT, STOP = range(4)
#: Samples by which decoded ones lag behind encoded ones: the filter bank's 481 and a granule.
DELAY = 481 + LINES
MOST = 8191 + 15


@lru_cache
def prototype(size: int = 512, beta: float = 8.8) -> np.ndarray:
    """A low pass for the filter bank, by rule: a Kaiser window times a sinc, whose cutoff makes the bank give the signal back as well as can be."""
    n = np.arange(size + 1) - size / 2
    shape = np.kaiser(size + 1, beta)

    def leak(cutoff: float) -> tuple[float, np.ndarray]:
        h = shape * cutoff * np.sinc(cutoff * n)
        g = np.correlate(h, h, "full")[size :: 2 * BANDS]
        return float(np.abs(g[1:]).max() / g[0]), h / np.sqrt(g[0])

    low, high = 0.5 / BANDS, 0.6 / BANDS
    for _ in range(80):  # golden section
        a, b = high - 0.618034 * (high - low), low + 0.618034 * (high - low)
        if leak(a)[0] < leak(b)[0]:
            high = b
        else:
            low = a
    # The bank's gain is one.
    return leak((low + high) / 2)[1][:size] / 4


def _rule_code(rate: float) -> PrefixCode:
    return PrefixCode.of_weights([float(np.exp(-rate * (x + y))) for x in range(16) for y in range(16)], 19)


@dataclass
class Tables:
    """Codes of the tables 13, 15, 16 (to 23) and 24 (to 31), and the filter bank's window (the low pass, all signs as they are)."""

    codes: dict[int, PrefixCode]
    window: np.ndarray

    @classmethod
    @lru_cache(maxsize=1)
    def by_rule(cls) -> Tables:
        return cls({13: _rule_code(0.6), 15: _rule_code(0.4), 16: _rule_code(0.5), 24: _rule_code(0.3)}, prototype())

    @classmethod
    def load(cls, path: str) -> Tables:
        """From a text file: lines of a table's number and its 256 codewords in binary, or of "window" and 512 values; what it lacks is by rule."""
        rule = cls.by_rule()
        out = cls(dict(rule.codes), rule.window)
        with open(path, encoding="ascii") as f:
            for line in f:
                name, _, rest = line.partition(" ")
                if name == "window":
                    out.window = np.array(rest.split(), dtype=float)
                elif name.strip():
                    out.codes[int(name)] = PrefixCode.of_words(rest)
        if len(out.window) != 512 or any(len(c.codes) != 256 for c in out.codes.values()):
            raise ValueError("512 values of the window and 256 codewords of each table are expected")
        return out

    def code(self, table: int) -> tuple[PrefixCode, int, int]:
        """Code, values of each of the pair, and extra bits of a table."""
        if table < 13:
            return _small(table)
        return (self.codes[16 if 16 <= table < 24 else 24 if table >= 24 else table], 16, LINBITS[table - 16] if table >= 16 else 0)


@lru_cache(maxsize=None)
def _small(table: int) -> tuple[PrefixCode, int, int]:
    code = PrefixCode.of_words(WORDS[table])
    return code, int(len(code.codes) ** 0.5), 0


@lru_cache(maxsize=2)
def quad_code(second: bool) -> PrefixCode:
    return PrefixCode([15 - k for k in range(16)], [4] * 16) if second else PrefixCode.of_words(QUADS)


@dataclass
class Header:
    mpeg1: bool
    protected: bool
    kbps: int
    rate: int
    padding: int
    mode: int
    extension: int
    size: int
    word: int

    @property
    def channels(self) -> int:
        return 1 if self.mode == 3 else 2

    @property
    def granules(self) -> int:
        return 2 if self.mpeg1 else 1

    @property
    def side_bytes(self) -> int:
        return (17 if self.channels == 1 else 32) if self.mpeg1 else (9 if self.channels == 1 else 17)

    @property
    def mid_side(self) -> bool:
        return self.mode == 1 and bool(self.extension & 2)


def parse_header(data: bytes, at: int = 0) -> Header | None:
    """The header at `at`, or None if there is no valid one of this layer (free format isn't one)."""
    if len(data) < at + 4:
        return None
    w = int.from_bytes(data[at : at + 4], "big")
    version, kbps, rate = w >> 19 & 3, w >> 12 & 15, w >> 10 & 3
    if w >> 21 != 0x7FF or version == 1 or w >> 17 & 3 != 1 or kbps in (0, 15) or rate == 3 or w & 3 == 2:
        return None
    mpeg1 = version == 3
    kbps = (MP3_KBPS_V1 if mpeg1 else MP3_KBPS_V2)[kbps]
    hertz = MP3_RATES[rate] // {3: 1, 2: 2, 0: 4}[version]
    padding = w >> 9 & 1
    return Header(mpeg1, not w >> 16 & 1, kbps, hertz, padding, w >> 6 & 3, w >> 4 & 3, (144000 if mpeg1 else 72000) * kbps // hertz + padding, w)


def header_word(rate: int, kbps: int, channels: int, padding: int = 0, mid_side: bool = False) -> int:
    """A header of this layer, without checksum."""
    step = next(k for k in (1, 2, 4) if rate * k in MP3_RATES)
    index = (MP3_KBPS_V1 if step == 1 else MP3_KBPS_V2).index(kbps)
    mode = 3 if channels == 1 else 1 if mid_side else 0
    return 0x7FF << 21 | {1: 3, 2: 2, 4: 0}[step] << 19 | 1 << 17 | 1 << 16 | index << 12 | MP3_RATES.index(rate * step) << 10 | padding << 9 | mode << 6 | (2 if mid_side else 0) << 4


@dataclass
class Granule:
    """Side information and lines of a granule of one channel."""

    length: int = 0
    big: int = 0
    gain: int = 0
    compress: int = 0
    switched: bool = False
    kind: int = LONG
    mixed: bool = False
    tables: list[int] = field(default_factory=lambda: [0, 0, 0])
    lower: list[int] = field(default_factory=lambda: [0, 0, 0])
    counts: tuple[int, int] = (0, 0)
    pre: bool = False
    coarse: bool = False
    second: bool = False
    #: Scale factors: of long bands, and of short bands by window.
    long: list[int] = field(default_factory=lambda: [0] * 22)
    short: list[list[int]] = field(default_factory=lambda: [[0] * 3 for _ in range(13)])
    lines: np.ndarray = None

    def bounds(self, rate: int) -> list[int]:
        """Ends of the three regions of big values."""
        end = min(2 * self.big, LINES)
        if self.switched:
            return [min(36, end), end, end]
        # Lines go in pairs, also where a band's edge is odd.
        first, second = (-(-LONG_BANDS[rate][min(k, 22)] // 2) * 2 for k in (self.counts[0] + 1, self.counts[0] + self.counts[1] + 2))
        return [min(first, end), min(second, end), end]


def _read_side(bits: Bits, h: Header) -> tuple[int, list[list[bool]], list[list[Granule]]]:
    begin = bits.get(9 if h.mpeg1 else 8)
    bits.get((5 if h.channels == 1 else 3) if h.mpeg1 else (1 if h.channels == 1 else 2))
    shared = [[bool(bits.get(1)) for _ in range(4)] if h.mpeg1 else [False] * 4 for _ in range(h.channels)]
    out = []
    for _ in range(h.granules):
        row = []
        for _ in range(h.channels):
            g = Granule(bits.get(12), bits.get(9), bits.get(8), bits.get(4 if h.mpeg1 else 9), bool(bits.get(1)))
            if g.switched:
                g.kind, g.mixed = bits.get(2), bool(bits.get(1))
                g.tables = [bits.get(5), bits.get(5), 0]
                g.lower = [bits.get(3) for _ in range(3)]
            else:
                g.tables = [bits.get(5) for _ in range(3)]
                g.counts = (bits.get(4), bits.get(3))
            g.pre = bool(bits.get(1)) if h.mpeg1 else False
            g.coarse, g.second = bool(bits.get(1)), bool(bits.get(1))
            row.append(g)
        out.append(row)
    return begin, shared, out


def _read_scales(bits: Bits, g: Granule, mpeg1: bool, before: Granule | None, shared: list[bool]) -> None:
    get = lambda width: bits.get(width) if width else 0
    if not mpeg1:  # as the reference's streams have them: four bits for each long band
        g.long = [bits.get(4) for _ in range(21)] + [0]
        return
    low, high = WIDTHS[0][g.compress], WIDTHS[1][g.compress]
    if g.kind == SHORT and g.switched:
        if g.mixed:
            g.long[:8] = [get(low) for _ in range(8)]
        for band in range(3 if g.mixed else 0, 12):
            g.short[band] = [get(low if band < 6 else high) for _ in range(3)]
        return
    for k, (a, b) in enumerate(SHARED):
        g.long[a:b] = before.long[a:b] if before and shared[k] else [get(low if k < 2 else high) for _ in range(b - a)]


def _read_lines(bits: Bits, g: Granule, rate: int, end: int, tables: Tables) -> None:
    out, at = [0] * (LINES + 4), 0
    for table, stop in zip(g.tables, g.bounds(rate)):
        if table in (0, 4, 14):
            at = max(at, stop)
            continue
        code, size, extra = tables.code(table)
        while at < stop and bits.at < end:
            for k, v in enumerate(divmod(bits.symbol(code), size)):
                if v == 15 and extra:
                    v += bits.get(extra)
                out[at + k] = -v if v and bits.get(1) else v
            if bits.at > end:
                out[at] = out[at + 1] = 0
                break
            at += 2
    code = quad_code(g.second)
    while at + 3 < LINES and bits.at < end:
        v = bits.symbol(code)
        for k in range(4):
            if v >> 3 - k & 1:
                out[at + k] = -1 if bits.get(1) else 1
        if bits.at > end:
            out[at : at + 4] = [0] * 4
            break
        at += 4
    g.lines = np.array(out[:LINES], dtype=np.int64)


@lru_cache(maxsize=None)
def short_order(rate: int) -> np.ndarray:
    """Where each coded line of a short block lies among 32 subbands of three windows of six lines."""
    bands, out = SHORT_BANDS[rate], []
    for a, b in zip(bands, bands[1:]):
        out += [f // 6 * 18 + w * 6 + f % 6 for w in range(3) for f in range(a, b)]
    return np.array(out)


@lru_cache(maxsize=None)
def _long_of(rate: int) -> np.ndarray:
    return np.repeat(np.arange(22), np.diff(LONG_BANDS[rate]))


@lru_cache(maxsize=None)
def _short_of(rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Band and window of each coded line of a short block."""
    widths = np.diff(SHORT_BANDS[rate])
    return np.repeat(np.arange(13), 3 * widths), np.concatenate([np.repeat(np.arange(3), w) for w in widths])


def exponents(g: Granule, rate: int) -> np.ndarray:
    """Quarter powers of two that each coded line is scaled by."""
    step = 4 if g.coarse else 2
    if g.switched and g.kind == SHORT:
        band, window = _short_of(rate)
        return g.gain - 210 - 8 * np.array(g.lower)[window] - step * np.array(g.short)[band, window]
    scales = np.array(g.long) + (np.array(PRETAB) if g.pre else 0)
    return g.gain - 210 - step * scales[_long_of(rate)]


def frames(data: bytes) -> list[tuple[int, Header]]:
    """Place and header of all whole frames."""
    at, out = 0, []
    if data[:3] == b"ID3" and len(data) > 10:
        at = 10 + sum((b & 127) << 7 * (3 - k) for k, b in enumerate(data[6:10]))
    while (at := data.find(b"\xff", at)) >= 0:
        h = parse_header(data, at)
        if h and at + h.size <= len(data):
            out.append((at, h))
            at += h.size
        else:
            at += 1
    return out


def parse(data: bytes, tables: Tables | None = None) -> tuple[Header, list[list[Granule]], list[bool], int]:
    """First header, granules (by channel) in order, whether each is coded as mid and side, and how many frames were unsound (silent)."""
    tables = tables or Tables.by_rule()
    found = frames(data)
    if not found:
        raise ValueError("no frame")
    first, main, out, mid_side, bad = found[0][1], bytearray(), [], [], 0
    last: list[Granule | None] = [None, None]
    for at, h in found:
        if (h.rate, h.channels) != (first.rate, first.channels):
            bad += 1
            continue
        start = at + 4 + (2 if h.protected else 0)
        rows: list[list[Granule]] = []
        try:
            begin, shared, rows = _read_side(Bits(data[start : start + h.side_bytes]), h)
            main += data[start + h.side_bytes : at + h.size]
            back = len(main) - (at + h.size - start - h.side_bytes) - begin
            # A back pointer beyond what is there finds zeros.
            need = -(-sum(g.length for r in rows for g in r) // 8)
            bits = Bits(bytes(max(0, -back)) + bytes(main[max(0, back) : max(0, back) + need + 8]))
            for k, row in enumerate(rows):
                for c, g in enumerate(row):
                    end = bits.at + g.length
                    _read_scales(bits, g, h.mpeg1, last[c] if k else None, shared[c])
                    _read_lines(bits, g, h.rate, end, tables)
                    bits.at, last[c] = end, g
        except EOFError:
            bad += 1
            rows = [[Granule() for _ in range(h.channels)] for _ in range(h.granules)]
        for row in rows:
            for g in row:
                g.lines = np.zeros(LINES, dtype=np.int64) if g.lines is None else g.lines
        out += rows
        mid_side += [h.mid_side] * len(rows)
        main = main[-2048:]
    return first, out, mid_side, bad


@lru_cache(maxsize=None)
def block_window(kind: int) -> np.ndarray:
    """Window of 36 of a block that isn't short."""
    long, short = t.sine_window(36), t.sine_window(12)
    rise = np.concatenate([np.zeros(6), short[:6], np.ones(6)]) if kind == STOP else long[:18]
    fall = np.concatenate([np.ones(6), short[6:], np.zeros(6)]) if kind == START else long[18:]
    return np.concatenate([rise, fall])


def hybrid(x: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Subband samples (time x 32) of granules x 32 x 18 lines."""
    raw = np.zeros((*x.shape[:2], 36))
    for kind in set(kinds.tolist()):
        at = np.flatnonzero(kinds == kind)
        if kind == SHORT:
            parts = t.imdct(x[at].reshape(-1, BANDS, 3, 6)) * t.sine_window(12)
            for w in range(3):
                raw[at, :, 6 + 6 * w : 18 + 6 * w] += parts[:, :, w]
        else:
            raw[at] = t.imdct(x[at]) * block_window(kind)
    out = raw[:, :, :18].copy()
    out[1:] += raw[:-1, :, 18:]
    out[:, 1::2, 1::2] *= -1  # odd bands run backwards
    return out.transpose(0, 2, 1).reshape(-1, BANDS)


def hybrid_analysis(bands: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The inverse: lines (granules x 32 x 18) of subband samples; a granule's block starts with the granule before."""
    g = bands.reshape(-1, SLOTS, BANDS).transpose(0, 2, 1).copy()
    g[:, 1::2, 1::2] *= -1
    blocks = np.concatenate([np.concatenate([np.zeros_like(g[:1]), g[:-1]]), g], axis=2)
    out = np.zeros_like(g)
    for kind in set(kinds.tolist()):
        at = np.flatnonzero(kinds == kind)
        if kind == SHORT:
            parts = np.stack([blocks[at, :, 6 + 6 * w : 18 + 6 * w] for w in range(3)], axis=2)
            out[at] = t.mdct(parts * t.sine_window(12)).reshape(len(at), BANDS, 18) / 3
        else:
            out[at] = t.mdct(blocks[at] * block_window(kind)) / 9
    return out


@lru_cache(maxsize=None)
def _phases(shift: int) -> np.ndarray:
    """64 x 32 cosines of the filter bank; every further 64 samples change the sign."""
    return np.cos((2 * np.arange(BANDS)[None, :] + 1) * (np.arange(64)[:, None] + shift) * np.pi / 64)


_SIGNS = np.repeat([1.0, -1.0] * 4, 64)


def polyphase_analysis(x: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Subband samples (time x 32), one for each 32 samples of x; zeros come before it."""
    x = np.concatenate([np.zeros(512 - BANDS), x])
    steps = np.lib.stride_tricks.sliding_window_view(x, 512)[::BANDS, ::-1]
    out = np.empty((len(steps), BANDS))
    for at in range(0, len(steps), 8192):
        out[at : at + 8192] = (steps[at : at + 8192] * (window * _SIGNS)).reshape(-1, 8, 64).sum(axis=1) @ _phases(-16)
    return out


def polyphase_synthesis(bands: np.ndarray, window: np.ndarray) -> np.ndarray:
    """As many samples as there are values; they lag by 481 behind what was analysed."""
    out = np.zeros((len(bands) + 15, BANDS))
    for at in range(0, len(bands), 8192):
        some = np.tile(bands[at : at + 8192] @ _phases(16).T, 8) * (window * _SIGNS * BANDS)
        for q in range(16):
            out[at + q : at + q + len(some)] += some[:, BANDS * q : BANDS * (q + 1)]
    return out[: len(bands)].ravel()


def decode(data: bytes, tables: Tables | None = None) -> tuple[int, np.ndarray]:
    """Rate and samples (frames x channels, full scale 1)."""
    tables = tables or Tables.by_rule()
    h, granules, mid_side, _ = parse(data, tables)
    x = np.zeros((h.channels, len(granules), LINES))
    kinds = np.array([[g.kind if g.switched else LONG for g in row] for row in granules]).T
    for c in range(h.channels):
        for k, row in enumerate(granules):
            lines = t.requantise(row[c].lines, exponents(row[c], h.rate))
            x[c, k, short_order(h.rate) if kinds[c, k] == SHORT else slice(None)] = lines
    if h.channels == 2:
        at = np.flatnonzero(mid_side)
        x[:, at] = np.stack(t.mid_side(x[0, at], x[1, at])) / np.sqrt(2)
    out = []
    for c in range(h.channels):
        y = x[c].reshape(-1, BANDS, SLOTS)
        long = kinds[c] != SHORT
        y[long] = t.alias_butterflies(y[long])
        out.append(polyphase_synthesis(hybrid(y, kinds[c]), tables.window))
    return h.rate, np.stack(out, axis=1)


# ---- encoder


def granule_kinds(x: np.ndarray, ratio: float = 8.0) -> np.ndarray:
    """Kinds of the granules of a signal: short ones where a third of a granule is far louder than what comes before it."""
    n = len(x) // LINES
    energy = (np.append(x[:1], x[1:] - 0.95 * x[:-1])[: n * LINES].reshape(-1, 192) ** 2).sum(axis=1)
    past = np.array([energy[max(0, k - 3) : k].mean() if k else np.inf for k in range(len(energy))])
    attack = ((energy > ratio * np.maximum(past, 1e-4)) & (energy > 1e-3)).reshape(-1, 3).any(axis=1)
    kinds = np.zeros(n, dtype=np.int64)
    for k in range(1, n):
        last = kinds[k - 1]
        kinds[k] = SHORT if last == START or last == SHORT and attack[k] else STOP if last == SHORT else START if attack[k] else LONG
    return kinds


def masking(energy: np.ndarray, rate: int) -> np.ndarray:
    """Noise energy that the 22 long bands may have: their energy spread upwards by 10 dB a band and downwards by 25, less 12 dB; not below the threshold in quiet."""
    edges = np.array(LONG_BANDS[rate])
    khz = np.maximum((edges[1:] + edges[:-1]) / 2 * rate / 2 / LINES / 1000, 0.02)
    quiet = 3.64 * khz**-0.8 - 6.5 * np.exp(-0.6 * (khz - 3.3) ** 2) + 1e-3 * khz**4
    k, e = np.arange(22), 10 * np.log10(energy + 1e-20)
    spread = np.maximum(np.maximum.accumulate(e + 10 * k) - 10 * k, np.maximum.accumulate((e - 25 * k)[::-1])[::-1] + 25 * k)
    # Full scale stands for 96 dB.
    return 10 ** (np.maximum(spread - 12, np.minimum(quiet, 90) - 96) / 10)


def _candidates(most: int) -> list[int]:
    for limit, tables in ((0, [0]), (1, [1]), (2, [2, 3]), (3, [5, 6]), (5, [7, 8, 9]), (7, [10, 11, 12]), (15, [13, 15])):
        if most <= limit:
            return tables
    need = (most - 15).bit_length()
    return [next(k for k in range(start, start + 8) if LINBITS[k - 16] >= need) for start in (16, 24)]


def _pair_bits(pairs: np.ndarray, tables: Tables) -> tuple[float, int]:
    """Bits and number of the cheapest table for pairs of magnitudes."""
    if not len(pairs):
        return 0, 0
    best = (float("inf"), 0)
    signs = int(np.count_nonzero(pairs))
    for table in _candidates(int(pairs.max())):
        if not table:
            return 0, 0
        code, size, extra = tables.code(table)
        v = np.minimum(pairs, 15) if size == 16 else pairs
        bits = int(code.lengths[v[:, 0] * size + v[:, 1]].sum()) + signs + extra * int(np.count_nonzero(pairs >= 15))
        best = min(best, (bits, table))
    return best


def layout(q: np.ndarray, g: Granule, rate: int, tables: Tables) -> int:
    """Sets regions and tables of g for the lines q; gives the bits that they take."""
    a = np.abs(q)
    last = np.flatnonzero(a)
    end = -(-(int(last[-1]) + 1) // 2) * 2 if len(last) else 0
    big = np.flatnonzero(a[:end] > 1)
    g.big = (int(big[-1]) // 2 + 1) if len(big) else 0
    rest = -(-(end - 2 * g.big) // 4)
    if 2 * g.big + 4 * rest > LINES:  # the last two lines don't fill a quadruple
        g.big, rest = LINES // 2, 0
    if g.switched:
        g.counts = (8 if g.kind == SHORT and not g.mixed else 7, 36)
    else:
        used = int(np.searchsorted(LONG_BANDS[rate], 2 * g.big))
        first = min(max(used // 3, 1), 16)
        g.counts = (first - 1, min(max(used * 2 // 3 - first, 1), 8) - 1)
    bits, start, g.tables = 0, 0, []
    for stop in g.bounds(rate):
        n, table = _pair_bits(a[start:stop].reshape(-1, 2), tables)
        bits, start = bits + n, stop
        g.tables.append(table)
    quads = a[2 * g.big : 2 * g.big + 4 * rest].reshape(-1, 4) @ [8, 4, 2, 1]
    sizes = [int(quad_code(second).lengths[quads].sum()) for second in (False, True)]
    g.second = sizes[1] < sizes[0]
    return int(bits + min(sizes) + a[2 * g.big : 2 * g.big + 4 * rest].sum())


def _scale_bits(g: Granule) -> int:
    """Chooses the narrowest widths that hold the long scale factors; the bits they take."""
    low, high = max(g.long[:11]), max(g.long[11:21])
    fits = [(11 * a + 10 * b, k) for k, (a, b) in enumerate(zip(*WIDTHS)) if low < 1 << a and high < 1 << b]
    bits, g.compress = min(fits)
    return bits


def coded_granule(x: np.ndarray, kind: int, rate: int, budget: int, tables: Tables, rounds: int = 3) -> Granule:
    """A granule (lines in coded order) within budget bits: the lowest gain that fits, then finer steps for bands whose noise isn't masked."""
    g = Granule(switched=kind != LONG, kind=kind)
    lowest = int(np.ceil(210 + 4 * np.log2(max(float(np.abs(x).max()), 1e-12) / MOST ** (4 / 3)))) if x.any() else 210
    # No step is finer than rounding to 16 bits asks for.
    lowest = max(lowest, 210 - 4 * 17)

    def fit() -> np.ndarray:
        side = _scale_bits(g) if kind == LONG else 0
        low, high = max(0, min(lowest + 2 * max(g.long), 255)), 255
        while low < high:
            g.gain = (low + high) // 2
            if side + layout(t.quantise(x, exponents(g, rate)), g, rate, tables) <= budget:
                high = g.gain
            else:
                low = g.gain + 1
        g.gain = low
        q = t.quantise(x, exponents(g, rate))
        g.length = side + layout(q, g, rate, tables)
        return q

    q = fit()
    if kind == LONG and x.any():
        starts = LONG_BANDS[rate][:-1]
        allowed = masking(np.add.reduceat(x * x, starts), rate)
        best = None
        for _ in range(rounds):
            noise = np.add.reduceat((t.requantise(q, exponents(g, rate)) - x) ** 2, starts)
            over = np.log2(np.maximum(noise, 1e-20) / allowed)
            score = float(np.maximum(over, 0).sum())
            if best is None or score < best[0]:
                best = (score, list(g.long))
            loud = over > 0.5
            if not loud[:21].any() or loud[:21].all():
                break
            g.long = [min(s + int(o), 15 if k < 11 else 7) if o > 0.5 else s for k, (s, o) in enumerate(zip(g.long[:21], np.clip(over, 0, 3)))] + [0]
            q = fit()
        g.long = best[1]
        q = fit()
    g.lines = q
    return g


def _put_lines(out: Packer, g: Granule, rate: int, tables: Tables) -> int:
    """Fields of all pairs as columns (word, first's extra bits and sign, second's), then of the quadruples; gives their bits."""
    bits, start = 0, 0

    def put(values: list[np.ndarray], widths: list[np.ndarray]) -> int:
        w = np.stack(widths, axis=1).ravel()
        out.put_all(np.stack([v.astype(np.uint64) for v in values], axis=1).ravel(), w)
        return int(w.sum())

    for table, stop in zip(g.tables, g.bounds(rate)):
        pairs = g.lines[start:stop].reshape(-1, 2)
        start = stop
        if not table or not len(pairs):
            continue
        code, size, extra = tables.code(table)
        a = np.abs(pairs)
        v = np.minimum(a, 15) if size == 16 else a
        index = v[:, 0] * size + v[:, 1]
        values, widths = [code.codes[index]], [code.lengths[index]]
        for k in range(2):
            long = (a[:, k] >= 15) & (extra > 0)
            values += [np.where(long, a[:, k] - 15, 0), pairs[:, k] < 0]
            widths += [np.where(long, extra, 0), (a[:, k] > 0).astype(np.int64)]
        bits += put(values, widths)
    last = np.flatnonzero(g.lines)
    end = int(last[-1]) + 1 if len(last) else 0
    n = max(0, -(-(end - 2 * g.big) // 4))
    quads = g.lines[2 * g.big : 2 * g.big + 4 * n].reshape(-1, 4)
    if n:
        code, index = quad_code(g.second), np.abs(quads) @ np.array([8, 4, 2, 1])
        bits += put([code.codes[index], *(quads[:, k] < 0 for k in range(4))], [code.lengths[index], *(np.abs(quads[:, k]) for k in range(4))])
    return bits


def _put_side(out: Packer, rows: list[list[Granule]], mpeg1: bool) -> None:
    channels = len(rows[0])
    out.put(0, 9 if mpeg1 else 8)
    out.put(0, (5 if channels == 1 else 3) if mpeg1 else (1 if channels == 1 else 2))
    if mpeg1:
        out.put(0, 4 * channels)
    for row in rows:
        for g in row:
            for value, width in ((g.length, 12), (g.big, 9), (g.gain, 8), (g.compress, 4 if mpeg1 else 9), (int(g.switched), 1)):
                out.put(value, width)
            if g.switched:
                fields = [(g.kind, 2), (int(g.mixed), 1), (g.tables[0], 5), (g.tables[1], 5), *((x, 3) for x in g.lower)]
            else:
                fields = [*((x, 5) for x in g.tables), (g.counts[0], 4), (g.counts[1], 3)]
            for value, width in (*fields, *(((int(g.pre), 1),) if mpeg1 else ()), (int(g.coarse), 1), (int(g.second), 1)):
                out.put(value, width)


def _put_scales(out: Packer, g: Granule, mpeg1: bool) -> None:
    if not mpeg1:
        for s in g.long[:21]:
            out.put(s, 4)
    elif g.kind != SHORT:
        for k, s in enumerate(g.long[:21]):
            width = WIDTHS[0 if k < 11 else 1][g.compress]
            if width:
                out.put(s, width)


def encode(x: np.ndarray, rate: int, kbps: int | None = None, tables: Tables | None = None) -> bytes:
    """A file of samples (frames x 1 or 2 channels, full scale 1) at a constant bit rate; decoded samples lag by DELAY."""
    tables = tables or Tables.by_rule()
    mpeg1, channels = rate in MP3_RATES, x.shape[1]
    kbps = kbps or (128 if mpeg1 else 64)
    granules = 2 if mpeg1 else 1
    count = -(-(len(x) + DELAY) // (LINES * granules)) * granules
    padded = np.zeros((count * LINES, channels))
    padded[: len(x)] = x
    kinds = granule_kinds(padded.sum(axis=1))
    lines = []
    for c in range(channels):
        y = hybrid_analysis(polyphase_analysis(padded[:, c], tables.window), kinds)
        y[kinds != SHORT] = t.alias_butterflies(y[kinds != SHORT], inverse=False)
        y = y.reshape(-1, LINES)
        y[kinds == SHORT] = y[kinds == SHORT][:, short_order(rate)]
        lines.append(y)
    out, spent = [], 0
    for f in range(0, count, granules):
        own = [[y[f + k] for y in lines] for k in range(granules)]
        mid_side = False
        if channels == 2:
            both = [[(a + b) / np.sqrt(2), (a - b) / np.sqrt(2)] for a, b in own]
            size = lambda rows: sum(np.log2(np.add.reduceat(v * v, LONG_BANDS[rate][:-1]) + 1e-12).sum() for r in rows for v in r)
            mid_side = bool(size(both) < size(own) - 1)
            own = both if mid_side else own
        # Padding keeps the mean rate; a frame's size is that of its header.
        due = (144000 if mpeg1 else 72000) * kbps * (f // granules + 1) // rate
        base = (144000 if mpeg1 else 72000) * kbps // rate
        padding = int(due - spent > base)
        head = header_word(rate, kbps, channels, padding, mid_side)
        h = parse_header(head.to_bytes(4, "big"))
        spent += h.size
        room = 8 * (h.size - 4 - h.side_bytes)
        budget = min(room // (granules * channels) - (0 if mpeg1 else 84), 4095 - 84)
        rows = [[coded_granule(v, int(kinds[f + k]), rate, budget, tables) for v in r] for k, r in enumerate(own)]
        main = Packer()
        main.put(0, 0)
        for row in rows:
            for g in row:
                if not mpeg1:  # scale factors have a fixed size there
                    g.length += 84 - (_scale_bits(g) if g.kind == LONG else 0)
                    g.compress = 0
                _put_scales(main, g, mpeg1)
                _put_lines(main, g, rate, tables)
        side = Packer()
        _put_side(side, rows, mpeg1)
        body = main.bytes() if sum(int(w.sum()) for w in main.widths) else b""
        out.append(head.to_bytes(4, "big") + side.bytes() + body + bytes(h.size - 4 - h.side_bytes - len(body)))
    return b"".join(out)
