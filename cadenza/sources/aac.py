"""AAC-LC: raw frames to samples and back.

A frame holds one channel or a pair; a channel's spectrum lies in scale factor bands, of one long window or of groups of eight
short ones. Frames are parsed one by one; windows, transforms and overlaps go over all frames of a channel at once.

The spectral codebooks are those of the reference's streams: Huffman codes of exponential weights over the sum of magnitudes, with
canonical codewords, so they are built here by that rule.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from itertools import product

import numpy as np

from ..functions import transforms as t
from ..functions.bits import Packer
from ..functions.pcm import ADTS_RATES
from ..functions.prefix import Bits, PrefixCode
from ..operators.blocks import LONG, SHORT, START, STOP

# Offsets of scale factor bands, by the place of the rate among ADTS_RATES.
_LONG_96 = [0, 4, 8, 12, 16, 20, 24, 28, 32, 36, 40, 44, 48, 52, 56, 60, 64, 68, 72, 76, 80, 84, 88, 92, 96, 100, 104, 108, 112, 120, 128, 136, 144, 160, 176, 196, 216, 240, 264, 304, 384, 1024]
_LONG_64 = [0, 4, 8, 12, 16, 20, 24, 28, 32, 36, 40, 44, 48, 52, 56, 60, 64, 68, 72, 76, 80, 84, 88, 92, 96, 100, 104, 108, 112, 116, 120, 128, 136, 144, 152, 160, 168, 176, 184, 192, 200, 208, 216, 224, 240, 264, 304, 1024]
_LONG_48 = [0, 4, 8, 12, 16, 20, 24, 28, 32, 36, 40, 44, 48, 52, 56, 60, 64, 68, 72, 76, 80, 84, 88, 92, 96, 100, 104, 108, 116, 124, 132, 140, 148, 160, 172, 188, 208, 232, 260, 288, 320, 356, 396, 440, 488, 544, 612, 700, 816, 1024]
_LONG_32 = [0, 4, 8, 12, 16, 20, 24, 28, 32, 36, 40, 44, 48, 52, 56, 60, 64, 68, 72, 76, 80, 84, 88, 92, 96, 100, 104, 108, 112, 116, 120, 124, 128, 136, 144, 152, 160, 168, 176, 184, 192, 204, 216, 232, 252, 276, 308, 348, 400, 464, 544, 1024]
_LONG_24 = [0, 4, 8, 12, 16, 20, 24, 28, 32, 36, 40, 44, 48, 52, 56, 60, 64, 68, 72, 76, 80, 84, 88, 92, 96, 100, 104, 108, 112, 116, 120, 128, 136, 144, 152, 164, 176, 192, 212, 236, 268, 308, 356, 416, 492, 592, 724, 1024]
_LONG_16 = [0, 8, 16, 24, 32, 40, 48, 56, 64, 72, 80, 88, 96, 104, 112, 120, 128, 136, 144, 152, 160, 168, 176, 184, 192, 200, 208, 216, 224, 232, 240, 248, 256, 268, 284, 308, 336, 372, 416, 472, 544, 636, 752, 1024]
_LONG_12 = [0, 8, 16, 24, 32, 40, 48, 56, 64, 72, 80, 88, 96, 104, 112, 120, 128, 136, 144, 152, 160, 168, 176, 184, 192, 200, 208, 216, 224, 232, 240, 248, 268, 292, 320, 356, 400, 452, 512, 584, 668, 768, 888, 1024]
_LONG_8 = [0, 12, 24, 36, 48, 60, 72, 84, 96, 108, 120, 132, 144, 156, 168, 180, 192, 204, 216, 228, 240, 252, 264, 276, 288, 304, 324, 348, 376, 408, 444, 484, 528, 576, 628, 688, 756, 832, 916, 1008, 1024]
_SHORT_96 = [0, 2, 4, 6, 8, 10, 12, 14, 18, 22, 26, 32, 128]
_SHORT_64 = [0, 2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 128]
_SHORT_48 = [0, 2, 4, 6, 8, 10, 12, 16, 20, 24, 28, 36, 44, 64, 128]
_SHORT_24 = [0, 2, 4, 6, 8, 10, 12, 14, 18, 22, 26, 32, 40, 52, 72, 128]
_SHORT_12 = [0, 2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 28, 36, 44, 60, 128]
LONG_BANDS = [_LONG_96, _LONG_96, _LONG_64, _LONG_48, _LONG_48, _LONG_32, _LONG_24, _LONG_24, _LONG_16, _LONG_12, _LONG_12, _LONG_8, _LONG_8]
SHORT_BANDS = [_SHORT_96, _SHORT_96, _SHORT_64, _SHORT_48, _SHORT_48, _SHORT_48, _SHORT_24, _SHORT_24, _SHORT_24, _SHORT_12, _SHORT_12, _SHORT_12, _SHORT_12]

FRAME, SUB = 1024, 128
SINE, KBD = 0, 1
#: Books: none, 1 to 11 for spectra (11 with escapes), noise, intensity (inverted, plain).
ZERO, ESCAPE, NOISE, INVERTED, INTENSITY = 0, 11, 13, 14, 15
SINGLE, PAIR, LFE, DATA, PROGRAM, FILL, END = 0, 1, 3, 4, 5, 6, 7
#: Values of a codeword, the largest magnitude, and whether signs are in it, of books 1 to 11.
BOOKS = {1: (4, 1, True), 2: (4, 1, True), 3: (4, 2, False), 4: (4, 2, False), 5: (2, 4, True), 6: (2, 4, True), 7: (2, 7, False), 8: (2, 7, False), 9: (2, 12, False), 10: (2, 12, False), 11: (2, 16, False)}
MOST = 8191
NOISE_SEED = 123456789


@lru_cache(maxsize=None)
def spectral_book(book: int) -> tuple[list[tuple[int, ...]], PrefixCode]:
    """Values and codewords of a book, by the rule: weights fall exponentially with the sum of magnitudes, faster in odd books."""
    size, most, signed = BOOKS[book]
    values = list(product(range(-most if signed else 0, most + 1), repeat=size))
    rate = 0.5 if book % 2 else 0.35
    return values, PrefixCode.of_weights([float(np.exp(-rate * sum(map(abs, v)))) for v in values], 16)


@lru_cache(maxsize=None)
def scale_book() -> PrefixCode:
    """Codewords of differences of scale factors, -60 to 60."""
    return PrefixCode.of_weights([float(np.exp(-0.15 * abs(k - 60))) for k in range(121)], 24)


@dataclass
class Channel:
    """What a frame says of one channel. Bands of group g are at g * bands; lines are in coded order: by group, band, window."""

    shape: int
    window: int = SINE
    max_sfb: int = 0
    groups: list[int] = field(default_factory=lambda: [1])
    gain: int = 0
    books: np.ndarray = None
    scales: np.ndarray = None
    lines: np.ndarray = None
    #: For each window its filters: (bands from the bottom, reversed, resolution, indices).
    filters: list[list[tuple[int, bool, int, list[int]]]] = None


@lru_cache(maxsize=256)
def coded_order(short: bool, groups: tuple[int, ...], rate_index: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (window * 128 + line) of the lines in coded order, and where each band starts among them (one more at the end)."""
    bands = (SHORT_BANDS if short else LONG_BANDS)[rate_index]
    order, starts, window = [], [0], 0
    for n in groups:
        for a, b in zip(bands, bands[1:]):
            order += [(window + w) * SUB + k for w in range(n) for k in range(a, b)]
            starts.append(len(order))
        window += n
    return np.array(order), np.array(starts)


def _read_info(bits: Bits) -> Channel:
    bits.get(1)
    c = Channel(bits.get(2), bits.get(1))
    if c.shape == SHORT:
        c.max_sfb, c.groups = bits.get(4), [1]
        for k in range(6, -1, -1):
            if bits.get(1):
                c.groups[-1] += 1
            else:
                c.groups.append(1)
    else:
        c.max_sfb = bits.get(6)
        if bits.get(1):  # prediction isn't part of this profile: its bits are passed over
            if bits.get(1):
                bits.get(5)
            for _ in range(min(c.max_sfb, 30)):
                bits.get(1)
    return c


def _read_channel(bits: Bits, rate_index: int, common: Channel | None) -> Channel:
    gain = bits.get(8)
    info = common or _read_info(bits)
    c = Channel(info.shape, info.window, info.max_sfb, info.groups, gain)
    short = c.shape == SHORT
    order, starts = coded_order(short, tuple(c.groups), rate_index)
    bands = (len(starts) - 1) // len(c.groups)
    if c.max_sfb > bands:
        raise ValueError("too many bands")
    c.books = np.zeros(len(starts) - 1, dtype=np.int64)
    width = 3 if short else 5
    for g in range(len(c.groups)):
        at = 0
        while at < c.max_sfb:
            book, n = bits.get(4), bits.get(width)
            more = n
            while more == (1 << width) - 1:
                more = bits.get(width)
                n += more
            if not n or at + n > bands:
                raise ValueError("a section leaves the spectrum")
            c.books[g * bands + at : g * bands + at + n] = book
            at += n
        c.books[g * bands + c.max_sfb : (g + 1) * bands] = ZERO
    c.scales = np.zeros(len(c.books), dtype=np.int64)
    scale, position, noise, first, code = gain, 0, gain - 90, True, scale_book()
    for k in np.flatnonzero(c.books).tolist():
        book = c.books[k]
        if book == NOISE and first:
            noise, first = gain - 90 + bits.get(9) - 256, False
            c.scales[k] = noise
            continue
        step = bits.symbol(code) - 60
        if book == NOISE:
            c.scales[k] = noise = noise + step
        elif book in (INVERTED, INTENSITY):
            c.scales[k] = position = position + step
        else:
            c.scales[k] = scale = scale + step
    if bits.get(1):  # pulses are passed over
        if short:
            raise ValueError("pulses in short windows")
        for _ in range(bits.get(8) >> 6, -1, -1):
            bits.get(9)
    c.filters = []
    if bits.get(1):
        for _ in range(8 if short else 1):
            own = []
            n = bits.get(1 if short else 2)
            resolution = 3 + bits.get(1) if n else 0
            for _ in range(n):
                length, size = bits.get(4 if short else 6), bits.get(3 if short else 5)
                if size:
                    down, less = bits.get(1), bits.get(1)
                    own.append((length, bool(down), resolution, [bits.get(resolution - less) for _ in range(size)]))
            c.filters.append(own)
    if bits.get(1):
        raise ValueError("gain control")
    c.lines = np.zeros(starts[-1], dtype=np.int64)
    for k in np.flatnonzero((c.books >= 1) & (c.books <= ESCAPE)).tolist():
        c.lines[starts[k] : starts[k + 1]] = _read_lines(bits, int(c.books[k]), int(starts[k + 1] - starts[k]))
    return c


def _read_lines(bits: Bits, book: int, n: int) -> list[int]:
    size, _, signed = BOOKS[book]
    if n % size:
        raise ValueError("a band that its book can't fill")
    values, code = spectral_book(book)
    out: list[int] = []
    for _ in range(n // size):
        v = values[bits.symbol(code)]
        if book == ESCAPE and 16 in v:
            v = tuple(_read_escape(bits) if x == 16 else x for x in v)
        out += v if signed else [-x if x and bits.get(1) else x for x in v]
    return out


def _read_escape(bits: Bits) -> int:
    n = 4
    while bits.get(1):
        n += 1
        if n > 20:
            raise ValueError("escape")
    return (1 << n) + bits.get(n)


def _spectra(channels: list[Channel], mask: np.ndarray | None, rate_index: int, seed: int) -> tuple[list[np.ndarray], int]:
    """Spectra (1024 values, by window) of a single channel or a pair; mask: bands coded as mid and side; seed: of the noise."""
    out = []
    for c in channels:
        order, starts = coded_order(c.shape == SHORT, tuple(c.groups), rate_index)
        x = np.zeros(FRAME)
        coded = (c.books >= 1) & (c.books <= ESCAPE)
        x[order] = t.requantise(c.lines, np.repeat(np.where(coded, c.scales - 100, 0), np.diff(starts)))
        out.append(x)
    if len(channels) == 2:
        order, starts = coded_order(channels[0].shape == SHORT, tuple(channels[0].groups), rate_index)
        if mask is not None and mask.any():
            at = order[np.repeat(mask, np.diff(starts))]
            out[0][at], out[1][at] = t.mid_side(out[0][at], out[1][at])
        right = channels[1]
        order, starts = coded_order(right.shape == SHORT, tuple(right.groups), rate_index)
        for k in np.flatnonzero(right.books >= INVERTED).tolist():
            at = order[starts[k] : starts[k + 1]]
            # The reference's streams have the plain kind at 15 and the inverted one at 14.
            out[1][at] = t.intensity(out[0][at], right.scales[k], right.books[k] == INVERTED)
    for c, x in zip(channels, out):
        short = c.shape == SHORT
        bands = (SHORT_BANDS if short else LONG_BANDS)[rate_index]
        window = 0
        for g, n in enumerate(c.groups):
            for w in range(window, window + n):
                for b in np.flatnonzero(c.books[g * (len(bands) - 1) : (g + 1) * (len(bands) - 1)] == NOISE).tolist():
                    a, z = w * SUB + bands[b], w * SUB + bands[b + 1]
                    x[a:z], seed = t.noise(seed, z - a, 2.0 ** ((int(c.scales[g * (len(bands) - 1) + b]) - 100) / 2))
            window += n
        for w, filters in enumerate(c.filters or ()):
            for length, down, resolution, index in filters:
                signed = [i - (1 << resolution) if i >> resolution - 1 else i for i in index]
                a, z = w * SUB, w * SUB + bands[min(length, len(bands) - 1)]
                x[a:z] = t.all_pole(x[a:z], t.reflection_to_direct(np.sin(np.array(signed) * np.pi / (1 << resolution))), down)
    return out, seed


def parse_frame(frame: bytes, rate_index: int, seed: int = NOISE_SEED) -> tuple[list[tuple[Channel, np.ndarray]], int]:
    """Channels of a raw frame with their spectra, and the next seed of the noise. Data, program and fill elements are passed over."""
    bits, out = Bits(frame), []
    while bits.at + 3 <= bits.size:
        kind = bits.get(3)
        if kind in (SINGLE, LFE):
            bits.get(4)
            c = _read_channel(bits, rate_index, None)
            x, seed = _spectra([c], None, rate_index, seed)
            out.append((c, x[0]))
        elif kind == PAIR:
            bits.get(4)
            common = _read_info(bits) if bits.get(1) else None
            mask = None
            if common:
                bands = len((SHORT_BANDS if common.shape == SHORT else LONG_BANDS)[rate_index]) - 1
                mask = np.zeros(len(common.groups) * bands, dtype=bool)
                how = bits.get(2)
                if how:
                    for g in range(len(common.groups)):
                        for b in range(common.max_sfb):
                            mask[g * bands + b] = how == 2 or bits.get(1)
            pair = [_read_channel(bits, rate_index, common) for _ in range(2)]
            x, seed = _spectra(pair, mask, rate_index, seed)
            out += zip(pair, x)
        elif kind == DATA:
            bits.get(4)
            align, n = bits.get(1), bits.get(8)
            n += bits.get(8) if n == 255 else 0
            bits.at = (-(-bits.at // 8) * 8 if align else bits.at) + 8 * n
        elif kind == FILL:
            n = bits.get(4)
            bits.at += 8 * (n + bits.get(8) - 1 if n == 15 else n)
        elif kind == PROGRAM:
            bits.get(10)
            front, side, back, lfe, data, coupling = (bits.get(w) for w in (4, 4, 4, 2, 3, 4))
            for width in (4, 4, 3):
                if bits.get(1):
                    bits.get(width)
            bits.at += 5 * (front + side + back + coupling) + 4 * (lfe + data)
            bits.at = -(-bits.at // 8) * 8
            bits.at += 8 * bits.get(8)
        else:
            break
    return out, seed


@lru_cache(maxsize=None)
def _slope(size: int, window: int) -> np.ndarray:
    """The rising half of a window of 2 * size."""
    full = t.kbd_window(2 * size, 4.0 if size == FRAME else 6.0) if window == KBD else t.sine_window(2 * size)
    return full[:size]


@lru_cache(maxsize=None)
def frame_window(shape: int, before: int, now: int) -> np.ndarray:
    """Window of a frame that isn't short: its rise follows the window of the frame before."""
    flat = (FRAME - SUB) // 2
    short = lambda w: np.concatenate([np.zeros(flat), _slope(SUB, w), np.ones(flat)])
    rise = short(before) if shape == STOP else _slope(FRAME, before)
    fall = short(now) if shape == START else _slope(FRAME, now)
    return np.concatenate([rise, fall[::-1]])


def _short_windows(before: int, now: int) -> np.ndarray:
    """Eight windows of 256."""
    first, other = _slope(SUB, before), _slope(SUB, now)
    return np.stack([np.concatenate([first if k == 0 else other, other[::-1]]) for k in range(8)])


def synthesise(spectra: np.ndarray, shapes: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Samples of a channel's frames (1024 each, a frame of delay in them), its spectra frames x 1024."""
    blocks = np.zeros((len(spectra), 2 * FRAME))
    before = np.append(SINE, windows[:-1]) if len(windows) else windows
    for shape, b, now in set(zip(shapes.tolist(), before.tolist(), windows.tolist())):
        at = np.flatnonzero((shapes == shape) & (before == b) & (windows == now))
        if shape == SHORT:
            parts = t.imdct(spectra[at].reshape(-1, 8, SUB)) * _short_windows(b, now) * (2 / SUB)
            for k in range(8):
                start = (FRAME - SUB) // 2 + k * SUB
                blocks[at, start : start + 2 * SUB] += parts[:, k]
        else:
            blocks[at] = t.imdct(spectra[at]) * frame_window(shape, b, now) * (2 / FRAME)
    return t.overlap_add(blocks)[: len(spectra) * FRAME]


def analyse(x: np.ndarray, shapes: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Spectra of a channel; frame k sees the samples from (k - 1) * 1024 on, zeros outside."""
    n = len(shapes)
    padded = np.zeros((n + 1) * FRAME)
    padded[FRAME : FRAME + len(x)] = x[: n * FRAME]
    blocks = np.lib.stride_tricks.sliding_window_view(padded, 2 * FRAME)[::FRAME]
    out = np.zeros((n, FRAME))
    before = np.append(SINE, windows[:-1])
    for shape, b, now in set(zip(shapes.tolist(), before.tolist(), windows.tolist())):
        at = np.flatnonzero((shapes == shape) & (before == b) & (windows == now))
        if shape == SHORT:
            start = (FRAME - SUB) // 2
            parts = np.stack([blocks[at, start + k * SUB : start + (k + 2) * SUB] for k in range(8)], axis=1)
            out[at] = t.mdct(parts * _short_windows(b, now)).reshape(-1, FRAME)
        else:
            out[at] = t.mdct(blocks[at] * frame_window(shape, b, now))
    return out


def decode(frames: list[bytes], rate: int) -> tuple[np.ndarray, int]:
    """Samples (frames x channels, full scale 1; the first 1024 are the coder's delay) and how many frames were unsound: those are silent."""
    index, seed, parsed, bad = ADTS_RATES.index(rate), NOISE_SEED, [], 0
    for f in frames:
        try:
            channels, seed = parse_frame(f, index, seed)
        except (EOFError, ValueError, IndexError):
            channels, bad = [], bad + 1
        parsed.append(channels)
    out = []
    for k in range(max(map(len, parsed), default=0)):
        have = [p[k] if k < len(p) else (Channel(LONG), np.zeros(FRAME)) for p in parsed]
        out.append(synthesise(np.stack([x for _, x in have]), np.array([c.shape for c, _ in have]), np.array([c.window for c, _ in have])))
    return (np.stack(out, axis=1) if out else np.zeros((0, 1))), bad


# ---- encoder


def window_shapes(x: np.ndarray, ratio: float = 8.0) -> np.ndarray:
    """Shapes of the frames of a channel (one more than it has hops): short ones where a sub-block is far louder than what comes before it."""
    hops = -(-len(x) // FRAME) + 1
    padded = np.zeros(hops * FRAME)
    padded[: len(x)] = x
    d = np.append(padded[:1], padded[1:] - 0.95 * padded[:-1])
    energy = (d.reshape(-1, 256) ** 2).sum(axis=1)
    past = np.array([energy[max(0, k - 4) : k].mean() if k else np.inf for k in range(len(energy))])
    loud = (energy > ratio * np.maximum(past, 1e-4)) & (energy > 1e-3)
    attack = loud.reshape(-1, 4).any(axis=1)  # of the hop that frame k + 1 ends with
    shapes = np.zeros(hops, dtype=np.int64)
    for k in range(1, hops):
        last, coming = shapes[k - 1], bool(attack[k]) if k < hops else False
        shapes[k] = SHORT if last == START or last == SHORT and coming else STOP if last == SHORT else START if coming else LONG
    return shapes


def groups_of(spectrum: np.ndarray) -> list[int]:
    """Short windows in groups of like energy."""
    energy = (spectrum.reshape(8, SUB) ** 2).sum(axis=1) + 1e-9
    out = [1]
    for a, b in zip(energy, energy[1:]):
        if 0.25 < b / a < 4:
            out[-1] += 1
        else:
            out.append(1)
    return out


#: Share of the loudest line's energy that is masked anywhere.
MASKED = 1e-5
#: Noise energy of a line that rounding to 16 bits makes: there is no use in less.
ROUNDING = FRAME / 12 / 32768**2


def allowed_noise(energy: np.ndarray, flatness: np.ndarray, per_group: int) -> np.ndarray:
    """Noise energy that bands may have: what their energy, spread over higher bands by 10 dB each and over lower ones by 25, masks; less for tonal bands."""
    e = 10 * np.log10(energy.reshape(-1, per_group))
    k = np.arange(per_group)
    spread = np.maximum(np.maximum.accumulate(e + 10 * k, axis=1) - 10 * k, np.maximum.accumulate((e - 25 * k)[:, ::-1], axis=1)[:, ::-1] + 25 * k)
    tonality = np.clip(10 * np.log10(np.maximum(flatness, 1e-12)) / -60, 0, 1).reshape(e.shape)
    return 10 ** ((spread - 6 - 12 * tonality) / 10).ravel()


def first_scales(x: np.ndarray, starts: np.ndarray, per_group: int) -> np.ndarray:
    """Scale factors whose quantisation noise is about what is allowed, of lines in coded order."""
    width = np.diff(starts)
    square = x * x + 1e-20
    energy = np.add.reduceat(square, starts[:-1])
    flatness = np.exp(np.add.reduceat(np.log(square), starts[:-1]) / width) / (energy / width)
    step = np.sqrt(12 * np.maximum(allowed_noise(energy, flatness, per_group) / width, max(ROUNDING, MASKED * float(square.max()))))
    size = np.sqrt(energy / width)
    # The quantiser's step grows with the fourth root of the value.
    return 100 + np.round(4 * np.log2(np.maximum((0.75 * step / size**0.25) ** (4 / 3), 1e-6)))


def costs(q: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bits of each band (columns) in each book 0 to 11 (rows); infinite where a book can't hold a band."""
    out = np.full((12, len(starts) - 1), np.inf)
    magnitude = np.abs(q)
    top = np.maximum.reduceat(magnitude, starts[:-1])
    out[0, top == 0] = 0
    for book, (size, most, signed) in BOOKS.items():
        if (starts % size).any():
            continue
        v = np.minimum(q if signed else magnitude, most)
        v = np.maximum(v, -most).reshape(-1, size) + (most if signed else 0)
        index = v @ (2 * most + 1 if signed else most + 1) ** np.arange(size - 1, -1, -1)
        bits = spectral_book(book)[1].lengths[index].astype(float)
        if not signed:
            bits += (magnitude.reshape(-1, size) > 0).sum(axis=1)
        if book == ESCAPE:
            big = magnitude >= 16
            bits += np.where(big, 2 * np.floor(np.log2(np.maximum(magnitude, 16))) - 3, 0).reshape(-1, 2).sum(axis=1)
        held = top <= (MOST if book == ESCAPE else most)
        out[book, held] = np.add.reduceat(bits, starts[:-1] // size)[held]
    return out


def sections(cost: np.ndarray, head: int) -> np.ndarray:
    """The cheapest book of each band of a group, a section's head counted wherever the book changes."""
    total, came = cost[:, 0] + head, []
    for k in range(1, cost.shape[1]):
        best = int(total.argmin())
        change = total[best] + head < total
        came.append(np.where(change, best, np.arange(len(total))))
        total = np.where(change, total[best] + head, total) + cost[:, k]
    book = [int(total.argmin())]
    for c in reversed(came):
        book.append(int(c[book[-1]]))
    return np.array(book[::-1])


def quantised(x: np.ndarray, starts: np.ndarray, scales: np.ndarray) -> np.ndarray:
    return t.quantise(x, np.repeat(scales - 100, np.diff(starts)))


def coded_channel(spectrum: np.ndarray, shape: int, window: int, groups: list[int], rate_index: int, budget: float, rounds: int = 16) -> Channel:
    """A channel whose spectrum takes at most budget bits: all scale factors rise until it fits, or sink while it does."""
    short = shape == SHORT
    order, starts = coded_order(short, tuple(groups), rate_index)
    x = spectrum[order]
    bands = (len(starts) - 1) // len(groups)
    head = 7 if short else 9
    first = first_scales(x, starts, bands)
    top = np.maximum.reduceat(np.abs(x), starts[:-1])
    floor = 100 + np.ceil(4 * np.log2(np.maximum(top, 1e-9) / MOST ** (4 / 3)))
    code = scale_book()

    # However many bits there are, no step is finer than rounding to 16 bits asks for.
    floor = np.maximum(floor, 100 + np.floor(4 * np.log2(np.sqrt(12 * ROUNDING) / 4)))

    def at(shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        scales = np.clip(np.maximum(first + shift, floor), 1, 255).astype(np.int64)
        q = quantised(x, starts, scales)
        cost = costs(q, starts)
        used = np.flatnonzero(cost[0] > 0)
        if len(used):
            # Neighbours differ by 60 at most: lower ones follow, as that only adds precision.
            s = scales[used]
            for _ in range(2):
                s = s[::-1]
                for k in range(1, len(s)):
                    s[k] = min(s[k], s[k - 1] + 60)
            if (s != scales[used]).any():
                scales[used] = np.maximum(s, floor[used])
                q = quantised(x, starts, scales)
                cost = costs(q, starts)
                used = np.flatnonzero(cost[0] > 0)
        steps = np.diff(scales[used], prepend=scales[used][:1])
        bits = cost.min(axis=0).sum() + code.lengths[np.clip(steps + 60, 0, 120)].sum() + head * (1 + np.count_nonzero(np.diff(cost.argmin(axis=0))))
        return scales, q, cost, bits

    low, high = -80, 120
    best = None
    for _ in range(rounds):
        if low >= high:
            break
        middle = (low + high) // 2
        found = at(middle)
        if found[3] <= budget:
            best, high = found, middle
        else:
            low = middle + 1
    scales, q, cost, _ = best or at(high)
    c = Channel(shape, window, 0, groups, 100)
    c.lines, c.scales = q, scales
    c.books = np.concatenate([sections(cost[:, g * bands : (g + 1) * bands], head) for g in range(len(groups))])
    used = np.flatnonzero(np.maximum.reduceat(np.abs(q), starts[:-1]).reshape(-1, bands).any(axis=0))
    c.max_sfb = int(used[-1]) + 1 if len(used) else 0
    c.books = np.where(np.tile(np.arange(bands), len(groups)) < c.max_sfb, c.books, ZERO)
    coded = scales[c.books > 0]
    c.gain = int(coded[0]) if len(coded) else 100
    return c


def _put_info(out: Packer, c: Channel) -> None:
    out.put(0, 1)
    out.put(c.shape, 2)
    out.put(c.window, 1)
    if c.shape == SHORT:
        out.put(c.max_sfb, 4)
        for k, n in enumerate(c.groups):
            for j in range(n):
                if k or j:
                    out.put(int(j > 0), 1)
    else:
        out.put(c.max_sfb, 6)
        out.put(0, 1)


def _put_channel(out: Packer, c: Channel, rate_index: int, common: bool) -> None:
    short = c.shape == SHORT
    _, starts = coded_order(short, tuple(c.groups), rate_index)
    bands = (len(starts) - 1) // len(c.groups)
    out.put(c.gain, 8)
    if not common:
        _put_info(out, c)
    width = 3 if short else 5
    for g in range(len(c.groups)):
        books = c.books[g * bands : g * bands + c.max_sfb]
        cuts = [0, *(np.flatnonzero(np.diff(books)) + 1).tolist(), len(books)] if len(books) else []
        for a, b in zip(cuts, cuts[1:]):
            out.put(int(books[a]), 4)
            n = b - a
            while n >= (1 << width) - 1:
                out.put((1 << width) - 1, width)
                n -= (1 << width) - 1
            out.put(n, width)
    scale, position, noise, first, code = c.gain, 0, c.gain - 90, True, scale_book()
    for k in np.flatnonzero(c.books).tolist():
        book, value = c.books[k], int(c.scales[k])
        if book == NOISE and first:
            out.put(value - noise + 256, 9)
            noise, first = value, False
            continue
        last = noise if book == NOISE else position if book >= INVERTED else scale
        step = value - last + 60
        out.put(int(code.codes[step]), int(code.lengths[step]))
        if book == NOISE:
            noise = value
        elif book >= INVERTED:
            position = value
        else:
            scale = value
    out.put(0, 1)
    out.put(int(bool(c.filters)), 1)
    for own in c.filters or ():
        out.put(len(own), 1 if short else 2)
        if own:
            out.put(own[0][2] - 3, 1)
        for length, down, resolution, index in own:
            out.put(length, 4 if short else 6)
            out.put(len(index), 3 if short else 5)
            out.put(int(down), 1)
            out.put(0, 1)
            for i in index:
                out.put(i & (1 << resolution) - 1, resolution)
    out.put(0, 1)
    for k in np.flatnonzero((c.books >= 1) & (c.books <= ESCAPE)).tolist():
        _put_lines(out, int(c.books[k]), c.lines[starts[k] : starts[k + 1]])


def _put_lines(out: Packer, book: int, q: np.ndarray) -> None:
    """Codewords, then signs, then (book 11) escapes come symbol by symbol: fields of all symbols as columns, in that order."""
    size, most, signed = BOOKS[book]
    code, rows = spectral_book(book)[1], q.reshape(-1, size)
    magnitude = np.abs(rows)
    v = rows + most if signed else np.minimum(magnitude, most)
    index = v @ (2 * most + 1 if signed else most + 1) ** np.arange(size - 1, -1, -1)
    values, widths = [code.codes[index][:, None]], [code.lengths[index][:, None]]
    if book == ESCAPE:
        big = magnitude >= 16
        n = np.floor(np.log2(np.maximum(magnitude, 16))).astype(np.int64)
        prefix = np.stack([(1 << n - 4) - 1 << 1, magnitude - (1 << n)], axis=2).reshape(len(rows), -1)
        values.append(np.where(np.repeat(big, 2, axis=1), prefix, 0))
        widths.append(np.where(np.repeat(big, 2, axis=1), np.stack([n - 3, n], axis=2).reshape(len(rows), -1), 0))
    if not signed:
        values.append((rows < 0).astype(np.int64))
        widths.append((rows != 0).astype(np.int64))
    out.put_all(np.concatenate([x.astype(np.uint64) for x in values], axis=1).ravel(), np.concatenate(widths, axis=1).ravel())


def pack_frame(channels: list[Channel], rate_index: int, mask: np.ndarray | None = None) -> bytes:
    """A raw frame of one channel, or of a pair that shares its windows; mask: bands that hold mid and side."""
    out = Packer()
    out.put(PAIR if len(channels) == 2 else SINGLE, 3)
    out.put(0, 4)
    if len(channels) == 2:
        out.put(1, 1)
        most = max(c.max_sfb for c in channels)
        for c in channels:
            c.max_sfb = most
        _put_info(out, channels[0])
        bands = (len(channels[0].books)) // len(channels[0].groups)
        if mask is not None and mask.any():
            out.put(1, 2)
            for g in range(len(channels[0].groups)):
                for b in range(most):
                    out.put(int(mask[g * bands + b]), 1)
        else:
            out.put(0, 2)
    for c in channels:
        _put_channel(out, c, rate_index, len(channels) == 2)
    out.put(END, 3)
    return out.bytes()


def encode(x: np.ndarray, rate: int, kbps: int = 128, window: int = SINE) -> list[bytes]:
    """Raw frames of samples (frames x 1 or 2 channels, full scale 1); a frame more than they fill, as decoding lags by one."""
    index, channels = ADTS_RATES.index(rate), x.shape[1]
    if channels > 2:
        raise ValueError("one or two channels")
    shapes = window_shapes(x.sum(axis=1))
    windows = np.full(len(shapes), window)
    spectra = [analyse(x[:, c], shapes, windows) for c in range(channels)]
    budget = (kbps * 1000 * FRAME / rate - 60) / channels
    out = []
    for k, shape in enumerate(shapes.tolist()):
        own = [s[k] for s in spectra]
        groups = groups_of(sum(y * y for y in own) ** 0.5) if shape == SHORT else [1]
        mask = None
        if channels == 2:
            order, starts = coded_order(shape == SHORT, tuple(groups), index)
            both = [(own[0] + own[1]) / 2, (own[0] - own[1]) / 2]
            size = lambda y: np.log2(np.add.reduceat(y[order] ** 2, starts[:-1]) + 1e-9)  # noqa: E731, B023
            mask = size(both[0]) + size(both[1]) < size(own[0]) + size(own[1]) - 1
            at = order[np.repeat(mask, np.diff(starts))]
            own = [y.copy() for y in own]
            own[0][at], own[1][at] = both[0][at], both[1][at]
        out.append(pack_frame([coded_channel(y, shape, window, groups, index, budget) for y in own], index, mask))
    return out
