"""FLAC: stream header, frames (each decodes by itself) and an encoder that works block by block."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np

from ..functions.bits import Packer, Reader
from ..functions.checksums import crc

#: Codes of sample rates and of bits per sample in frame headers.
RATES = [0, 88200, 176400, 192000, 8000, 16000, 22050, 24000, 32000, 44100, 48000, 96000]
DEPTHS = [0, 8, 12, None, 16, 20, 24, 32]
PRECISION = 14


class BadFrame(ValueError):
    pass


@dataclass
class StreamInfo:
    least_block: int
    most_block: int
    least_frame: int
    most_frame: int
    rate: int
    channels: int
    bits: int
    total: int
    md5: bytes

    def pack(self) -> bytes:
        p = Packer()
        for v, w in ((self.least_block, 16), (self.most_block, 16), (self.least_frame, 24), (self.most_frame, 24), (self.rate, 20), (self.channels - 1, 3), (self.bits - 1, 5), (self.total, 36)):
            p.put(v, w)
        return p.bytes() + self.md5


def parse_header(data: bytes) -> tuple[StreamInfo, int]:
    """STREAMINFO and where the first frame is; other metadata blocks are skipped."""
    if data[:4] != b"fLaC":
        raise BadFrame("no FLAC stream")
    at, info, last = 4, None, False
    while not last:
        if at + 4 > len(data):
            raise BadFrame("metadata ends early")
        last, kind, size = bool(data[at] & 128), data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            r = Reader(data[at + 4 : at + 22])
            values = [r.get(w) for w in (16, 16, 24, 24, 20, 3, 5, 36)]
            info = StreamInfo(*values[:5], values[5] + 1, values[6] + 1, values[7], data[at + 22 : at + 38])
        at += 4 + size
    if info is None:
        raise BadFrame("no STREAMINFO")
    return info, at


@dataclass
class FrameHeader:
    block: int
    rate: int
    channels: int
    mode: int  # 0 independent, 1 left/side, 2 right/side, 3 mid/side
    bits: int
    number: int
    size: int


def _coded_number(data: bytes, at: int) -> tuple[int, int]:
    """A number of one to seven bytes in the manner of UTF-8."""
    first = data[at]
    ones = 8 - (first ^ 0xFF).bit_length()
    if ones == 0:
        return first, at + 1
    if ones == 1 or ones > 7:
        raise BadFrame("bad number")
    number = first & (0x7F >> ones)
    for b in data[at + 1 : at + ones]:
        number = number << 6 | b & 63
    return number, at + ones


def put_number(n: int) -> bytes:
    if n < 128:
        return bytes([n])
    k = 2
    while n >> (5 * k + 1):
        k += 1
    head = (0xFF00 >> k & 0xFF) | n >> 6 * (k - 1)
    return bytes([head, *(128 | n >> 6 * j & 63 for j in range(k - 2, -1, -1))])


def parse_frame_header(data: bytes, at: int, info: StreamInfo) -> FrameHeader:
    if len(data) < at + 6 or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise BadFrame("no sync")
    size_code, rate_code, channel_code, depth_code = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    if size_code == 0 or rate_code == 15 or channel_code > 10 or depth_code == 3 or data[at + 3] & 1:
        raise BadFrame("reserved code")
    number, k = _coded_number(data, at + 4)
    big = lambda n: int.from_bytes(data[k : k + n], "big")
    if size_code == 1:
        block = 192
    elif size_code <= 5:
        block = 576 << size_code - 2
    elif size_code >= 8:
        block = 256 << size_code - 8
    else:
        n = size_code - 5
        block, k = big(n) + 1, k + n
    rate = RATES[rate_code] if rate_code < 12 else 0
    if rate_code >= 12:
        n = 1 if rate_code == 12 else 2
        rate, k = big(n) * {12: 1000, 13: 1, 14: 10}[rate_code], k + n
    if k >= len(data) or crc(data[at:k], "flac8") != data[k]:
        raise BadFrame("header checksum")
    return FrameHeader(block, rate or info.rate or 44100, channel_code + 1 if channel_code < 8 else 2, max(0, channel_code - 7), DEPTHS[depth_code] or info.bits or 16, number, k + 1 - at)


def integrate(warm: list[int], residual: list[int]) -> np.ndarray:
    """Undoes a fixed predictor: the residual is the n-th difference, n the number of warm-up samples."""
    r = np.array(residual, dtype=np.int64)
    w = np.array(warm, dtype=np.int64)
    for j in range(len(warm) - 1, -1, -1):
        r = np.diff(w, n=j)[-1] + np.cumsum(r)
    return np.concatenate([w, r])


def _residual(r: Reader, block: int, order: int) -> list[int]:
    method = r.get(2)
    if method > 1:
        raise BadFrame("residual method")
    width = 4 + method
    parts = 1 << r.get(4)
    out: list[int] = []
    for p in range(parts):
        n = block // parts - (order if p == 0 else 0)
        k = r.get(width)
        if k == (1 << width) - 1:
            bits = r.get(5)
            out += [r.signed(bits) for _ in range(n)]
        else:
            out += r.rice(n, k)
    return out


def _subframe(r: Reader, block: int, bits: int) -> np.ndarray:
    if r.get(1):
        raise BadFrame("subframe padding")
    kind = r.get(6)
    wasted = r.unary() + 1 if r.get(1) else 0
    bits -= wasted
    if kind == 0:
        x = np.full(block, r.signed(bits), dtype=np.int64)
    elif kind == 1:
        x = np.array([r.signed(bits) for _ in range(block)], dtype=np.int64)
    elif 8 <= kind <= 12:
        warm = [r.signed(bits) for _ in range(kind - 8)]
        x = integrate(warm, _residual(r, block, kind - 8))
    elif kind >= 32:
        order = kind - 31
        past = [r.signed(bits) for _ in range(order)]
        precision, shift = r.get(4) + 1, r.signed(5)
        taps = [r.signed(precision) for _ in range(order)][::-1]
        for e in _residual(r, block, order):
            past.append(e + (sum(map(int.__mul__, taps, past[-order:])) >> shift))
        x = np.array(past, dtype=np.int64)
    else:
        raise BadFrame("subframe type")
    return x << wasted


def _subframes(body: bytes, h: FrameHeader) -> tuple[Reader, list[np.ndarray]]:
    # A frame is rarely larger than its samples; what follows is looked at only if it must be.
    usual = h.block * h.channels * (h.bits + 8) // 8 + 64
    for size in (usual, len(body)):
        r = Reader(body[:size])
        try:
            return r, [_subframe(r, h.block, h.bits + (h.mode in (1, 3) and c == 1 or h.mode == 2 and c == 0)) for c in range(h.channels)]
        except EOFError:
            if size >= len(body):
                raise
    raise EOFError


def decode_frame(data: bytes, info: StreamInfo, at: int = 0, limit: int | None = None) -> tuple[FrameHeader, np.ndarray, int]:
    """Header, samples (block x channels) and end of the first sound frame at or after `at`."""
    while True:
        at = data.find(b"\xff", at)
        if at < 0:
            raise BadFrame("no frame")
        try:
            h = parse_frame_header(data, at, info)
            body = data[at + h.size : limit]
            r, x = _subframes(body, h)
            r.align()
            end = at + h.size + r.at // 8
            if crc(data[at:end], "flac16") != int.from_bytes(data[end : end + 2], "big"):
                raise BadFrame("frame checksum")
            if h.mode == 1:
                x[1] = x[0] - x[1]
            elif h.mode == 2:
                x[0] = x[0] + x[1]
            elif h.mode == 3:
                mid = x[0] << 1 | x[1] & 1
                x = [mid + x[1] >> 1, mid - x[1] >> 1]
            return h, np.stack(x, axis=1), end + 2
        except (BadFrame, EOFError, IndexError):
            at += 1


def frame_spans(data: bytes) -> tuple[StreamInfo, list[tuple[FrameHeader, int, int]]]:
    """Header, start and end of each frame, found by headers and checksums alone (nothing is decoded)."""
    info, at = parse_header(data)
    starts: list[tuple[FrameHeader, int]] = []
    while (at := data.find(b"\xff", at)) >= 0:
        try:
            starts.append((parse_frame_header(data, at, info), at))
        except (BadFrame, IndexError):
            pass
        at += 1
    out = []
    k = 0
    while k < len(starts):
        h, begin = starts[k]
        # What looks like a header inside a frame doesn't end one: the checksum before it decides.
        for j, end in enumerate([*(a for _, a in starts[k + 1 :]), len(data)], k + 1):
            if end - begin > h.size + 2 and crc(data[begin : end - 2], "flac16") == int.from_bytes(data[end - 2 : end], "big"):
                out.append((h, begin, end))
                k = j
                break
            if end - begin > 2 * h.block * h.channels * 4 + 1024:
                k += 1
                break
        else:
            k += 1
    return info, out


def read(data: bytes) -> tuple[StreamInfo, np.ndarray]:
    info, at = parse_header(data)
    blocks = []
    while at < len(data):
        try:
            _, x, at = decode_frame(data, info, at)
        except BadFrame:
            break
        blocks.append(x)
    return info, np.concatenate(blocks) if blocks else np.zeros((0, info.channels), dtype=np.int64)


def rice_parameter(residual: np.ndarray) -> tuple[int, int]:
    """Parameter (0 to 14) and bits: the best of the estimate from the mean and its neighbours, the lowest on ties."""
    u = np.where(residual >= 0, 2 * residual, -2 * residual - 1)
    total = int(u.sum())
    if not total:
        return 0, len(u)
    guess = min(max(math.floor(math.log2(total / len(u) * math.log(2))), 0), 14)
    return min(((k, int((u >> k).sum()) + len(u) * (1 + k)) for k in range(max(0, guess - 1), min(14, guess + 1) + 1)), key=lambda e: e[1])


def fixed_order(x: np.ndarray) -> int:
    """Order 0 to 4 with the least sum of magnitudes over samples that all orders predict; the lowest on ties."""
    if len(x) <= 4:
        return 0
    sums = [int(np.abs(np.diff(x, n=o)[4 - o :]).sum()) for o in range(5)]
    return sums.index(min(sums))


def lpc(x: np.ndarray, most: int) -> tuple[list[int], int]:
    """Quantised coefficients and shift by Levinson-Durbin over the Hann-windowed block; none if nothing predicts it."""
    n = len(x)
    if n <= most:
        return [], 0
    w = x * (0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / n)))
    auto = [float(w[lag:] @ w[: n - lag]) for lag in range(most + 1)]
    if auto[0] <= 1e-12:
        return [], 0
    a, error, best, least = np.zeros(0), auto[0], np.zeros(0), auto[0]
    for i in range(1, most + 1):
        k = (auto[i] - float(a @ np.array(auto[i - 1 : 0 : -1]))) / error if i > 1 else auto[1] / error
        if abs(k) >= 1:
            break
        a = np.append(a - k * a[::-1], k)
        error *= 1 - k * k
        if error < least:
            least, best = error, a
    if not len(best):
        return [], 0
    top = (1 << PRECISION - 1) - 1
    peak = float(np.abs(best).max())
    shift = min(max(math.floor(math.log2(top / peak)), 0), 15) if peak > 0 else 0
    scaled = best * (1 << shift)
    return np.clip(np.trunc(scaled + np.copysign(0.5, scaled)), -top - 1, top).astype(int).tolist(), shift


def _put_subframe(p: Packer, x: np.ndarray, bits: int, level: int) -> None:
    if (x == x[0]).all():
        p.put(0, 8)
        p.signed(x[:1], bits)
        return
    any_bits = int(np.bitwise_or.reduce(x))
    wasted = (any_bits & -any_bits).bit_length() - 1 if any_bits and not any_bits & 1 else 0
    x, bits = x >> wasted, bits - wasted
    order = fixed_order(x)
    residual = np.diff(x, n=order)
    k, cost = rice_parameter(residual)
    taps, shift = lpc(x, min(32, 4 + 2 * (level - 3))) if level >= 3 and len(x) > 16 else ([], 0)
    if taps:
        sums = np.convolve(x, taps)[len(taps) - 1 : len(x) - 1]
        other = x[len(taps) :] - (sums >> shift)
        k2, cost2 = rice_parameter(other)
        if cost2 + len(taps) * PRECISION + 9 < cost and np.abs(other).max() < 1 << 31:
            order, residual, k = len(taps), other, k2
        else:
            taps = []
    p.put(31 + order if taps else 8 + order, 7)
    p.put(1 if wasted else 0, 1)
    if wasted:
        p.put(1, wasted)
    p.signed(x[:order], bits)
    if taps:
        p.put(PRECISION - 1, 4)
        p.put(shift, 5)
        p.signed(np.array(taps), PRECISION)
    p.put(0, 6)
    p.put(k, 4)
    p.rice(residual, k)


def stereo_mode(left: np.ndarray, right: np.ndarray) -> int:
    size = lambda x: int(np.abs(x).sum())
    a, b, s, m = size(left), size(right), size(left - right), size(left + right >> 1)
    costs = [a + b, a + s, s + b, m + s]
    return costs.index(min(costs))


def encode_frame(x: np.ndarray, number: int, bits: int = 16, level: int = 5) -> bytes:
    """One frame of block x channels integers."""
    block, channels = x.shape
    x = x.astype(np.int64)
    mode = stereo_mode(x[:, 0], x[:, 1]) if channels == 2 and level > 0 else 0
    left, right = x[:, 0], x[:, -1]
    parts = {1: [left, left - right], 2: [left - right, right], 3: [left + right >> 1, left - right]}.get(mode) or list(x.T)
    head = bytes([0xFF, 0xF8, 0x70, (7 + mode if mode else channels - 1) << 4 | DEPTHS.index(bits) << 1]) + put_number(number) + (block - 1).to_bytes(2, "big")
    p = Packer()
    for c, part in enumerate(parts):
        _put_subframe(p, part, bits + (mode in (1, 3) and c == 1 or mode == 2 and c == 0), level)
    frame = head + bytes([crc(head, "flac8")]) + p.bytes()
    return frame + crc(frame, "flac16").to_bytes(2, "big")


def stream(frames: list[bytes], samples_md5: bytes, total: int, rate: int, channels: int, bits: int, block: int) -> bytes:
    sizes = [len(f) for f in frames] or [0]
    info = StreamInfo(block, block, min(sizes), max(sizes), rate, channels, bits, total, samples_md5)
    return b"fLaC" + b"\x80\0\0\x22" + info.pack() + b"".join(frames)


def write(x: np.ndarray, rate: int, bits: int = 16, block: int = 4096, level: int = 5) -> bytes:
    x = np.asarray(x)
    x = x[:, None] if x.ndim == 1 else x
    frames = [encode_frame(x[at : at + block], k, bits, level) for k, at in enumerate(range(0, len(x), block))]
    size = -(-bits // 8)
    raw = np.stack([x.astype(np.int64).ravel() >> 8 * k & 255 for k in range(size)], axis=1).astype(np.uint8).tobytes()
    return stream(frames, hashlib.md5(raw).digest(), len(x), rate, x.shape[1], bits, block)
