"""Transform kernels of the lossy codecs: MDCT with its windows, stereo and noise tools, linear prediction over spectra, floor curves.

All work on numpy arrays with frames as rows, so that a batch of frames is one matrix product or one FFT.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache
def _basis(n: int) -> np.ndarray:
    """n coefficients x 2n samples of the MDCT."""
    k, t = np.arange(n)[:, None], np.arange(2 * n)[None, :]
    return np.cos(np.pi / n * (t + 0.5 + n / 2) * (k + 0.5))


def mdct(blocks: np.ndarray) -> np.ndarray:
    """Coefficients (rows x n) of windowed blocks (rows x 2n). Long blocks go by an FFT of the same length."""
    n = blocks.shape[-1] // 2
    if n <= 64:
        return blocks @ _basis(n).T
    t = np.arange(2 * n)
    spectrum = np.fft.fft(blocks * np.exp(-1j * np.pi * t / (2 * n)), axis=-1)[..., :n]
    k = np.arange(n)
    return (spectrum * np.exp(-1j * np.pi * (k + 0.5) * (1 + n) / (2 * n))).real


def imdct(coefficients: np.ndarray) -> np.ndarray:
    """Aliased blocks (rows x 2n) of coefficients (rows x n); windowed and overlapped by half they give the signal back, times n / 2."""
    n = coefficients.shape[-1]
    if n <= 64:
        return coefficients @ _basis(n)
    k, t = np.arange(n), np.arange(2 * n)
    padded = np.zeros((*coefficients.shape[:-1], 2 * n), dtype=complex)
    padded[..., :n] = coefficients * np.exp(1j * np.pi * k * (1 + n) / (2 * n))
    return (np.fft.ifft(padded, axis=-1) * 2 * n * np.exp(1j * np.pi * (t + 0.5 + n / 2) / (2 * n))).real


@lru_cache
def sine_window(size: int) -> np.ndarray:
    return np.sin(np.pi / size * (np.arange(size) + 0.5))


@lru_cache
def kbd_window(size: int, alpha: float) -> np.ndarray:
    """Kaiser-Bessel-derived window."""
    half = size // 2
    kaiser = np.i0(np.pi * alpha * np.sqrt(1 - (2 * np.arange(half + 1) / half - 1) ** 2))
    rising = np.sqrt(np.cumsum(kaiser)[:half] / kaiser.sum())
    return np.concatenate([rising, rising[::-1]])


@lru_cache
def slope_window(size: int) -> np.ndarray:
    """The rising half of a power-complementary window."""
    return np.sin(np.pi / 2 * np.sin(np.pi / 2 * (np.arange(size) + 0.5) / size) ** 2)


def overlap_add(blocks: np.ndarray) -> np.ndarray:
    """Blocks (rows x 2n) at steps of n."""
    n = blocks.shape[-1] // 2
    out = np.zeros((len(blocks) + 1, n))
    out[:-1] += blocks[:, :n]
    out[1:] += blocks[:, n:]
    return out.ravel()


def analyse(x: np.ndarray, n: int, window: np.ndarray) -> np.ndarray:
    """MDCT frames of a signal, preceded and followed by n zeros."""
    hops = -(-len(x) // n)
    padded = np.concatenate([np.zeros(n), x, np.zeros(hops * n - len(x) + n)])
    return mdct(np.lib.stride_tricks.sliding_window_view(padded, 2 * n)[::n] * window)


def synthesise(frames: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The signal of frames from analyse, its padding at the front cut off."""
    n = frames.shape[-1]
    return overlap_add(imdct(frames) * window * 2 / n)[n:-n]


def mid_side(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right from mid and side."""
    return a + b, a - b


def intensity(left: np.ndarray, position: np.ndarray, invert: np.ndarray) -> np.ndarray:
    """The right channel of bands coded by position: the left one, scaled by half powers of one half."""
    return left * np.where(invert, -1.0, 1.0) * 0.5 ** (position / 4.0)


def noise(seed: int, size: int, energy: float) -> tuple[np.ndarray, int]:
    """A band of noise with the given energy, and the next seed, from the 32-bit linear congruential generator."""
    out, state = np.empty(size), seed
    for k in range(size):
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        out[k] = state - (1 << 32) if state >> 31 else state
    power = float(out @ out)
    return out * np.sqrt(energy / power) if power > 0 else out, state


def requantise(q: np.ndarray, scale: np.ndarray | float) -> np.ndarray:
    """sign(q) |q|^(4/3) times 2 to a quarter of scale."""
    return np.sign(q) * np.abs(q) ** (4 / 3) * 2.0 ** (np.asarray(scale) / 4.0)


def quantise(x: np.ndarray, scale: np.ndarray | float, offset: float = 0.4054) -> np.ndarray:
    """The inverse: magnitudes to the power 3/4, rounded down after an offset."""
    return (np.sign(x) * np.floor(np.abs(x * 2.0 ** (-np.asarray(scale) / 4.0)) ** 0.75 + offset)).astype(np.int64)


def reflection_to_direct(k: np.ndarray) -> np.ndarray:
    """Prediction coefficients from reflection coefficients (step-up)."""
    a = np.zeros(0)
    for r in k:
        a = np.append(a + r * a[::-1], r)
    return a


def tns_coefficients(index: np.ndarray, resolution: int) -> np.ndarray:
    """Reflection coefficients of transmitted indices with resolution bits."""
    top, low = (1 << resolution - 1) - 0.5, (1 << resolution - 1) + 0.5
    return np.sin(index * (np.pi / 2) / np.where(index >= 0, top, low))


def all_pole(x: np.ndarray, a: np.ndarray, down: bool = False) -> np.ndarray:
    """x filtered by 1 / (1 + sum a z^-k) over the spectrum, from the top down if asked for."""
    y = (x[::-1] if down else x).astype(np.float64).copy()
    for k in range(len(y)):
        m = min(k, len(a))
        y[k] -= float(a[:m] @ y[k - m : k][::-1])
    return y[::-1] if down else y


def alias_butterflies(x: np.ndarray, inverse: bool = True) -> np.ndarray:
    """Butterflies between neighbouring subbands (rows x subbands x lines) over eight lines on each side."""
    c = np.array([-0.6, -0.535, -0.33, -0.185, -0.095, -0.041, -0.0142, -0.0037])
    cs, ca = 1 / np.sqrt(1 + c * c), c / np.sqrt(1 + c * c)
    ca = ca if inverse else -ca
    out = x.astype(np.float64).copy()
    upper, lower = x[..., :-1, -1:-9:-1], x[..., 1:, :8]
    out[..., :-1, -1:-9:-1] = upper * cs - lower * ca
    out[..., 1:, :8] = lower * cs + upper * ca
    return out


def render_point(x0: int, y0: int, x1: int, y1: int, x: int) -> int:
    """Integer interpolation of a floor curve."""
    off = abs(y1 - y0) * (x - x0) // (x1 - x0)
    return y0 - off if y1 < y0 else y0 + off


def render_floor(xs: list[int], ys: list[int], size: int) -> np.ndarray:
    """A floor curve of size values through points sorted by x, as line segments drawn with integer steps; the last value goes on."""
    out = np.empty(size, dtype=np.int64)
    for (x0, y0), (x1, y1) in zip(zip(xs, ys), zip(xs[1:], ys[1:])):
        if x0 >= size or x1 <= x0:
            continue
        t = np.arange(min(x1, size) - x0)
        out[x0 : x0 + len(t)] = y0 + np.sign(y1 - y0) * (np.abs(y1 - y0) * t // (x1 - x0))
    if xs[-1] < size:
        out[xs[-1] :] = ys[-1]
    return out


def floor_gain(values: np.ndarray) -> np.ndarray:
    """Linear gain of floor values 0 to 255, over 140 dB in equal steps up to 1."""
    return 10.0 ** ((np.asarray(values) - 255) * (139.4532 / 255) / 20)


def decouple(magnitude: np.ndarray, angle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two channels from square polar coupling."""
    both = np.where(magnitude > 0, magnitude - angle, magnitude + angle), np.where(magnitude > 0, magnitude + angle, magnitude - angle)
    return np.where(angle > 0, magnitude, both[1]), np.where(angle > 0, both[0], magnitude)


def couple(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inverse: the greater magnitude, and how the other differs from it."""
    big = np.abs(left) > np.abs(right)
    magnitude = np.where(big, left, right)
    angle = np.where(big, np.where(left > 0, left - right, right - left), np.where(right > 0, left - right, right - left))
    return magnitude, angle


def canonical_codes(lengths: list[int]) -> list[int | None]:
    """Codewords of entries by length, each the lowest that is free; entries of length 0 have none. Over-full trees are refused."""
    free: dict[int, list[int]] = {0: [0]}
    out: list[int | None] = []
    for n in lengths:
        if not n:
            out.append(None)
            continue
        at = max((k for k in free if k <= n and free[k]), default=-1)
        # Of the free nodes that can hold the word, the leftmost one.
        best = min(((node << n - k, k, node) for k in free if k <= n for node in free[k]), default=None)
        if at < 0 or best is None:
            raise ValueError("over-full codebook")
        _, k, node = best
        free[k].remove(node)
        while k < n:
            k, node = k + 1, node << 1
            free.setdefault(k, []).append(node | 1)
        out.append(node)
    return out


def unpack_float(word: int) -> float:
    """A codebook's packed float: sign, ten bits of exponent, 21 of mantissa."""
    mantissa = word & 0x1FFFFF
    return float(np.ldexp(-mantissa if word >> 31 else mantissa, (word >> 21 & 0x3FF) - 788))


def pack_float(value: float) -> int:
    if value == 0:
        return 0
    mantissa, exponent = np.frexp(abs(value))
    return (0x80000000 if value < 0 else 0) | (int(exponent) - 21 + 788) << 21 | int(mantissa * (1 << 21))


def ilog(v: int) -> int:
    return max(v, 0).bit_length()


def signal_to_noise(x: np.ndarray, y: np.ndarray) -> float:
    """Decibels."""
    error = float(((x - y) ** 2).sum())
    return float("inf") if error == 0 else 10 * np.log10(float((x**2).sum()) / error)
