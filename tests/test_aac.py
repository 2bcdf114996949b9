import numpy as np
import pytest

from cadenza.functions.bits import Packer
from cadenza.functions.pcm import ADTS_RATES
from cadenza.functions.prefix import Bits, PrefixCode, canonical, huffman_lengths
from cadenza.functions.transforms import signal_to_noise
from cadenza.sources import aac, adts, audio, mp4

RATE = 44100


def tone(*parts, n=RATE):
    k = np.arange(n) / RATE
    return sum(a * np.sin(2 * np.pi * f * k) for f, a in parts)


SIGNALS = {
    "sine": (tone((440, 0.5))[:, None], 35),
    "chord": (tone((440, 0.3), (1000, 0.2), (3000, 0.1))[:, None], 35),
    "stereo": (np.stack([tone((440, 0.5)), tone((1000, 0.4))], axis=1), 35),
    "same on both": (np.stack([tone((440, 0.5))] * 2, axis=1), 35),
    "sweep": (0.5 * np.sin(2 * np.pi * np.cumsum(np.geomspace(60, 8000, RATE)) / RATE)[:, None], 30),
}


@pytest.mark.parametrize("window", [aac.SINE, aac.KBD])
@pytest.mark.parametrize("name", SIGNALS)
def test_round_trip(name, window):
    x, least = SIGNALS[name]
    frames = aac.encode(x, RATE, 128, window)
    y, bad = aac.decode(frames, RATE)
    assert bad == 0 and signal_to_noise(x, y[1024 : 1024 + len(x)]) > least
    assert max(map(len, frames)) * 8 <= 128_000 * 1024 / RATE + 200


def test_attacks_switch_windows():
    x = np.where(np.arange(RATE) % 11025 < 40, 0.8, 0.0) * np.sin(np.arange(RATE))
    shapes = aac.window_shapes(x).tolist()
    assert {(a, b) for a, b in zip(shapes, shapes[1:])} <= {(0, 0), (0, 1), (1, 2), (2, 2), (2, 3), (3, 0), (3, 1)} and 2 in shapes
    y, bad = aac.decode(aac.encode(x[:, None], RATE), RATE)
    assert bad == 0 and signal_to_noise(x, y[1024 : 1024 + RATE, 0]) > 8
    # Any mixture of shapes and windows gives the signal back where nothing is quantised.
    rng = np.random.default_rng(1)
    z, windows = rng.normal(size=RATE), rng.integers(0, 2, len(shapes))
    back = aac.synthesise(aac.analyse(z, np.array(shapes), windows), np.array(shapes), windows)
    assert signal_to_noise(z[: RATE - 2048], back[1024 : RATE - 1024]) > 200


def test_codebooks_are_complete_and_follow_the_rule():
    for book, (size, most, signed) in aac.BOOKS.items():
        values, code = aac.spectral_book(book)
        assert len(values) == (2 * most + 1 if signed else most + 1) ** size
        assert sum(2.0 ** -int(n) for n in code.lengths) == 1
        order = sorted(range(len(values)), key=lambda k: (code.lengths[k], k))
        words = [int(code.codes[k]) << 32 - int(code.lengths[k]) for k in order]
        assert words == sorted(words)
        if book not in (9, 11):  # where no length is cut, heavier values never have longer words
            by = {}
            for v, n in zip(values, code.lengths.tolist()):
                by.setdefault(sum(map(abs, v)), []).append(n)
            assert all(max(by[k]) <= min(by[k + 1]) + 1 for k in range(len(by) - 1))
    assert huffman_lengths([8, 4, 2, 1, 1], 9) == [1, 2, 3, 4, 4] and max(huffman_lengths([2.0**-k for k in range(20)], 7)) == 7
    assert canonical([2, 1, 2]) == [2, 0, 3]


def test_bits():
    b = Bits(bytes([0b10110011, 0xFF, 0x01]))
    code = PrefixCode.of_words("0 10 110 111")
    assert [b.get(3), *(b.symbol(code) for _ in range(6)), b.get(7)] == [5, 1, 0, 3, 3, 3, 1, 1]
    with pytest.raises(EOFError):
        Bits(b"\x01").get(9)


def channel(rng, shape, rate_index, groups, books, most=400):
    order, starts = aac.coded_order(shape == aac.SHORT, tuple(groups), rate_index)
    bands = (len(starts) - 1) // len(groups)
    c = aac.Channel(shape, int(rng.integers(0, 2)), min(bands, 12), groups, int(rng.integers(90, 130)))
    c.books = np.where(np.tile(np.arange(bands), len(groups)) < c.max_sfb, rng.choice(books, len(starts) - 1), 0)
    c.scales, c.lines = np.zeros(len(c.books), dtype=np.int64), np.zeros(starts[-1], dtype=np.int64)
    for k, b in enumerate(c.books):
        if b:
            c.scales[k] = rng.integers(-20, 20) if b >= aac.INVERTED else c.gain - 90 + rng.integers(0, 30) if b == aac.NOISE else c.gain + rng.integers(-25, 25)
        if 1 <= b <= 11:
            top = min(aac.BOOKS[b][1], most) if b < 11 else most
            c.lines[starts[k] : starts[k + 1]] = rng.integers(-top, top + 1, starts[k + 1] - starts[k])
    windows = 8 if shape == aac.SHORT else 1
    c.filters = [[(int(rng.integers(1, 10)), bool(rng.integers(0, 2)), 4, rng.integers(0, 16, 3).tolist())] if rng.random() < 0.7 else [] for _ in range(windows)]
    return c


@pytest.mark.parametrize("rate_index", [0, 3, 5, 7, 8, 11])
def test_every_element_comes_back(rate_index):
    rng = np.random.default_rng(rate_index)
    for _ in range(20):
        short = rng.random() < 0.5
        shape, groups = (aac.SHORT, [1, 3, 4]) if short else (aac.LONG, [1])
        usual = [5, 6, 7, 8, 9, 10, 11, 0, aac.NOISE] if short else [*range(12), aac.NOISE]
        one = channel(rng, shape, rate_index, groups, usual)
        two = channel(rng, shape, rate_index, groups, [*usual, aac.INTENSITY, aac.INVERTED])
        two.window = one.window
        for pair in ([one], [one, two]):
            mask = rng.random(len(one.books)) < 0.5 if len(pair) == 2 else None
            found, _ = aac.parse_frame(aac.pack_frame(pair, rate_index, mask), rate_index)
            assert len(found) == len(pair)
            for c, (d, _) in zip(pair, found):
                assert (c.shape, c.window, c.max_sfb, c.groups, c.gain) == (d.shape, d.window, d.max_sfb, d.groups, d.gain)
                assert (c.books == d.books).all() and (c.scales == d.scales).all() and (c.lines == d.lines).all()
                assert d.filters == (c.filters if any(c.filters) else d.filters)


def test_stereo_tools():
    rng = np.random.default_rng(3)
    left, right = (channel(rng, aac.LONG, 4, [1], [9]) for _ in range(2))
    left.filters = right.filters = None
    right.books = np.where(np.arange(len(right.books)) == 3, aac.INVERTED, np.where(np.arange(len(right.books)) == 5, aac.NOISE, right.books))
    right.scales[3], right.scales[5] = 8, right.gain - 40
    right.lines[12:16] = right.lines[20:24] = 0
    (_, plain), = aac.parse_frame(aac.pack_frame([left], 4), 4)[0]
    mask = np.arange(len(left.books)) == 0
    (_, x), (_, y) = aac.parse_frame(aac.pack_frame([left, right], 4, mask), 4)[0]
    (_, side), = aac.parse_frame(aac.pack_frame([right], 4), 4)[0]
    assert np.allclose(x[4:], plain[4:]) and np.allclose(x[:4], plain[:4] + side[:4]) and np.allclose(y[:4], plain[:4] - side[:4])
    assert np.allclose(y[12:16], -plain[12:16] * 0.25)
    assert np.isclose(float((y[20:24] ** 2).sum()), 2.0 ** ((right.gain - 140) / 2))


def test_other_elements_are_passed_over_and_unsound_frames_are_silent():
    x = tone((440, 0.5), n=8192)[:, None]
    frames = aac.encode(x, RATE)
    extra = Packer()
    for value, width in ((aac.DATA, 3), (0, 4), (0, 1), (2, 8), (0xABCD, 16), (aac.FILL, 3), (3, 4), (0x123456, 24)):
        extra.put(value, width)
    for b in np.unpackbits(np.frombuffer(frames[2], dtype=np.uint8)):
        extra.put(int(b), 1)
    whole, bad = aac.decode(frames, RATE)
    assert bad == 0 and np.array_equal(aac.decode([*frames[:2], extra.bytes(), *frames[3:]], RATE)[0], whole)
    y, bad = aac.decode([*frames[:2], b"\x01\xff", *frames[3:]], RATE)
    assert bad == 1 and len(y) == len(whole) and np.array_equal(y[: 2 * 1024], whole[: 2 * 1024]) and np.array_equal(y[4 * 1024 :], whole[4 * 1024 :])
    assert aac.decode([], RATE)[0].shape == (0, 1)
    assert ADTS_RATES[4] == RATE


@pytest.mark.parametrize("kind", ["aac", "mp4"])
def test_files(spark, kind):
    x = np.round(32767 * tone((440, 0.4), (2500, 0.2), n=20_000)).astype(np.int64)
    rows = [("a", 0, 0, RATE, 1, x[:8192].tolist()), ("a", 1, 8192, RATE, 1, x[8192:].tolist())]
    content = audio.encode(spark.createDataFrame(rows, audio.PCM), kind)
    data = bytes(content.first()["content"])
    assert audio.container(data[:64]) == kind and (mp4.samples(data) if kind == "mp4" else adts.frames(data))
    got = [r["v"] for r in audio.samples(audio.decode(content)).orderBy("n").collect()]
    assert signal_to_noise(x.astype(float), np.array(got[1024 : 1024 + len(x)], dtype=float)) > 35


def test_files_that_do_not_decode(spark):
    files = spark.createDataFrame([("x", b"not audio at all"), ("y", b"fLaC\x80\0\0\x22" + bytes(10))], "stream_id string, content binary")
    assert audio.decode(files).count() == 0
    rows = {r["stream_id"]: r for r in audio.decode(files, errors="rows").collect()}
    assert set(rows) == {"x", "y"} and all(r["error"] and r["samples"] is None for r in rows.values())
    with pytest.raises(Exception, match="not read"):
        audio.decode(files, errors="raise").count()
