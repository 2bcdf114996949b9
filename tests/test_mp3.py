import numpy as np
import pytest

from cadenza.functions.bits import Packer
from cadenza.functions.prefix import Bits
from cadenza.functions.transforms import signal_to_noise
from cadenza.sources import audio, mp3


def tone(rate, n, *parts):
    return sum(a * np.sin(2 * np.pi * f * np.arange(n) / rate) for f, a in parts)


def snr(x, y):
    return signal_to_noise(x, y[mp3.DELAY : mp3.DELAY + len(x)])


@pytest.mark.parametrize(("rate", "kbps", "least"), [(44100, 128, 35), (44100, 320, 50), (48000, 192, 40), (32000, 128, 40), (22050, 64, 35), (24000, 64, 35), (16000, 48, 30), (11025, 32, 30), (8000, 24, 25)])
def test_round_trip(rate, kbps, least):
    n = rate
    x = np.stack([tone(rate, n, (440, 0.4), (1000, 0.2)), tone(rate, n, (440, 0.3), (rate / 9, 0.1))], axis=1)
    for signal in (x, x[:, :1], np.stack([x[:, 0]] * 2, axis=1)):
        data = mp3.encode(signal, rate, kbps)
        got, y = mp3.decode(data)
        assert got == rate and snr(signal, y) > least and mp3.parse(data)[3] == 0
        assert abs(len(data) * 8 * rate / (kbps * 1000 * len(y)) - 1) < 0.02


def test_filter_bank_and_transforms_give_the_signal_back():
    rng = np.random.default_rng(2)
    x, h = rng.normal(size=32 * 18 * 40), mp3.prototype()
    assert signal_to_noise(x[:-2000], mp3.polyphase_synthesis(mp3.polyphase_analysis(x, h), h)[481 : len(x) - 1519]) > 60
    bands = rng.normal(size=(18 * 40, 32))
    kinds = np.array([0, 1, 2, 2, 3, 0, 0, 1, 2, 3] * 4)
    back = mp3.hybrid(mp3.hybrid_analysis(bands, kinds), kinds)
    assert np.allclose(back[18:], bands[:-18], atol=1e-9)


def test_attacks_switch_blocks():
    n = 44100
    x = (np.where(np.arange(n) % 11025 < 40, 0.8, 0.0) * np.sin(np.arange(n)))[:, None]
    kinds = mp3.granule_kinds(x[:, 0])
    assert set(zip(kinds.tolist(), kinds[1:].tolist())) <= {(0, 0), (0, 1), (1, 2), (2, 2), (2, 3), (3, 0), (3, 1)} and 2 in kinds
    assert snr(x, mp3.decode(mp3.encode(x, n, 192))[1]) > 20


def test_codes():
    for table in [*mp3.WORDS, 13, 15, 16, 24]:
        code, size, _ = mp3.Tables.by_rule().code(table)
        assert len(code.codes) == size * size and sum(2.0 ** -int(n) for n in code.lengths) == 1 and code.width <= 19
    for second in (False, True):
        assert sum(2.0 ** -int(n) for n in mp3.quad_code(second).lengths) == 1
    assert [mp3._candidates(m) for m in (0, 1, 15, 16, 23, 8206)] == [[0], [1], [13, 15], [16, 24], [19, 24], [23, 31]]


@pytest.mark.parametrize("rate", [44100, 32000, 8000])
def test_lines_come_back(rate):
    rng = np.random.default_rng(rate)
    tables = mp3.Tables.by_rule()
    for top in (0, 1, 2, 5, 7, 15, 40, 8000):
        for kind in (mp3.LONG, mp3.START, mp3.SHORT):
            q = rng.integers(-top, top + 1, mp3.LINES) * (np.arange(mp3.LINES) < rng.integers(0, 300))
            q[300 : 300 + int(rng.integers(0, 277))] = rng.integers(-1, 2) if top else 0
            g = mp3.Granule(switched=kind != mp3.LONG, kind=kind)
            bits = mp3.layout(q, g, rate, tables)
            g.lines, out = q, Packer()
            out.put(0, 0)
            assert mp3._put_lines(out, g, rate, tables) == bits
            back = mp3.Granule(big=g.big, switched=g.switched, kind=kind, tables=g.tables, counts=g.counts, second=g.second)
            mp3._read_lines(Bits((out.bytes() if bits else b"") + b"\xff" * 8), back, rate, bits, tables)
            assert np.array_equal(back.lines, q)


def test_bit_reservoir():
    # The same frames, each one's main data brought forward into the frame before as far as there is room.
    n = 44100 // 2
    x = tone(44100, n, (440, 0.4))[:, None]
    data = mp3.encode(x, 44100, 128)
    _, plain = mp3.decode(data)
    parts, out, room = [], [], 0
    for at, h in mp3.frames(data):
        side = Bits(data[at + 4 : at + 4 + h.side_bytes])
        _, _, rows = mp3._read_side(side, h)
        need = -(-sum(g.length for r in rows for g in r) // 8)
        parts.append((h, data[at : at + 4 + h.side_bytes], data[at + 4 + h.side_bytes : at + h.size][:need]))
    heads, stream, sizes = [], bytearray(), []
    start = 0
    for h, head, main in parts:
        begin = min(len(stream) and start - len(stream), 511) if start > len(stream) else 0
        at = start - begin
        stream += bytes(at - len(stream)) + main
        word = bytearray(head)
        word[4], word[5] = begin >> 1, (begin & 1) << 7 | word[5] & 127
        heads.append(bytes(word))
        sizes.append(h.size - len(head))
        start += sizes[-1]
    stream += bytes(start - len(stream))
    at = 0
    for head, size in zip(heads, sizes):
        out.append(head + bytes(stream[at : at + size]))
        at += size
    moved = b"".join(out)
    assert any(h[4] for h in heads[2:]) and len(moved) == len(data)
    assert np.array_equal(mp3.decode(moved)[1], plain)
    # Without the first frame the second one's pointer finds zeros, and later ones are whole again.
    cut = mp3.decode(moved[len(out[0]) :])[1]
    assert np.allclose(cut[8 * 1152 :], plain[9 * 1152 :])


def test_scale_factors_and_exponents():
    g = mp3.Granule(gain=200, pre=True, coarse=True)
    g.long = list(range(22))
    e = mp3.exponents(g, 44100)
    assert e[0] == -10 and e[-1] == -10 - 4 * 21 and e[342] == -10 - 4 * (20 + 2)
    s = mp3.Granule(gain=210, switched=True, kind=mp3.SHORT, lower=[0, 1, 2])
    s.short[0], s.short[12] = [1, 2, 3], [0, 0, 0]
    e = mp3.exponents(s, 44100)
    assert e[:12].tolist() == [-2] * 4 + [-12] * 4 + [-22] * 4 and e[-1] == -16
    assert sorted(mp3.short_order(44100).tolist()) == list(range(576))
    out = Packer()
    for width, band in ((3, 6), (2, 6)):
        for k in range(3 * band):
            out.put(k % (1 << width), width)
    back = mp3.Granule(compress=12, switched=True, kind=mp3.SHORT)
    assert (mp3.WIDTHS[0][12], mp3.WIDTHS[1][12]) == (3, 2)
    mp3._read_scales(Bits(out.bytes()), back, True, None, [False] * 4)
    assert back.short[0] == [0, 1, 2] and back.short[2] == [6, 7, 0] and back.short[6] == [0, 1, 2]
    before = mp3.Granule()
    before.long = [9] * 21 + [0]
    shared = mp3.Granule(compress=4)
    mp3._read_scales(Bits(b"\xff" * 8), shared, True, before, [True, False, True, False])
    assert shared.long == [9] * 6 + [7] * 5 + [9] * 5 + [0] * 6


def test_headers():
    for rate in mp3.LONG_BANDS:
        for kbps in (32, 64, 128):
            for channels in (1, 2):
                word = mp3.header_word(rate, kbps, channels, 1, channels == 2)
                h = mp3.parse_header(word.to_bytes(4, "big"))
                assert (h.rate, h.kbps, h.channels, h.padding, h.mid_side, h.protected) == (rate, kbps, channels, 1, channels == 2, False)
    good = mp3.header_word(44100, 128, 2)
    for broken in (good & ~(1 << 21), good & ~(3 << 17), good | 15 << 12, good & ~(15 << 12), good | 3 << 10, good & ~3 | 2, good & ~(3 << 19) | 1 << 19):
        assert mp3.parse_header(broken.to_bytes(4, "big")) is None


def test_tables_from_a_file(tmp_path):
    rule = mp3.Tables.by_rule()
    path = tmp_path / "tables.txt"
    words = " ".join(format(k, "08b") for k in range(256))
    path.write_text(f"13 {words}\nwindow {' '.join(map(str, rule.window.tolist()))}\n")
    loaded = mp3.Tables.load(str(path))
    assert set(loaded.codes[13].lengths) == {8} and np.array_equal(loaded.window, rule.window)
    x = tone(44100, 9216, (440, 0.5))[:, None]
    assert snr(x, mp3.decode(mp3.encode(x, 44100, 128, loaded), loaded)[1]) > 35
    path.write_text("13 0 1\n")
    with pytest.raises(ValueError):
        mp3.Tables.load(str(path))


def test_files(spark):
    x = np.round(32767 * tone(44100, 20_000, (440, 0.4), (2500, 0.2))).astype(np.int64)
    rows = [("a", 0, 0, 44100, 1, x[:8192].tolist()), ("a", 1, 8192, 44100, 1, x[8192:].tolist())]
    content = audio.encode(spark.createDataFrame(rows, audio.PCM), "mp3", kbps=128)
    data = bytes(content.first()["content"])
    assert audio.container(data[:64]) == audio.container(b"ID3\x04\0\0\0\0\0\x0a" + bytes(54)) == "mp3"
    info = audio.streams(content).first()
    assert (info["container"], info["rate"], info["channels"], info["format"], info["error"]) == ("mp3", 44100, 1, "mp3", None)
    got = [r["v"] for r in audio.samples(audio.decode(content)).orderBy("n").collect()]
    assert signal_to_noise(x.astype(float), np.array(got[mp3.DELAY : mp3.DELAY + len(x)], dtype=float)) > 35
    tagged = b"ID3\x04\0\0\0\0\0\x14" + b"\xff" * 20 + data
    assert np.array_equal(mp3.decode(tagged)[1], mp3.decode(data)[1])
    frames = audio.mp3_frames(content).orderBy("frame_no").collect()
    assert len(frames) == len(mp3.frames(data)) and frames[1]["offset"] == frames[0]["bytes"] and frames[0]["kbps"] == 128


def test_unsound_frames_are_silent():
    x = tone(44100, 20_000, (440, 0.4))[:, None]
    data = bytearray(mp3.encode(x, 44100, 128))
    places = mp3.frames(bytes(data))
    at, h = places[5]
    data[at + 4 : at + 4 + h.side_bytes] = bytes(4) + b"\xff" * (h.side_bytes - 4)
    rate, y = mp3.decode(bytes(data))
    assert len(y) == len(mp3.decode(mp3.encode(x, 44100, 128))[1]) and np.isfinite(y).all()
    with pytest.raises(ValueError):
        mp3.decode(b"nothing here")
