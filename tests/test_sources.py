import hashlib
import struct

import numpy as np
import pytest

from cadenza.functions import checksums, samples
from cadenza.functions.bits import Packer, Reader
from cadenza.sources import adts, aiff, flac, mp4, ogg, sidecars, wav

RNG = np.random.default_rng(3)


def test_bits_round_trip():
    p, fields = Packer(), [(int(RNG.integers(0, 1 << w)), w) for w in RNG.integers(1, 33, 300).tolist()]
    for v, w in fields:
        p.put(v, w)
    r = Reader(p.bytes())
    assert [(r.get(w), w) for _, w in fields] == fields


@pytest.mark.parametrize("k", [0, 2, 4, 9])
def test_rice_round_trip(k):
    x = np.array([0, 1, -1, 2, -2, 5, -8, 12, -15, 0, 1, -1, 3, -4, 2, -2, 900, -900])
    p = Packer()
    p.rice(x, k)
    assert Reader(p.bytes()).rice(len(x), k) == x.tolist()


@pytest.mark.parametrize("name", wav.FORMATS)
def test_wav_round_trip(name):
    x = RNG.integers(-32768, 32768, (1001, 2)).astype(np.int16)
    info, y = wav.read(wav.write(x, 44100, name), "i16")
    assert (info.rate, info.channels, info.frames, info.name) == (44100, 2, 1001, name)
    if name in ("s16", "s24", "s32"):
        assert (x == y).all()
    elif name == "u8":
        assert (y == x >> 8 << 8).all()
    elif name == "f32":
        assert np.abs(y.astype(int) - x).max() <= 1
    else:
        again = wav.read(wav.write(y, 44100, name), "i16")[1]
        assert (again == y).all() and np.abs(y.astype(int) - x).max() <= 1024


def test_wav_headers():
    x = np.zeros((10, 4), dtype=np.int16)
    data = wav.write(x, 48000, mask=0x33)
    assert wav.parse(data).mask == 0x33 and struct.unpack_from("<H", data, 20)[0] == wav.EXTENSIBLE
    junk = data[:12] + b"junk" + struct.pack("<I", 3) + b"abc\0" + data[12:]
    assert wav.read(junk)[1].shape == (10, 4)
    for bad in (b"", b"RIFFxxxxWAVE", data[:12] + data[-88:], b"RIFF" + bytes(40)):
        with pytest.raises(wav.BadFile):
            wav.parse(bad)
    assert wav.read(data[:-3])[1].shape == (9, 4)  # a partial frame is left out
    part = wav.read(wav.write(np.arange(100, dtype=np.int16), 8000), first=10, frames=5)[1]
    assert part[:, 0].tolist() == [10, 11, 12, 13, 14]


def test_wav_float_rounding():
    x = np.array([0.0, 1.0, -1.0, 0.5, -0.5, 2.0, -2.0], dtype=np.float32)
    assert samples.unpack_integers(samples.encode(x, wav.FORMATS["s16"][1]), wav.FORMATS["s16"][1]).tolist() == [0, 32767, -32768, 16384, -16384, 32767, -32768]
    assert samples.unpack_integers(samples.encode(x, aiff.FORMATS["s16"][1], wav=False), aiff.FORMATS["s16"][1]).tolist() == [0, 32767, -32768, 16384, -16384, 32767, -32768]
    y = samples.decode(np.array([0, 128, 255], np.uint8).tobytes(), wav.FORMATS["u8"][1], "f32")
    assert y.tolist() == [-1.0, 0.0, 127 / 128]


@pytest.mark.parametrize("name", aiff.FORMATS)
def test_aiff_round_trip(name):
    x = RNG.integers(-32768, 32768, (501, 2)).astype(np.int16)
    info, y = aiff.read(aiff.write(x, 44100, name), "i16")
    assert (info.rate, info.channels, info.frames, info.name) == (44100, 2, 501, name)
    if name[:3] in ("s16", "s24", "s32"):
        assert (x == y).all()
    for bad in (b"", b"FORMxxxxAIFF", aiff.write(x, 8000)[:20]):
        with pytest.raises(wav.BadFile):
            aiff.parse(bad)


def test_ieee80():
    for v in (0.0, 1.0, 44100.0, 8000.0, 96000.0, -2.5, 1e-3, float("inf")):
        assert samples.from_ieee80(samples.to_ieee80(v)) == pytest.approx(v, rel=1e-15)
    assert samples.to_ieee80(44100.0).hex() == "400eac44000000000000"


def test_g711_tables():
    a, m = samples.g711_table("a"), samples.g711_table("m")
    assert (a[0x55], a[0xD5], a[0x2A], m[0], m[0xFF], m[0x7F]) == (-8, 8, -32256, -32124, 0, 0)
    assert (samples.g711_encode(a, "a") == np.arange(256)).all()


def tones(n):
    t = np.arange(n) / 44100
    return np.stack([16000 * np.sin(2 * np.pi * 440 * t), 16000 * np.cos(2 * np.pi * 1000 * t)], axis=1).astype(np.int16)


@pytest.mark.parametrize("level", [0, 2, 5, 8])
@pytest.mark.parametrize("block", [1152, 4096])
def test_flac_is_lossless(level, block):
    x = tones(2 * block + 100)
    data = flac.write(x, 44100, block=block, level=level)
    info, y = flac.read(data)
    assert (y == x).all() and (info.rate, info.channels, info.bits, info.total) == (44100, 2, 16, len(x))
    assert info.md5 == hashlib.md5(x.astype("<i2").tobytes()).digest()
    assert len(data) < x.nbytes


@pytest.mark.parametrize("kind", ["noise", "zeros", "wasted", "mono", "deep", "short"])
def test_flac_corner_cases(kind):
    bits = 24 if kind == "deep" else 16
    x = {
        "noise": RNG.integers(-32768, 32768, (3000, 2)),
        "zeros": np.zeros((3000, 2), dtype=int),
        "wasted": RNG.integers(-1000, 1000, (3000, 2)) * 8,
        "mono": RNG.integers(-100, 100, (3000, 1)),
        "deep": RNG.integers(-(1 << 23), 1 << 23, (2000, 2)),
        "short": RNG.integers(-9, 9, (3, 2)),
    }[kind]
    assert (flac.read(flac.write(x, 48000, bits=bits, block=1024, level=6))[1] == x).all()


def test_flac_frames_stand_alone_and_resync():
    x = tones(4096 * 3)
    data = flac.write(x, 44100)
    info, at = flac.parse_header(data)
    h, y, end = flac.decode_frame(data, info, at + 100)  # into the first frame: the second one is found
    assert h.number == 1 and (y == x[4096:8192]).all()
    bad = bytearray(data)
    bad[at + 50] ^= 255
    assert flac.decode_frame(bytes(bad), info, at)[0].number == 1
    for n in (0, 127, 128, 2047, 2048, 65535, 65536, 1 << 21, (1 << 31) - 1, 1 << 35):
        assert flac._coded_number(flac.put_number(n) + b"\0", 0) == (n, len(flac.put_number(n)))
    with pytest.raises(flac.BadFrame):
        flac.parse_header(b"fLaX")


def test_flac_frames_are_found_without_decoding():
    x = RNG.integers(-32768, 32768, (5_000, 2))
    data = flac.write(x, 44100, block=700)
    info, spans = flac.frame_spans(data)
    assert [h.number for h, *_ in spans] == list(range(8)) and spans[-1][2] == len(data)
    assert (np.concatenate([flac.decode_frame(data[a:b], info)[1] for _, a, b in spans]) == x).all()
    bad = bytearray(data)
    bad[spans[2][1] + 60] ^= 1
    assert [h.number for h, *_ in flac.frame_spans(bytes(bad))[1]] == [0, 1, 3, 4, 5, 6, 7]


def test_checksums():
    assert checksums.crc(b"123456789", "flac8") == 0xF4
    assert checksums.crc(b"123456789", "flac16") == 0xFEE8
    assert checksums.crc(b"123456789", "ogg") == 0x89A1897F


def test_ogg_packets_cross_pages():
    sizes = [0, 1, 254, 255, 256, 300, 510, 70_000, 5]
    packets = [(RNG.integers(0, 256, n, dtype=np.uint8).tobytes(), 100 * k) for k, n in enumerate(sizes)]
    data = ogg.mux(packets, 7, per_page=20)
    pages = ogg.pages(b"junk" + data + b"OggS")
    got = ogg.packets(pages)
    assert [p.data for p in got] == [d for d, _ in packets] and got[-1].last and {p.serial for p in got} == {7}
    assert got[-1].granule == 800 and pages[0].flags & ogg.FIRST
    # A lost page: what it held is gone, the rest stays.
    lost = ogg.packets(pages[:2] + pages[3:])
    assert len(lost) < len(got) and all(p.data in [d for d, _ in packets] for p in lost) and lost[-1].data == packets[-1][0]
    bad = bytearray(data)
    bad[40] ^= 1
    assert len(ogg.pages(bytes(bad))) == len(pages) - 1
    assert [len(x.laces) for x in ogg.pages(ogg.mux([(bytes(300), 0)], 1))] == [2]


def test_adts():
    frames = [RNG.integers(0, 255, n, dtype=np.uint8).tobytes() for n in (10, 200, 333)]
    for protected in (False, True):
        data = b"\xff" + b"".join(adts.wrap(f, 44100, 2, protected) for f in frames)
        found = adts.frames(data + b"\xff\xf1")
        assert [p for *_, p in found] == frames and found[0][1].rate == 44100 and found[0][1].channels == 2
    damaged = bytearray(adts.wrap(frames[1], 44100, 2, True))
    damaged[20] ^= 1
    assert adts.frames(bytes(damaged)) == []


def test_mp4_round_trip():
    frames = [bytes([k]) * (50 + k) for k in range(20)]
    data = mp4.write(frames, 44100, 2)
    m = mp4.read(data)
    assert (m.config.object_type, m.config.rate, m.config.channels) == (2, 44100, 2) and mp4.samples(data) == frames
    assert mp4.samples(mp4.write([], 48000, 1)) == []
    for bad in (b"", data[:100], data.replace(b"moov", b"xxxx")):
        with pytest.raises(mp4.BadMovie):
            mp4.read(bad)
    assert mp4.parse_config(mp4.AudioConfig(2, 12345, 1).pack()).rate == 12345
    assert mp4.AudioConfig(2, 44100, 2).pack().hex() == "1210"


def test_sidecars():
    levels = [RNG.integers(-128, 128, (n, 4)).astype(np.int8) for n in (512, 32, 2)]
    e = sidecars.Envelope(44100, 65536, levels)
    back = sidecars.Envelope.unpack(e.pack())
    assert len(e.pack()) == 128 + 546 * 4 and all((a == b).all() for a, b in zip(levels, back.levels)) and back.frames == 65536
    s = sidecars.Spectrum(44100, 9000, [RNG.integers(0, 256, (n, 64)).astype(np.uint8) for n in (18, 2)])
    assert all((a == b).all() for a, b in zip(s.levels, sidecars.Spectrum.unpack(s.pack()).levels))
    t = sidecars.Tempo(44100, 10_000, 120 << 16, 200, np.array([(0, 120 << 16)], sidecars.POINT), np.array([(500 * k, k // 4 + 1, k % 4 + 1, k % 4 == 0, 120 << 16) for k in range(20)], sidecars.BEAT))
    back = sidecars.Tempo.unpack(t.pack())
    assert (back.beats == t.beats).all() and (back.curve == t.curve).all() and back.bpm_q16 == 120 << 16
    rows = np.zeros(2, sidecars.SLICE)
    rows["start_sample"], rows["length_samples"], rows["musical_tick"], rows["midi_note"] = [0, 22050], 22050, [0, 480], [36, 37]
    a = sidecars.Slices(44100, 44100, rows)
    assert (sidecars.Slices.unpack(a.pack()).rows == rows).all() and len(a.pack()) == 192
    for kind, data in ((sidecars.Envelope, e), (sidecars.Spectrum, s), (sidecars.Tempo, t), (sidecars.Slices, a)):
        good = data.pack()
        for bad in (b"", good[:100], b"X" + good[1:], good[:4] + b"\2" + good[5:], good[:-5]):
            with pytest.raises(sidecars.BadSidecar):
                kind.unpack(bad)
