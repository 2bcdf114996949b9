import numpy as np
import pytest

from cadenza.functions.transforms import signal_to_noise
from cadenza.sources import ogg, vorbis


def mix(n=22_050, channels=2):
    t = np.arange(n) / 44100
    left = 0.3 * np.sin(2 * np.pi * 440 * t) + 0.2 * np.sin(2 * np.pi * 1000 * t)
    right = 0.3 * np.sin(2 * np.pi * 440 * t) + 0.2 * np.sin(2 * np.pi * 2500 * t)
    return np.stack([left, right], axis=1)[:, :channels]


@pytest.mark.parametrize("channels", [1, 2])
def test_round_trip(channels):
    x = mix(channels=channels)
    data = vorbis.encode(x, 44100, comments=["TITLE=x", "TITLE=y"])
    info, y = vorbis.decode(data)
    assert (info.channels, info.rate, info.blocks) == (channels, 44100, (512, 2048)) and y.shape == x.shape
    assert signal_to_noise(x[512:-512], y[512:-512]) > 15


def test_headers():
    x = np.zeros((1_000, 2))
    packets = ogg.packets(ogg.pages(vorbis.encode(x, 48000, comments=["A=1", "A=2"])))
    assert vorbis.unpack_comments(packets[1].data) == ("cadenza", ["A=1", "A=2"])
    assert np.abs(vorbis.decode(vorbis.encode(x, 48000))[1]).max() == 0
    setup = vorbis.unpack_setup(packets[2].data, 2)
    assert vorbis.pack_setup(setup, 2) == packets[2].data
    for bad in (b"", b"\1vorbis" + bytes(30), packets[0].data[:20]):
        with pytest.raises(vorbis.BadStream):
            vorbis.unpack_info(bad)
    for bad in (b"", b"\5vorbis", packets[2].data[:40]):
        with pytest.raises(vorbis.BadStream):
            vorbis.unpack_setup(bad, 2)
    with pytest.raises(vorbis.BadStream):
        vorbis.decode(b"OggS")


def test_floor_posts_fold():
    rng = np.random.default_rng(1)
    floor = vorbis._setup(1).floors[0]
    for _ in range(200):
        wanted = rng.integers(0, 256, len(floor.xs)).tolist()
        got = floor._unfold(floor.fold(wanted))
        assert [v if v >= 0 else ~v for v in got] == wanted


def test_codebooks():
    book = vorbis.Codebook(2, [2, 2, 2, 3, 3] + [0] * 4, 1, -1.0, 1.0, 2, False, [0, 1, 2])
    w = vorbis.LsbWriter()
    book.pack(w)
    back = vorbis.unpack_codebook(vorbis.LsbReader(w.bytes()))
    assert back.codes == book.codes and (back.vectors == book.vectors).all()
    assert book.vectors[5].tolist() == [1.0, 0.0] and book.nearest(np.array([[0.9, 0.2]]))[0] == 5
    w = vorbis.LsbWriter()
    for e in (0, 3, 4, 2, 1):
        book.put(w, e)
    r = vorbis.LsbReader(w.bytes())
    assert [book.read(r) for _ in range(5)] == [0, 3, 4, 2, 1]
