import numpy as np
import pytest

from cadenza.functions import transforms as t

RNG = np.random.default_rng(1337)


@pytest.mark.parametrize("n", [16, 64, 128, 256, 1024])
def test_mdct_is_its_definition(n):
    x = RNG.normal(size=(3, 2 * n))
    assert np.allclose(t.mdct(x), x @ t._basis(n).T, atol=1e-8 * n)
    c = RNG.normal(size=(3, n))
    assert np.allclose(t.imdct(c), c @ t._basis(n), atol=1e-8 * n)


@pytest.mark.parametrize("n", [64, 128, 1024])
@pytest.mark.parametrize("window", [t.sine_window, lambda n: t.kbd_window(n, 4.0), lambda n: np.concatenate([t.slope_window(n // 2), t.slope_window(n // 2)[::-1]])])
def test_perfect_reconstruction(n, window):
    x = RNG.normal(size=5 * n + 17)
    y = t.synthesise(t.analyse(x, n, window(2 * n)), window(2 * n))
    assert np.allclose(y[: len(x)], x, atol=1e-9)


def test_stereo_and_coupling():
    a, b = RNG.integers(-50, 50, (2, 1000))
    m, s = (a + b) / 2, (a - b) / 2
    assert all(np.allclose(u, v) for u, v in zip(t.mid_side(m, s), (a, b)))
    assert all((u == v).all() for u, v in zip(t.decouple(*t.couple(a, b)), (a, b)))
    assert np.allclose(t.intensity(np.ones(2), np.array([0, 4]), np.array([False, True])), [1, -0.5])


def test_quantisers():
    x = RNG.normal(size=500) * 1000
    y = t.requantise(t.quantise(x, 8), 8)
    assert t.signal_to_noise(x, y) > 30
    n, seed = t.noise(1, 64, 25.0)
    assert abs(float(n @ n) - 25) < 1e-9 and seed != 1


def test_prediction_over_spectra():
    k = t.tns_coefficients(np.array([3, -2, 1]), 4)
    a = t.reflection_to_direct(k)
    x = RNG.normal(size=200)
    y = np.convolve(x, np.concatenate([[1.0], a]))[:200]
    assert np.allclose(t.all_pole(y, a), x)
    z = np.convolve(x[::-1], np.concatenate([[1.0], a]))[:200][::-1]
    assert np.allclose(t.all_pole(z, a, down=True), x)


def test_alias_butterflies_undo():
    x = RNG.normal(size=(2, 32, 18))
    assert np.allclose(t.alias_butterflies(t.alias_butterflies(x, False)), x)


def test_floor_curves():
    assert [t.render_point(0, 10, 10, 0, x) for x in (0, 5, 10)] == [10, 5, 0]
    curve = t.render_floor([0, 8, 16], [0, 16, 8], 20)
    assert curve[[0, 4, 8, 12, 16, 19]].tolist() == [0, 8, 16, 12, 8, 8]
    assert all(t.render_point(0, 0, 8, 16, x) == curve[x] for x in range(8))
    assert t.floor_gain(np.array([255]))[0] == 1 and t.floor_gain(np.array([0]))[0] < 2e-7


def test_codebooks():
    assert t.canonical_codes([2, 4, 4, 4, 4, 2, 3, 3]) == [0b00, 0b0100, 0b0101, 0b0110, 0b0111, 0b10, 0b110, 0b111]
    assert t.canonical_codes([1, 0, 1]) == [0, None, 1]
    with pytest.raises(ValueError):
        t.canonical_codes([1, 1, 1])
    for v in (0.0, 1.0, -2.5, 1024.0, 2.0**-10):
        assert t.unpack_float(t.pack_float(v)) == v
    assert [t.ilog(v) for v in (0, 1, 2, 7, 8, -1)] == [0, 1, 2, 3, 4, 0]
