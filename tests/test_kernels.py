import numpy as np
import pytest

from echofold.functions import constants as C
from echofold.functions import kernels as K


def test_worked_minhash_example():
    places = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOP")}
    on = {i for i, b in enumerate("0000001010000010") if b == "1"}
    shuffles = ("EBPKGALNIOFCJDHM", "GLFHEPIJKNCMBAOD", "DKJPBNILACGFOMEH")
    assert [next(i for i, c in enumerate(p) if places[c] in on) for p in shuffles] == [4, 0, 6]


def test_minhash_is_the_first_set_bit():
    bits = np.array([5, 77, 4000, 8000])
    want = [next((i for i, b in enumerate(row) if b in bits), 255) for row in C.permutation_table().tolist()]
    assert K.minhash(bits).tolist() == want
    assert set(K.minhash(np.zeros(0, int)).tolist()) == {255}


def test_decimation_equals_the_sum():
    x = np.random.default_rng(1).normal(size=100).astype(np.float32)
    h = C.fir_taps()
    want = [sum(x[8 * i + j] * h[j] for j in range(31) if 8 * i + j < 100) for i in range(12)]
    assert np.allclose(K.decimate(x), want, atol=1e-5)


@pytest.mark.parametrize("gain", [1e-6, 0.05, 1.0, 50.0])
def test_normalising_clamps(gain):
    x = (gain * np.random.default_rng(2).normal(size=500)).astype(np.float32)
    y = K.rms_normalize(x)
    r = min(max(10 * np.sqrt(np.mean(x.astype(float) ** 2)), 0.1), 3.0)
    assert np.allclose(y, np.clip(x / r, -1, 1), atol=1e-6)


def test_silence_has_no_signature():
    assert K.signatures(np.zeros(C.MIN_SAMPLES * 2, np.float32)) == []


def test_images_and_signatures_of_a_tone():
    t = np.arange(31444) / 5512.5
    x = K.rms_normalize(sum(np.sin(2 * np.pi * f * t * (1 + 0.1 * np.sin(t))) for f in (400, 900, 1500)).astype(np.float32))
    assert K.images(K.frame_bins(x)).shape == (42, 128, 32)
    found = K.signatures(x)
    assert len(found) == 42 and all(len(s) == 100 for _, s in found)


def test_pcm():
    pcm = np.array([[100, -100], [32767, 32767]], "<i2").tobytes()
    assert np.allclose(K.pcm_to_mono(pcm), [0, 1])
    assert K.pcm_to_mono(pcm, signed=False)[0] > 0.9


def test_window_schedule():
    second = 176_400
    divides = K.stream_windows([25_200] * 7 * 13)
    assert [round((b - a) / second, 1) for a, b in divides] == [2, 3, 4, 5, 6, 7, 8, 9, 10, 10, 10, 10]
    other = K.stream_windows([4096] * 560)
    sizes = [(b - a) / second for a, b in other]
    assert [int(s) for s in sizes[:8]] == [2, 3, 4, 5, 6, 7, 8, 9] and all(9 <= s < 9.1 for s in sizes[8:])


def plain_haar(row):
    """The decomposition step by step: sums and differences of pairs, then the same over the sums."""
    out, n = list(row), len(row)
    while n > 1:
        pairs = [(out[2 * i], out[2 * i + 1]) for i in range(n // 2)]
        out[:n] = [(a + b) / 2**0.5 for a, b in pairs] + [(a - b) / 2**0.5 for a, b in pairs]
        n //= 2
    return out


def chirp(seconds, seed=0):
    t = np.arange(int(seconds * 5512.5)) / 5512.5
    return K.rms_normalize((sum(np.sin(2 * np.pi * f * t * (1 + 0.1 * np.sin(t))) for f in (400, 900, 1500)) + 0.1 * np.random.default_rng(seed).normal(size=len(t))).astype(np.float32))


def test_spectra_of_2048_points_equal_the_sum():
    """A few frames against the plain transform and bins of the real size."""
    x, n = chirp(3), C.FRAME_LENGTH
    got = K.frame_bins(x)
    assert got.shape == (C.n_frames(len(x)), 32)
    edges, t = C.bin_edges(), np.arange(n)
    for frame in (0, 57, len(got) - 1):
        own = x[frame * C.FRAME_HOP : frame * C.FRAME_HOP + n].astype(float) * (0.5 * (1 - np.cos(2 * np.pi * t / (n - 1))))
        power = [(own @ np.cos(2 * np.pi * t * k / n) / 1024) ** 2 + (own @ np.sin(2 * np.pi * t * k / n) / 1024) ** 2 for k in range(edges[-1])]
        want = [sum(power[a:b]) / (b - a) for a, b in zip(edges, edges[1:], strict=False)]
        assert np.allclose(got[frame], want, rtol=1e-4, atol=1e-9)


def test_kernel_path_equals_plain_loops_at_its_real_size():
    """Images of 128 x 32, Haar along both axes, the 200 largest, 8,192 bits and 100 ranks."""
    bins = K.frame_bins(chirp(2.6))
    scaled = K.images(bins)
    for k in (0, len(scaled) - 1):
        own = bins[k * C.IMAGE_HOP : k * C.IMAGE_HOP + C.IMAGE_WIDTH].astype(float)
        want = np.log1p(np.minimum(255, 255 * own / own.max())) / np.log(256)
        assert np.allclose(scaled[k], want, atol=1e-5)
    coefficients = K.haar_2d(scaled)
    bits, silent = K.top_bits(coefficients)
    found = dict(K.signatures(chirp(2.6)))
    for k in (0, len(scaled) - 1):
        wide = np.array([plain_haar(col) for col in scaled[k].T.astype(float)]).T
        want = np.array([plain_haar(row) for row in wide])
        assert np.allclose(coefficients[k], want, atol=1e-5)
        flat = coefficients[k].ravel().tolist()
        top = sorted(range(len(flat)), key=lambda i: (-abs(flat[i]), i))[:200]
        own = {2 * i + (flat[i] < 0) for i in top if abs(flat[i]) > 0.001}
        assert set(bits[k].tolist()) == own and silent[k] == (sum(abs(flat[i]) > 1 for i in top) < 10)
        ranks = [next((r for r, b in enumerate(row) if b in own), 255) for row in C.permutation_table().tolist()]
        assert found[k] == bytes(ranks)
