import hashlib

import numpy as np

from echofold.functions import constants as C


def test_permutations_have_the_published_digest():
    t = C.permutation_table()
    assert t.shape == (100, 255) and t[0, :3].tolist() == [532, 5740, 4559]
    assert hashlib.sha256(t.astype("<u2").tobytes()).hexdigest() == "cb72bee118f8dc959e44b99e3a2cf40d5ab74be6bca3006231fc438449d473c5"
    assert all(len(set(r)) == 255 for r in t.tolist())


def test_bin_edges():
    e = C.bin_edges()
    assert len(e) == 33 and e[0] == 118 and e[-1] == 743 and list(e) == sorted(set(e))


def test_frame_arithmetic():
    assert (C.n_frames(31444), C.n_images(31444), C.MIN_SAMPLES) == (460, 42, 10176)
    assert C.n_images(C.MIN_SAMPLES) == 1 and C.n_images(C.MIN_SAMPLES - 1) == 0


def test_filter_and_windows():
    h = C.fir_taps()
    assert len(h) == 31 and h[15] == 0.125 and abs(h.sum() - 0.96657) < 1e-5 and np.allclose(h, h[::-1])
    assert C.hann()[0] == 0 and abs(C.hann()[-1]) < 1e-12


def test_haar_is_orthonormal():
    for n in (8, 32, 128):
        m = C.haar_matrix(n)
        assert np.allclose(m @ m.T, np.eye(n))
    assert np.count_nonzero(C.haar_matrix(32)) == 192 and np.count_nonzero(C.haar_matrix(128)) == 1024
