"""Fixed values of the signal path, and the tables that follow from them."""

from __future__ import annotations

import functools
import math

import numpy as np

# They must be these for fingerprints to be comparable.
SAMPLE_RATE = 44_100
DECIMATION = 8
FIR_TAPS = 31
RMS_GAIN, RMS_LOW, RMS_HIGH = 10.0, 0.1, 3.0
FRAME_LENGTH, FRAME_HOP = 2048, 64
N_BINS, LOW_HZ, HIGH_HZ, NYQUIST_HZ = 32, 318.0, 2000.0, 2756.0
IMAGE_WIDTH, IMAGE_HOP = 128, 8
TOP_WAVELETS, DEAD_ZONE, LOUD, MIN_LOUD = 200, 0.001, 1.0, 10
N_BITS, N_PERMUTATIONS, PERMUTATION_LENGTH, PERMUTATION_SEED = 8192, 100, 255, 678233
NO_BIT = 255
N_BANDS, BAND_BYTES = 25, 4
MIN_BANDS, MIN_SCORE, MIN_MATCHES, GOOD_SCORE, MIN_AVERAGE, TOP_ENTRIES = 2, 30, 10, 35, 30, 10
STREAM_MAX_SECONDS, STREAM_MIN_SECONDS = 10, 2

MIN_SAMPLES = FRAME_LENGTH + (IMAGE_WIDTH - 1) * FRAME_HOP


def n_frames(n_samples: int) -> int:
    return 1 + (n_samples - FRAME_LENGTH) // FRAME_HOP if n_samples >= FRAME_LENGTH else 0


def n_images(n_samples: int) -> int:
    frames = n_frames(n_samples)
    return 1 + (frames - IMAGE_WIDTH) // IMAGE_HOP if frames >= IMAGE_WIDTH else 0


@functools.cache
def fir_taps(n: int = FIR_TAPS, cutoff: float = 1 / DECIMATION) -> np.ndarray:
    """A windowed-sinc low-pass filter with a Blackman window."""
    x = np.arange(n) - (n - 1) // 2
    window = 0.42 - 0.5 * np.cos(2 * np.pi * (x - (n - 1) // 2) / (n - 1)) + 0.08 * np.cos(4 * np.pi * (x - (n - 1) // 2) / (n - 1))
    return cutoff * np.sinc(cutoff * x) * np.where(x == 0, 1.0, window)


@functools.cache
def hann(n: int = FRAME_LENGTH) -> np.ndarray:
    return 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / (n - 1)))


@functools.cache
def bin_edges(n_bins: int = N_BINS, low: float = LOW_HZ, high: float = HIGH_HZ) -> tuple[int, ...]:
    """Places in the spectrum where the logarithmic bins start, and where the last one ends."""
    step = (math.log2(high) - math.log2(low)) / n_bins
    return tuple(max(1, min(1024, math.floor(1024 * 2 ** (math.log2(low) + i * step) / NYQUIST_HZ + 0.5))) for i in range(n_bins + 1))


@functools.cache
def haar_matrix(n: int) -> np.ndarray:
    """The orthonormal Haar basis as rows, coarse to fine, for n a power of two."""
    h = np.eye(n)
    size = n
    while size > 1:
        step, half = np.eye(n), size // 2
        step[:size, :size] = 0
        for i in range(half):
            step[i, 2 * i] = step[i, 2 * i + 1] = step[half + i, 2 * i] = 1 / math.sqrt(2)
            step[half + i, 2 * i + 1] = -1 / math.sqrt(2)
        h, size = step @ h, half
    return h


@functools.cache
def permutation_table(n_bits: int = N_BITS, n_perms: int = N_PERMUTATIONS, length: int = PERMUTATION_LENGTH, seed: int = PERMUTATION_SEED) -> np.ndarray:
    """The first ``length`` places of ``n_perms`` Knuth shuffles, drawn by a Park-Miller generator that runs on."""
    out, state = np.zeros((n_perms, length), np.uint16), seed
    for row in out:
        p = list(range(n_bits))
        for i in range(n_bits - 2):
            state = state * 16807 % 2147483647
            j = i + state % (n_bits - i)
            p[i], p[j] = p[j], p[i]
        row[:] = p[:length]
    return out


@functools.cache
def rank_table(n_bits: int = N_BITS, n_perms: int = N_PERMUTATIONS, length: int = PERMUTATION_LENGTH) -> np.ndarray:
    """For each bit and permutation the bit's rank, or ``length`` if it is not among the first ones."""
    out = np.full((n_bits, n_perms), length, np.uint16)
    for k, row in enumerate(permutation_table(n_bits, n_perms, length)):
        out[row, k] = np.arange(length)
    return out
