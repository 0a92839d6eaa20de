"""Dense signal processing with numpy: samples to signatures.  Each function takes and gives arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from echofold.functions import constants as C

try:
    from _md5 import md5  # half the time of hashlib's for short messages
except ImportError:
    from hashlib import md5


def pcm_to_mono(pcm: bytes, channels: int = 2, signed: bool = True) -> np.ndarray:
    """Little-endian 16-bit interleaved PCM to the mean over channels; ``signed=False`` reads the samples as unsigned."""
    block = 2 * channels
    x = np.frombuffer(pcm[: len(pcm) // block * block], "<i2" if signed else "<u2").reshape(-1, channels)
    return (x.astype(np.float64).sum(1) / channels / 32767.0).astype(np.float32)


def decimate(x: np.ndarray) -> np.ndarray:
    """Forward low-pass filter at every eighth sample; what lies past the end counts as nothing."""
    n = len(x) // C.DECIMATION
    padded = np.concatenate((x, np.zeros(C.FIR_TAPS, x.dtype)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, C.FIR_TAPS)[: n * C.DECIMATION : C.DECIMATION]
    return (windows @ C.fir_taps()).astype(np.float32)


def rms_normalize(x: np.ndarray) -> np.ndarray:
    if not len(x):
        return x
    r = min(max(float(np.sqrt(np.mean(np.square(x, dtype=np.float64)))) * C.RMS_GAIN, C.RMS_LOW), C.RMS_HIGH)
    return np.clip(x / r, -1, 1).astype(np.float32)


def frame_bins(x: np.ndarray, block: int = 2048) -> np.ndarray:
    """Mean power of each logarithmic bin, for each frame."""
    n, edges = C.n_frames(len(x)), np.array(C.bin_edges())
    frames = np.lib.stride_tricks.sliding_window_view(x, C.FRAME_LENGTH)[:: C.FRAME_HOP][:n] if n else np.zeros((0, C.FRAME_LENGTH))
    out = np.zeros((n, C.N_BINS), np.float32)
    for i in range(0, n, block):
        f = np.fft.rfft(frames[i : i + block] * C.hann(), axis=1) / 1024
        power = np.square(f.real) + np.square(f.imag)
        out[i : i + block] = np.add.reduceat(power[:, : edges[-1]], edges[:-1], axis=1) / np.diff(edges)
    return out


def images(bins: np.ndarray) -> np.ndarray:
    """Scaled images of ``IMAGE_WIDTH`` frames; an image without power is all zero."""
    if len(bins) < C.IMAGE_WIDTH:
        return np.zeros((0, C.IMAGE_WIDTH, C.N_BINS), np.float32)
    x = np.lib.stride_tricks.sliding_window_view(bins, C.IMAGE_WIDTH, axis=0)[:: C.IMAGE_HOP].transpose(0, 2, 1)
    top = x.max(axis=(1, 2), keepdims=True)
    share = np.divide(255 * x, top, out=np.zeros_like(x), where=top > 0)
    return (np.log1p(np.minimum(255, share)) / np.log(256)).astype(np.float32)


def haar_2d(x: np.ndarray) -> np.ndarray:
    """Standard decomposition: along time, then along frequency."""
    return C.haar_matrix(x.shape[1]) @ x @ C.haar_matrix(x.shape[2]).T


def top_bits(coefficients: np.ndarray, top: int = C.TOP_WAVELETS) -> tuple[list[np.ndarray], np.ndarray]:
    """Bits of the largest coefficients of each image (2 i for positive, 2 i + 1 for negative), and which images are silent."""
    flat = coefficients.reshape(len(coefficients), -1)
    order = np.argsort(-np.abs(flat), axis=1, kind="stable")[:, :top]
    value = np.take_along_axis(flat, order, 1)
    silent = (np.abs(value) > C.LOUD).sum(1) < C.MIN_LOUD
    bits = [np.concatenate((2 * i[v > C.DEAD_ZONE], 2 * i[v < -C.DEAD_ZONE] + 1)) for i, v in zip(order, value, strict=True)]
    return bits, silent


def minhash(bits: np.ndarray, n_bits: int = C.N_BITS) -> np.ndarray:
    """A byte for each permutation: the rank of its first bit that is set, 255 if there is none among the first ones."""
    ranks = C.rank_table(n_bits)
    return (ranks[bits].min(0) if len(bits) else np.full(ranks.shape[1], C.NO_BIT)).astype(np.uint8)


def byte_rows(signatures: list[bytes], n: int) -> np.ndarray:
    return np.frombuffer(b"".join(s[:n] for s in signatures), np.uint8).reshape(len(signatures), n)


def key_rows(hashes: np.ndarray, n_bands: int = C.N_BANDS, width: int = C.BAND_BYTES) -> np.ndarray:
    """The big-endian number of each band of each row of bytes."""
    return hashes[:, : n_bands * width].reshape(-1, n_bands, width) @ 256 ** np.arange(width - 1, -1, -1, dtype=np.int64)


def band_keys(signatures: list[bytes | None], n_bands: int = C.N_BANDS, width: int = C.BAND_BYTES) -> pa.Array:
    """A list of the keys of whole bands of each signature; null for null."""
    kind, n = pa.list_(pa.int64()), n_bands * width
    if signatures and all(s is not None and len(s) >= n for s in signatures):
        keys = key_rows(byte_rows(signatures, n), n_bands, width)
        return pa.ListArray.from_arrays(np.arange(len(signatures) + 1, dtype=np.int32) * n_bands, keys.ravel()).cast(kind)
    return pa.array([None if s is None else [int.from_bytes(s[width * b : width * (b + 1)]) for b in range(min(n_bands, len(s) // width))] for s in signatures], kind)


class BandProbe:
    """Signatures as rows of bytes, found by their bands' keys (modulo ``buckets``, if given).  Takes 400 bytes a signature."""

    SLOT_BITS, PAIRS = 16, 1 << 17

    def __init__(self, hashes: np.ndarray, buckets: int | None = None):
        self.hashes, self.buckets = hashes, buckets
        self.keys = self._keys(hashes)
        self.order = np.empty((C.N_BANDS, len(hashes)), np.int32)
        self.sorted = np.empty((C.N_BANDS, len(hashes)), np.uint32)
        for band in range(C.N_BANDS):
            self.order[band] = np.argsort(self.keys[:, band], kind="stable")
            self.sorted[band] = self.keys[self.order[band], band]
        self.known = np.zeros((C.N_BANDS, 1 << self.SLOT_BITS), bool)
        self.known[np.arange(C.N_BANDS), self._slot(self.keys)] = True

    def _keys(self, hashes: np.ndarray) -> np.ndarray:
        keys = key_rows(hashes).astype(np.uint32)
        return keys if self.buckets is None else (keys % self.buckets).astype(np.uint32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SLOT_BITS)

    def pairs(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(row of ``hashes``, own row, equal bands, equal bytes) of all pairs with an equal band, some at a time, each pair once."""
        keys = self._keys(hashes)
        maybe = self.known[np.arange(C.N_BANDS), self._slot(keys)]
        for band in np.flatnonzero(maybe.any(0)):
            rows = np.flatnonzero(maybe[:, band])
            low, high = (np.searchsorted(self.sorted[band], keys[rows, band], side) for side in ("left", "right"))
            rows, low, n = rows[high > low], low[high > low], (high - low)[high > low]
            ends = np.cumsum(n)
            for start in range(0, int(ends[-1]) if len(ends) else 0, self.PAIRS):
                i = np.arange(start, min(start + self.PAIRS, int(ends[-1])))
                at = np.searchsorted(ends, i, "right")
                row, own = rows[at], self.order[band, low[at] + i - (ends[at] - n[at])]
                same = keys[row] == self.keys[own]
                first = same.argmax(1) == band
                row, own = row[first], own[first]
                yield row, own, same[first].sum(1), (hashes[row] == self.hashes[own]).sum(1)


def grouped_pairs(hashes: np.ndarray, bands: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_bands: int, min_score: int, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, other row, equal bands, equal bytes) of the pairs that have enough of both, some at a time: each row with the rows from
    ``starts`` to ``ends``, which share its band ``bands``.  A pair that shares an earlier band is left out, as it is made there.
    """
    n = np.maximum(ends - starts, 0)
    own = hashes.view(np.uint32)
    empty = (own == 0xFFFFFFFF) @ (1 << np.arange(C.N_BANDS, dtype=np.int64))  # bands without a bit, which most pairs of short texts share
    before = (np.int64(1) << bands) - 1
    sums = np.concatenate(([0], np.cumsum(n)))
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(sums, sums[at] + most, "right")) - 1)
        row = np.repeat(np.arange(at, to), n[at:to])
        other = np.arange(sums[at], sums[to]) + (starts - sums[:-1])[row]
        at = to
        new = empty[row] & empty[other] & before[row] == 0
        row, other = row[new], other[new]
        new = (own[row, 0] != own[other, 0]) | (bands[row] == 0)  # copies share the first band
        row, other = row[new], other[new]
        if not len(row):
            continue
        same = hashes[row] == hashes[other]
        whole = same.view(np.uint32) == 0x01010101
        n_bands = whole.sum(1)
        good = np.flatnonzero((whole.argmax(1) == bands[row]) & (n_bands >= min_bands))
        score = same[good].view(np.uint32).sum(1, dtype=np.uint32).view(np.uint8).reshape(-1, 4).sum(1)  # four sums of up to 25 at once
        good, score = good[score >= min_score], score[score >= min_score]
        yield row[good], other[good], n_bands[good], score


def shingle_bits(text: str | None, n_bits: int, n_words: int = 3) -> np.ndarray:
    """The bit of each run of ``n_words`` words, in order; words are parted by ASCII white space, in lower case."""
    w = (text or "").lower().encode("utf-8", "surrogatepass").split()
    heads = [md5(b" ".join(s)).digest()[:4] for s in zip(*(w[k:] for k in range(n_words)), strict=False)]
    return np.frombuffer(b"".join(heads), ">u4").astype(np.int64) % n_bits


def signatures(samples: np.ndarray) -> list[tuple[int, bytes]]:
    """(image number, signature) of decimated and normalised samples; silent images and empty signatures are left out."""
    x = images(frame_bins(samples))
    out = []
    for i in range(0, len(x), 256):
        bits, silent = top_bits(haar_2d(x[i : i + 256]))
        for k, (b, quiet) in enumerate(zip(bits, silent, strict=True)):
            s = minhash(b)
            if not quiet and (s != C.NO_BIT).any():
                out.append((i + k, s.tobytes()))
    return out


def from_44100(x: np.ndarray) -> np.ndarray:
    return rms_normalize(decimate(x))


def stream_windows(sizes: list[int], rate: int = 4 * C.SAMPLE_RATE, low: int = C.STREAM_MIN_SECONDS, high: int = C.STREAM_MAX_SECONDS) -> list[tuple[int, int]]:
    """(start, end) byte ranges that a stream of chunks of these sizes emits.

    Chunks are appended to a buffer; beyond ``high`` seconds the oldest second goes; on crossing a whole second with at least ``low``
    seconds held, all that is held is emitted.
    """
    start = end = 0
    out = []
    for n in sizes:
        before = (end - start) // rate
        end += n
        now = (end - start) // rate
        if end - start > high * rate:
            start += rate
        if now != before and now >= low:
            out.append((start, end))
    return out
