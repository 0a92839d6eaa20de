"""Audio files and samples to entries and signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echofold.functions import constants as C
from echofold.functions import kernels
from echofold.sources import wav

FILE_SCHEMA = "path string, status string, artist string, track_title string, album_title string, image_idx int, minhash binary"


def fingerprint_bytes(content: bytes, use_ffmpeg: bool = True) -> tuple[str | None, dict, list[tuple[int, bytes]]]:
    """(status, tags, (image, signature) pairs) of one file."""
    tags: dict = {}
    try:
        try:
            wave = wav.parse_wave(content)
            tags = {k: getattr(wave, k) for k in wav.TAGS.values()}
        except wav.WaveError as e:
            other = wav.transcode(content) if use_ffmpeg and e.args[0] in (wav.NOT_WAVE, wav.UNSUPPORTED) else None
            if other is None:
                raise
            content, tags = other
            wave = wav.parse_wave(content)
    except wav.WaveError as e:
        return e.args[0], tags, []
    mono = kernels.pcm_to_mono(content[wave.data_pos : wave.data_pos + wave.data_size], wave.channels)
    if len(mono) // C.DECIMATION < C.MIN_SAMPLES:
        return wav.TOO_SMALL, tags, []
    return None, tags, kernels.signatures(kernels.from_44100(mono))


def fingerprint_table(files: DataFrame, use_ffmpeg: bool = True) -> DataFrame:
    """A row for each signature of (path, content), or one with a status and no signature.

    One narrow pass: normalising takes a whole file and images overlap, so a file is one unit of work.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FILE_SCHEMA.split(", ")]
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                status, tags, found = fingerprint_bytes(bytes(content), use_ffmpeg)
                head = (path, status, tags.get("artist"), tags.get("track_title"), tags.get("album_title"))
                yield pd.DataFrame([(*head, i, s) for i, s in found] or [(*head, None, None)], columns=names)

    return files.mapInPandas(run, FILE_SCHEMA)


def to_index(table: DataFrame, keep_failed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entries, signatures) of ``fingerprint_table``'s rows.  Entry ids follow the order of paths."""
    per_file = table.groupBy("path").agg(*(F.first(c).alias(c) for c in ("status", "artist", "track_title", "album_title")), F.count("minhash").cast("int").alias("n_signatures"))
    if not keep_failed:
        per_file = per_file.filter("status is null")
    # one row a file is numbered over all files
    entries = per_file.withColumn("entry_id", (F.row_number().over(Window.orderBy("path")) - 1).cast("int")).withColumnRenamed("path", "filename")
    at = F.row_number().over(Window.partitionBy("entry_id").orderBy("image_idx")) - 1
    own = table.filter("minhash is not null").join(entries.select(F.col("filename").alias("path"), "entry_id"), "path")
    signatures = own.select("entry_id", at.cast("int").alias("sig_idx"), "image_idx", "minhash")
    return entries.select("entry_id", "filename", "artist", "track_title", "album_title", "n_signatures", "status"), signatures


def fingerprint_files(spark: SparkSession, path: str, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    files = wav.binary_files(spark, path)
    return to_index(fingerprint_table(files.repartition(partitions, "path") if partitions else files))


def fingerprint_samples(series: DataFrame) -> DataFrame:
    """(series_id, sig_idx, image_idx, minhash) of (series_id, samples): decimated and normalised samples as arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, x in zip(b["series_id"], b["samples"], strict=True):
                found = kernels.signatures(np.asarray(x, np.float32))
                yield pd.DataFrame([(str(i), k, image, s) for k, (image, s) in enumerate(found)], columns=["series_id", "sig_idx", "image_idx", "minhash"])

    return series.select("series_id", "samples").mapInPandas(run, "series_id string, sig_idx int, image_idx int, minhash binary")


def spectral_images(series: DataFrame) -> DataFrame:
    """(series_id, image_idx, image) of (series_id, samples): decimated and normalised samples to images of 128 frames of 32 bins, frame by frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, x in zip(b["series_id"], b["samples"], strict=True):
                found = kernels.images(kernels.frame_bins(np.asarray([] if x is None else x, np.float32)))
                for at in range(0, len(found), 64):
                    part = found[at : at + 64]
                    yield pd.DataFrame({"series_id": str(i), "image_idx": np.arange(at, at + len(part)), "image": list(part.reshape(len(part), -1))})

    return series.select("series_id", "samples").mapInPandas(run, "series_id string, image_idx int, image array<float>")


def raw_fingerprints(images: DataFrame) -> DataFrame:
    """(series_id, image_idx, bits, is_silence) of ``spectral_images``: the set bits of an image's largest wavelets, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 64):
                part = b.iloc[at : at + 64]
                x = np.stack([np.asarray(v, np.float32) for v in part["image"]]).reshape(-1, C.IMAGE_WIDTH, C.N_BINS)
                bits, silent = kernels.top_bits(kernels.haar_2d(x))
                yield pd.DataFrame({"series_id": part["series_id"].to_numpy(), "image_idx": part["image_idx"].to_numpy(), "bits": [np.sort(v).astype(np.int32) for v in bits], "is_silence": silent})

    return images.select("series_id", "image_idx", "image").mapInPandas(run, "series_id string, image_idx int, bits array<int>, is_silence boolean")


def as_queries(signatures: DataFrame, id_col: str = "series_id") -> DataFrame:
    return signatures.select(F.col(id_col).alias("query_id"), F.col("sig_idx").alias("query_sig"), "minhash")
