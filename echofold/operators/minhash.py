"""MinHash signatures and band keys of sets of bits, and of windows over texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofold.functions import columns as X
from echofold.functions import constants as C
from echofold.functions import kernels
from echofold.operators.signal import literal_table


def permutation_rows(n_bits: int, n_perms: int, length: int) -> list[tuple[int, int, int]]:
    """(perm, rank, bit)."""
    return [(p, r, int(b)) for p, row in enumerate(C.permutation_table(n_bits, n_perms, length)) for r, b in enumerate(row)]


def signatures_of_bits(bits: DataFrame, n_bits: int, n_perms: int, length: int) -> DataFrame:
    """(series_id, minhash) of (series_id, bit): for each permutation the rank of its first set bit, ``length`` if none.

    Series without any ranked bit have no signature.
    """
    perms = literal_table(bits.sparkSession, permutation_rows(n_bits, n_perms, length), "perm int, rank int, bit int")
    least = bits.join(perms, "bit").groupBy("series_id", "perm").agg(F.min("rank").alias("rank"))
    held = least.groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("perm", "rank"))).alias("m"))
    ranks = F.transform(F.sequence(F.lit(0), F.lit(n_perms - 1)), lambda p: F.coalesce(F.element_at("m", p), F.lit(length)))
    return held.select("series_id", F.unhex(F.array_join(F.transform(ranks, lambda r: F.lpad(F.hex(r), 2, "0")), "")).alias("minhash"))


def band_table(signatures: DataFrame, n_bands: int = C.N_BANDS, width: int = C.BAND_BYTES) -> DataFrame:
    """(band_no, band_key) with the columns of ``signatures`` (which has minhash)."""
    return signatures.select("*", F.posexplode(X.band_keys(F.col("minhash"), n_bands, width)).alias("band_no", "band_key"))


def shingle_bits(docs: DataFrame, id_col: str, text_col: str, n_bits: int, n_words: int = 3) -> DataFrame:
    """(series_id, bit): distinct bits of a text's word shingles; words are parted by white space, in lower case."""
    words = F.filter(F.split(F.lower(text_col), r"\s+"), lambda w: w != "")
    spans = F.when(F.size("w") >= n_words, F.transform(F.sequence(F.lit(1), F.size("w") - n_words + 1), lambda i: F.array_join(F.slice("w", i, n_words), " ")))
    shingles = docs.select(F.col(id_col).alias("series_id"), words.alias("w")).select("series_id", F.explode(spans).alias("s"))
    bit = (F.conv(F.substring(F.md5(F.col("s").cast("binary")), 1, 8), 16, 10).cast("long") % n_bits).cast("int")
    return shingles.select("series_id", bit.alias("bit")).distinct()


def text_signatures(docs: DataFrame, id_col: str, text_col: str, n_bits: int, n_perms: int, length: int, n_words: int = 3) -> DataFrame:
    """(series_id, minhash): ``signatures_of_bits`` of ``shingle_bits``, in one narrow pass without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(C.rank_table(n_bits, n_perms, length).astype(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = held.value
        for b in batches:
            ids, out = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bits = np.unique(kernels.shingle_bits(text, n_bits, n_words))
                if len(bits) and (s := ranks[bits].min(0)).min() < length:
                    ids.append(i)
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(out, pa.binary())], names=["series_id", "minhash"])

    df = spread_small(docs.select(F.col(id_col).alias("series_id"), text_col))
    return df.mapInArrow(run, T.StructType([df.schema["series_id"], T.StructField("minhash", T.BinaryType())]))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` rows in a row, by doubling."""
    have = 1
    while 2 * have <= width:
        x, have = np.minimum(x[: len(x) - have], x[have:]), 2 * have
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def spread_small(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than there are cores, dealt to all of them; larger ones as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def window_signatures(docs: DataFrame, id_col: str, text_col: str, n_bits: int = 512, n_words: int = 3, width: int = 16, hop: int = 2) -> DataFrame:
    """(entry_id, sig_idx, window_no, minhash): a signature for each window over a text's shingles.

    Shingles are set as bits of a universe of ``n_bits``; windows hold ``width`` of them, ``hop`` apart.  A narrow pass
    with a numpy kernel: a window's signature is the least rank over its shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = C.rank_table(n_bits).astype(np.uint8)
        for b in batches:
            out: list[list] = [[], [], [], []]
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bits = kernels.shingle_bits(text, n_bits, n_words)
                if len(bits) < width:
                    continue
                x = sliding_min(ranks[bits], width)[::hop]
                kept = np.flatnonzero((x != C.NO_BIT).any(1))
                out[0] += [i] * len(kept)
                out[1] += range(len(kept))
                out[2] += kept.tolist()
                out[3] += [row.tobytes() for row in x[kept]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["entry_id", "sig_idx", "window_no", "minhash"])

    return spread_small(docs.select(F.col(id_col).cast("long"), text_col)).mapInArrow(run, "entry_id long, sig_idx int, window_no int, minhash binary")
