"""What the operators of this subpackage share: tables, checkpoints, words and Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.session import shared_dir, written

__all__ = ["LOWER", "M64", "UPPER", "WORD_TABLE", "ascii_lower", "binomial_floor", "crc_mod", "cut", "mix64", "rows", "shared_dir", "spread", "table", "words"]

#: A to Z, the only letters that the contracts lower-case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes 0x00-0x2F, 0x3A-0x60 and 0x7B-0x7F part words; A to Z become a to z first.
WORD_TABLE = bytes(
    0x20 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 0x20 if 0x41 <= c <= 0x5A else c
    for c in range(256)
)
M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named table of ``sf_dir``, by Spark's reader, so that any store that Spark reads will do."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, from files in the shared folder: lineage ends, and a lost executor loses nothing."""
    return written(df)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def spread(c: Column, salt: str = "") -> Column:
    """An even, stable value from 0 up to 1 for each value of c; null counts as empty text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(c.cast("string"), F.lit(""))).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def words(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text."""
    return text.translate(WORD_TABLE).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a bijection of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def binomial_floor(n: int, p: float, miss: float) -> int:
    """The largest c with P(Binomial(n, p) < c) <= miss."""
    total, q = 0.0, 1.0 - p
    for c in range(n + 1):
        total += math.comb(n, c) * p**c * q ** (n - c)
        if total > miss:
            return c
    return n
