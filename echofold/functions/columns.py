"""Column functions over signatures and spectra."""

from __future__ import annotations

import math
import operator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofold.functions import constants as C
from echofold.functions import kernels


def scale_to_unit(value: Column, top: Column) -> Column:
    """ln(1 + min(255, 255 v / max)) / ln 256; 0 where the maximum is 0."""
    share = F.when(top > 0, F.least(F.lit(255.0), 255.0 * value / F.when(top > 0, top))).otherwise(F.lit(0.0))
    return F.log1p(share) / math.log(256)


def bytes_of(signature: Column) -> Column:
    """A binary signature as an array of numbers."""
    text = F.hex(signature)
    return F.transform(F.sequence(F.lit(0), F.octet_length(signature) - 1), lambda i: F.conv(F.substring(text, 2 * i + 1, 2), 16, 10).cast("int"))


def band_keys(signature: Column, n_bands: int = C.N_BANDS, width: int = C.BAND_BYTES) -> Column:
    """An array of the bands' keys: ``width`` bytes each, big-endian, as unsigned numbers.  Null without a signature; a band that
    isn't whole has no key."""

    def keys(signatures: pa.Array) -> pa.Array:
        return kernels.band_keys(signatures.to_pylist(), n_bands, width)

    return F.arrow_udf(keys, T.ArrayType(T.LongType()))(signature)


def equal_bytes(a: Column, b: Column, n: int = C.N_PERMUTATIONS) -> Column:
    """How many of the first ``n`` bytes of two signatures are equal; an empty byte equals an empty byte."""
    parts = [(F.substring(a, i + 1, 1) == F.substring(b, i + 1, 1)).cast("int") for i in range(n)]
    while len(parts) > 1:
        parts = [reduce(operator.add, parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0]


def average_score(total: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(total, n), F.lit(0.0))


def frequency_to_index(hz: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(1024), F.floor(1024 * hz / C.NYQUIST_HZ + 0.5))).cast("int")


def tri_state(idx: Column, coefficient: Column, dead_zone: float = C.DEAD_ZONE) -> Column:
    """The bit of a coefficient, or null inside the dead zone."""
    return F.when(coefficient > dead_zone, 2 * idx).when(coefficient < -dead_zone, 2 * idx + 1)
