"""Signal operators over long form: a row (series_id, idx, value) for each sample.

Each is a composition of DataFrame operations, so that it shards by series and, where it only sums, combines before the
shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echofold.functions import columns as X
from echofold.functions import constants as C


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table of constants, for joins that broadcast it: its size is fixed by parameters, not by data."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def series_of(df: DataFrame, series: str, order: Sequence[str], value: str) -> DataFrame:
    """(series_id, idx, value): rows of a table numbered inside each series."""
    w = Window.partitionBy(series).orderBy(*order)
    return df.select(F.col(series).alias("series_id"), (F.row_number().over(w) - 1).cast("long").alias("idx"), F.col(value).cast("double").alias("value"))


def series_of_arrays(df: DataFrame, series: str, array: str) -> DataFrame:
    """(series_id, idx, value) of a column of arrays."""
    return df.select(F.col(series).alias("series_id"), F.posexplode(array).alias("idx", "value")).select("series_id", F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value"))


def rms_normalize(samples: DataFrame) -> DataFrame:
    """(series_id, idx, y): values over their clamped root mean square, clamped to [-1, 1]."""
    power = samples.groupBy("series_id").agg(F.avg(F.col("value") * F.col("value")).alias("ms"))
    r = F.greatest(F.lit(C.RMS_LOW), F.least(F.lit(C.RMS_HIGH), C.RMS_GAIN * F.sqrt("ms")))
    return samples.join(power, "series_id").select("series_id", "idx", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") / r)).alias("y"))


def fir_decimate(samples: DataFrame, taps: Sequence[float] | None = None, step: int = C.DECIMATION) -> DataFrame:
    """(series_id, idx, y): the forward filter at every ``step``-th sample, as many outputs as whole steps.

    Each sample is sent to the few outputs that it reaches, and sums combine before the shuffle.
    """
    h = list(C.fir_taps() if taps is None else taps)
    weights = F.array(*(F.lit(float(x)) for x in h))
    lengths = samples.groupBy("series_id").agg(F.floor((F.max("idx") + 1) / step).alias("n"))
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - (len(h) - 1)) / step)).cast("long")
    reached = samples.select("series_id", "value", "idx", F.explode(F.sequence(first, F.floor(F.col("idx") / step).cast("long"))).alias("out"))
    summed = reached.groupBy("series_id", "out").agg(F.sum(F.col("value") * F.element_at(weights, (F.col("idx") - F.col("out") * step + 1).cast("int"))).alias("y"))
    return summed.join(lengths, "series_id").filter(F.col("out") < F.col("n")).select("series_id", F.col("out").alias("idx"), "y")


def hann_window(samples: DataFrame, n: int) -> DataFrame:
    return samples.select("series_id", "idx", (F.col("value") * 0.5 * (1 - F.cos(2 * math.pi * F.col("idx") / (n - 1)))).alias("y"))


def frame_counts(samples: DataFrame, length: int, hop: int, width: int, image_hop: int) -> DataFrame:
    """(series_id, n_samples, n_frames, n_images, status) with the status of series that are too short."""
    n = samples.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_samples"))
    frames = F.when(F.col("n_samples") >= length, 1 + F.floor((F.col("n_samples") - length) / hop)).otherwise(0)
    images = F.when(F.col("n_frames") >= width, 1 + F.floor((F.col("n_frames") - width) / image_hop)).otherwise(0)
    out = n.withColumn("n_frames", frames.cast("long")).withColumn("n_images", images.cast("long"))
    return out.withColumn("status", F.when(F.col("n_images") == 0, "FILE_TOO_SMALL"))


def slices(samples: DataFrame, length: int, hop: int) -> DataFrame:
    """(series_id, slice_no, offset, value): overlapping slices, a partial one at the end left out."""
    n = samples.groupBy("series_id").agg((F.max("idx") + 1).alias("n"))
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - (length - 1)) / hop)).cast("long")
    last = F.least(F.floor(F.col("idx") / hop), F.floor((F.col("n") - length) / hop)).cast("long")
    near = samples.join(n, "series_id").filter(F.col("n") >= length).withColumns({"a": first, "b": last}).filter("a <= b")
    return near.select("series_id", "idx", "value", F.explode(F.sequence("a", "b")).alias("slice_no")).select("series_id", "slice_no", (F.col("idx") - F.col("slice_no") * hop).alias("offset"), "value")


def dft_power(samples: DataFrame, n: int) -> DataFrame:
    """(series_id, k, power) for k from 0 to n / 2, by a join with the twiddle table."""
    spark = samples.sparkSession
    table = literal_table(spark, [(i, k, math.cos(2 * math.pi * i * k / n), -math.sin(2 * math.pi * i * k / n)) for i in range(n) for k in range(n // 2 + 1)], "idx long, k int, c double, s double")
    sums = samples.join(table, "idx").groupBy("series_id", "k").agg(F.sum(F.col("value") * F.col("c")).alias("re"), F.sum(F.col("value") * F.col("s")).alias("im"))
    return sums.select("series_id", "k", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def log_bins(power: DataFrame, edges: Sequence[int]) -> DataFrame:
    """(series_id, bin, mean_power): the mean over the half-open range between two edges."""
    index = literal_table(power.sparkSession, [(k, b) for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)) for k in range(lo, hi)], "k int, bin int")
    return power.join(index, "k").groupBy("series_id", "bin").agg(F.avg("power").alias("mean_power"))


def log_bin_edges(spark: SparkSession, n_bins: int = C.N_BINS, low: float = C.LOW_HZ, high: float = C.HIGH_HZ) -> DataFrame:
    hz = F.pow(F.lit(2.0), math.log2(low) + F.col("id") * ((math.log2(high) - math.log2(low)) / n_bins))
    return spark.range(n_bins + 1).select(F.col("id").cast("int").alias("edge"), X.frequency_to_index(hz).alias("place"))


def image_scale(cells: DataFrame) -> DataFrame:
    """(series_id, idx, scaled): an image's values against its own maximum."""
    top = cells.groupBy("series_id").agg(F.max("value").alias("top"))
    return cells.join(top, "series_id").select("series_id", "idx", X.scale_to_unit(F.col("value"), F.col("top")).alias("scaled"))


def linear(samples: DataFrame, matrix: np.ndarray) -> DataFrame:
    """(series_id, idx, coeff): a fixed matrix applied to every series, by a join with its non-zero cells."""
    cells = [(int(i), int(o), float(matrix[o, i])) for o, i in zip(*np.nonzero(matrix), strict=True)]
    table = literal_table(samples.sparkSession, cells, "idx long, out int, w double")
    return samples.join(table, "idx").groupBy("series_id", "out").agg(F.sum(F.col("value") * F.col("w")).alias("coeff")).select("series_id", F.col("out").alias("idx"), "coeff")


def haar_1d(samples: DataFrame, n: int) -> DataFrame:
    return linear(samples, C.haar_matrix(n))


def haar_2d(samples: DataFrame, width: int, height: int) -> DataFrame:
    """Cells in the order frame * height + bin."""
    return linear(samples, np.kron(C.haar_matrix(width), C.haar_matrix(height)))


def top_wavelets(coefficients: DataFrame, top: int, digits: int = 9) -> DataFrame:
    """(series_id, idx, coeff, rank): the largest by absolute value; ties go to the lower place."""
    rounded = coefficients.withColumn("coeff", F.round("coeff", digits))
    w = Window.partitionBy("series_id").orderBy(F.abs("coeff").desc(), "idx")
    return rounded.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("series_id", "idx", "coeff", "rank")


def sign_bits(top: DataFrame, dead_zone: float = C.DEAD_ZONE) -> DataFrame:
    """(series_id, bit): 2 idx for positive and 2 idx + 1 for negative coefficients outside the dead zone."""
    return top.select("series_id", X.tri_state(F.col("idx"), F.col("coeff"), dead_zone).alias("bit")).filter("bit is not null")


def silence(top: DataFrame, loud: float = C.LOUD, least: int = C.MIN_LOUD) -> DataFrame:
    """(series_id, n_loud, is_silence)."""
    n = top.groupBy("series_id").agg(F.count_if(F.abs("coeff") > loud).alias("n_loud"))
    return n.withColumn("is_silence", F.col("n_loud") < least)

