"""Document fingerprints by Order MinHash, which follow the edit distance of texts.

The k-mers of a text's code points are numbered by their occurrence (the first, the second, ... of
the same k-mer), so that repeats count.  A hash of (k-mer, number) deals them to ``SLOTS`` slots and ranks them
there.  Of each slot the ``TUPLE`` smallest are taken, put back in text order, and hashed as a tuple: 16
bits of the signature.  Equal slots of two signatures, as a share, are the likeness: moving a passage changes the
order within tuples, and an edit changes the k-mers around it.  Each text is hashed once, not once a
slot, so that long texts stay cheap.

A slot without k-mers (short texts) borrows the next filled slot's tuple, marked by the distance.

Scale: the query needs each document's successor by id.  Ids are cut into ranges by quantiles; each range is
sorted in one task and read as a stream, and the first document of a range is dealt to the range
before it as well.  Each text crosses one shuffle; nothing is gathered on the driver but the range bounds.

Edge cases: a null text counts as empty; empty texts share one fingerprint (all zeros), equal to no other.
Texts shorter than a k-mer are one k-mer.  Rows with equal ids are ordered by text; null ids come first.  A single document is its own
successor.  An empty table gives no rows.  Further columns are not read.  Ids are whole numbers, which their order needs; others
are refused by the cast.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm.common import mix64, rows, table

K, SLOTS, TUPLE = 8, 64, 2
#: Low bits of a sort key that hold a k-mer's place; the rest names it.
PLACE_BITS = 24
PLACE, NAME = np.uint64((1 << PLACE_BITS) - 1), np.uint64(((1 << 64) - 1) ^ ((1 << PLACE_BITS) - 1))
P1, P2, P3, P4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
SLOT_SHIFT = np.uint64(64 - SLOTS.bit_length() + 1)
OFFSETS = np.arange(TUPLE)
EDGES = np.arange(SLOTS, dtype=np.uint64) << SLOT_SHIFT
ROWS_PER_RANGE, MAX_RANGES = 2000, 8192


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _in_order(names: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names (40 high bits) and places, by name and then place."""
    if len(names) <= int(PLACE):
        key = np.sort(names & NAME | places)
        return key & NAME, key & PLACE
    order = np.lexsort((places, names & NAME))
    return (names & NAME)[order], places[order]


def signature(cp: np.ndarray) -> np.ndarray:
    """``SLOTS`` values of 16 bits; all zero for an empty text."""
    n = len(cp)
    if not n:
        return np.zeros(SLOTS, np.uint16)
    h = cp.astype(np.uint64)
    if n < K:
        one = np.uint64(n)
        for c in h:
            one = mix64(np.array([one * P1 + c]))[0]
        h = np.array([one])
    else:
        h = h[:-1] * P1 + h[1:]
        h = h[:-2] * P2 + h[2:]
        h = mix64(h[:-4] * P3 + h[4:])
    places = np.arange(len(h), dtype=np.uint64)
    name, place = _in_order(h, places)
    first = np.empty(len(name), bool)
    first[0], first[1:] = True, name[1:] != name[:-1]
    index = np.arange(len(name))
    number = (index - np.maximum.accumulate(np.where(first, index, 0))).astype(np.uint64)
    name, place = _in_order(mix64(name + number * P4), place)
    start = np.searchsorted(name, EDGES)
    end = np.append(start[1:], len(name))
    at = start[:, None] + OFFSETS
    there = at < end[:, None]
    at = np.where(there, at, 0)
    chosen, where = np.where(there, name[at], 0).astype(np.uint64), np.where(there, place[at].astype(np.int64), 1 << 62)
    chosen = np.take_along_axis(chosen, np.argsort(where, axis=1, kind="stable"), 1)
    out = np.zeros(SLOTS, np.uint64)
    for j in range(TUPLE):
        out = mix64(out * P2 + chosen[:, j])
    full = np.flatnonzero(start < end)
    if len(full) < SLOTS:
        nearest = np.searchsorted(full, np.arange(SLOTS))
        source = full[nearest % len(full)]
        far = (source - np.arange(SLOTS)) % SLOTS
        out = np.where(far == 0, out[source], mix64(out[source] + far.astype(np.uint64) * P3))
    return (out % np.uint64(65535) + np.uint64(1)).astype(np.uint16)


def to_hex(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / SLOTS


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of each row's text: a narrow operator."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                got = [to_hex(signature(code_points(t or ""))) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], names=[id_col, "fingerprint"])

    df = docs.select(id_col, text_col)
    return df.mapInArrow(run, df.select(id_col).schema.add("fingerprint", "string"))


def dealt_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text with ``range`` and ``tail``: sorted by range, tail, id and text within each task.

    A row of ``tail`` 1 is the first document of the next range, there as the successor of this one's last.
    """
    low = -(1 << 63)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("__key"))
    n = keyed.count()
    ranges = min(MAX_RANGES, max(1, math.ceil(n / ROWS_PER_RANGE)))
    cuts: list[int] = []
    if ranges > 1:
        probs = ",".join(str(i / ranges) for i in range(1, ranges))
        cuts = sorted(set(keyed.agg(F.expr(f"percentile_approx(__key, array({probs}), {min(100_000, 20 * ranges)})")).first()[0]))
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(np.int64), side="right").astype(np.int32))

    firsts = sorted((r[0], r[1]) for r in keyed.groupBy(range_of("__key").alias("r")).agg(F.min("__key")).collect())
    #: the first key of each range that has rows, and the range before it (for the first one, the last)
    first_keys = np.array([k for _, k in firsts], np.int64)
    before = np.array([firsts[i - 1][0] for i in range(len(firsts))], np.int32)

    @F.pandas_udf("array<int>")
    def places(key: pd.Series) -> pd.Series:
        k = key.to_numpy(np.int64)
        own = np.searchsorted(bounds, k, side="right").astype(np.int32)
        at = np.minimum(np.searchsorted(first_keys, k), len(first_keys) - 1)
        leads = first_keys[at] == k
        return pd.Series([[o, before[i]] if x else [o] for o, i, x in zip(own, at, leads, strict=True)])

    spread = keyed.select("doc_id", "text", "__key", F.posexplode(places("__key")).alias("tail", "range"))
    return spread.repartition("range").sortWithinPartitions("range", "tail", "__key", "text").select("range", "tail", "doc_id", "text")


def compare_edited(dealt: DataFrame) -> DataFrame:
    """The query's columns from ``dealt_with_next``'s rows, each range read as a stream."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            held = None  # range, id, text, code points, signature of the last document
            for b in batches:
                out: list[list] = [[] for _ in names]
                for at, tail, doc_id, text in rows(b, "range", "tail", "doc_id", "text"):
                    if tail and (held is None or held[0] != at):
                        continue  # another document with the id of the first one
                    cp = code_points(text)
                    sig = signature(cp)
                    if held is not None and held[0] == at:
                        _, own_id, own_text, own_cp, own = held
                        cut = len(own_cp) // 4
                        edited_text = own_text[: len(own_text) - cut] + text[:cut]
                        edited = signature(np.concatenate((own_cp[: len(own_cp) - cut], cp[:cut]))) if cut else own
                        digest = hashlib.sha256(edited_text.encode("utf-8", "surrogatepass")).hexdigest()
                        for col, v in zip(out, (own_id, len(own_cp), digest, to_hex(own), to_hex(edited), likeness(own, edited), likeness(own, sig)), strict=True):
                            col.append(v)
                    held = None if tail else (at, doc_id, text, cp, sig)
                if out[0] or out[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=names)

    return dealt.mapInArrow(run, schema)


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(dealt_with_next(table(spark, sf_dir, "documents", "doc_id", "text")))
