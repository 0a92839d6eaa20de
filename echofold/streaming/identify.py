"""Continuous identification of PCM streams, and the batch replay of the same window schedule."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from echofold.functions import constants as C
from echofold.functions import kernels
from echofold.operators import search as S
from echofold.session import open_fs, shared_dir, written

RATE = 4 * C.SAMPLE_RATE
WINDOWS = "stream_id string, window_no long, start_byte long, n_bytes long, signatures array<binary>"
OUTPUT = "stream_id string, window_no long, start_byte long, n_bytes long, entry_id int, average double, n_matches long, is_new boolean"


class LocalIndex:
    """An index in memory, for searches inside a processor: the same rules as ``operators.search``."""

    def __init__(self, entry_ids: np.ndarray, hashes: np.ndarray):
        self.entry_ids, self.probe = entry_ids, kernels.BandProbe(hashes)

    def search(self, queries: list[bytes]) -> tuple[int, float, int] | None:
        total: dict[int, list[int]] = {}
        own = kernels.byte_rows(queries, C.N_PERMUTATIONS)
        for _, at, n_bands, score in self.probe.pairs(own):
            good = (n_bands >= C.MIN_BANDS) & (score >= C.MIN_SCORE)
            ids, back = np.unique(self.entry_ids[at[good]], return_inverse=True)
            for e, s, n in zip(ids.tolist(), np.bincount(back, score[good], len(ids)).tolist(), np.bincount(back, minlength=len(ids)).tolist(), strict=True):
                t = total.setdefault(e, [0, 0])
                t[0] += s
                t[1] += n
        scored = {e: (s / n, n) for e, (s, n) in total.items()}

        def beats(a: tuple[float, int], b: tuple[float, int]) -> bool:
            delta = int(abs(a[0] - b[0]))
            if delta <= 3 and abs(a[1] - b[1]) >= 5 or delta < 1 and a[1] != b[1]:
                return a[1] > b[1]
            return a[0] > b[0]

        order = sorted(scored, key=lambda e: (sum(beats(scored[o], scored[e]) for o in scored if o != e), -scored[e][0], -scored[e][1], e))
        best = None
        for e in order[: C.TOP_ENTRIES]:
            avg, n = scored[e]
            if (n >= C.MIN_MATCHES or avg >= C.GOOD_SCORE and n >= C.MIN_MATCHES // 2) and avg >= C.MIN_AVERAGE and (best is None or avg > best[1]):
                best = (e, avg, n)
        return best


    def store(self, spark: SparkSession) -> str:
        """A file in the shared folder that ``loaded`` reads: Spark doesn't ship large objects to streaming processors."""
        at = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}.arrow"
        hashes = self.probe.hashes
        rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(C.N_PERMUTATIONS), len(hashes), [None, pa.py_buffer(np.ascontiguousarray(hashes))])
        fs, path = open_fs(at)
        table = pa.table({"entry_id": pa.array(self.entry_ids, pa.int64()), "minhash": rows})
        with fs.open_output_stream(path) as out, pa.ipc.new_file(out, table.schema) as f:
            f.write_table(table)
        return at


#: The index that a worker holds, by its file: read once for all its tasks.
_HELD: dict[str, LocalIndex] = {}


def loaded(at: str) -> LocalIndex:
    if at not in _HELD:
        fs, path = open_fs(at)
        with fs.open_input_file(path) as f:
            table = pa.ipc.open_file(f).read_all()
        _HELD.clear()
        _HELD[at] = LocalIndex(table["entry_id"].to_numpy(), kernels.byte_rows(table["minhash"].to_pylist(), C.N_PERMUTATIONS))
    return _HELD[at]


class Windows(StatefulProcessor):
    """Keeps each stream's last seconds of PCM and emits its windows with their signatures."""

    columns = {"signatures": "object"}

    def __init__(self, signed: bool = True):
        self.signed = signed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stream", "pcm binary, start long, windows long, last int, hit boolean")

    def found(self, signatures: list[bytes], last: int) -> tuple[tuple, int, bool]:
        """A window's own columns, the stream's last match, and whether the buffer is to be cleared with the next chunk."""
        return (signatures,), last, False

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pcm, start, windows, last, hit = self.state.get() if self.state.exists() else (b"", 0, 0, -1, False)
        pcm, out = bytearray(pcm), []
        chunks = pd.concat(list(rows))
        for chunk in chunks.sort_values("seq")["pcm"]:
            if hit:
                start, pcm, hit = start + len(pcm), bytearray(), False
            before = len(pcm) // RATE
            pcm += chunk
            now = len(pcm) // RATE
            if len(pcm) > C.STREAM_MAX_SECONDS * RATE:
                del pcm[:RATE]
                start += RATE
            if now != before and now >= C.STREAM_MIN_SECONDS:
                samples = kernels.from_44100(kernels.pcm_to_mono(bytes(pcm), 2, self.signed))
                own, last, hit = self.found([s for _, s in kernels.signatures(samples)], last)
                out.append((key[0], windows, start, len(pcm), *own))
                windows += 1
        self.state.update((bytes(pcm), start, windows, last, hit))
        kinds = {"window_no": "int64", "start_byte": "int64", "n_bytes": "int64", **self.columns}
        yield pd.DataFrame(out, columns=["stream_id", *kinds]).astype(kinds)

    def close(self) -> None:
        pass


class Identify(Windows):
    """Searches each window in the index of file ``at``.  On a new match the buffer is cleared with the next chunk, if ``feedback``."""

    columns = {"entry_id": "Int32", "average": "float64", "n_matches": "Int64", "is_new": "bool"}

    def __init__(self, at: str, feedback: bool = True, signed: bool = True):
        super().__init__(signed)
        self.at, self.feedback = at, feedback

    def found(self, signatures: list[bytes], last: int) -> tuple[tuple, int, bool]:
        best = loaded(self.at).search(signatures)
        if best is None:
            return (None, None, None, False), last, False
        return (*best, best[0] != last), best[0], best[0] != last and self.feedback


def local_index(signatures: DataFrame, limit: int = 1_000_000) -> LocalIndex:
    """The index as arrays (400 bytes a signature), where it has at most ``limit`` signatures; larger ones are refused: ``search_batches`` takes those."""
    n = signatures.count()
    if n > limit:
        raise ValueError(f"{n} signatures are too many for a processor's memory, which takes {limit}; search_batches searches larger indexes")
    got = signatures.select("entry_id", "minhash").toArrow()
    hashes = np.frombuffer(b"".join(got["minhash"].to_pylist()), np.uint8).reshape(-1, C.N_PERMUTATIONS)
    return LocalIndex(got["entry_id"].to_numpy().astype(np.int64), hashes)


def identify_stream(chunks: DataFrame, index: LocalIndex, feedback: bool = True, signed: bool = True) -> DataFrame:
    """Windows and their matches of a stream of (stream_id, seq, pcm).  Needs the RocksDB state store."""
    return chunks.groupBy("stream_id").transformWithStateInPandas(statefulProcessor=Identify(index.store(chunks.sparkSession), feedback, signed), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def replay_windows(chunks: DataFrame, rate: int = RATE, low: int = C.STREAM_MIN_SECONDS, high: int = C.STREAM_MAX_SECONDS) -> DataFrame:
    """(stream_id, window_no, start, end) of (stream_id, seq, size): the schedule of a stream without feedback, in batch."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = kernels.stream_windows(pdf.sort_values("seq")["size"].tolist(), rate, low, high)
        return pd.DataFrame([(key[0], i, a, b) for i, (a, b) in enumerate(found)], columns=["stream_id", "window_no", "start", "end"])

    return chunks.select("stream_id", "seq", "size").groupBy("stream_id").applyInPandas(run, "stream_id long, window_no int, start long, end long")


def new_matches(matches: DataFrame, stream: str = "stream_id", order: str = "window_no", match: str = "entry_id") -> DataFrame:
    """Only the matches that differ from the last match of their stream; windows without a match don't count."""
    last = F.lag(match).over(Window.partitionBy(stream).orderBy(order))
    return matches.filter(F.col(match).isNotNull()).withColumn("__last", last).filter(~F.col(match).eqNullSafe(F.col("__last"))).drop("__last")


def stream_windows(chunks: DataFrame, signed: bool = True) -> DataFrame:
    """(stream_id, window_no, start_byte, n_bytes, signatures) of a stream of (stream_id, seq, pcm), without feedback.  Needs the RocksDB state store."""
    return chunks.groupBy("stream_id").transformWithStateInPandas(statefulProcessor=Windows(signed), outputStructType=WINDOWS, outputMode="Append", timeMode="None")


def search_windows(windows: DataFrame, index: DataFrame) -> DataFrame:
    """(stream_id, window_no, start_byte, n_bytes, entry_id, average, n_matches): the best entry of each window, found by the band join."""
    key = F.to_json(F.struct("stream_id", "window_no"))
    queries = windows.select(key.alias("query_id"), F.posexplode("signatures").alias("query_sig", "minhash"))
    best = S.search(queries, index).withColumnRenamed("query_id", "__key")
    own = windows.select("stream_id", "window_no", "start_byte", "n_bytes", key.alias("__key"))
    return own.join(best, "__key", "left").drop("__key")


def search_batches(chunks: DataFrame, index: DataFrame, sink, signed: bool = True):
    """A streaming writer for an index of any size: each micro-batch's windows are searched by the band join, and ``sink`` gets (matches, number of the batch).

    Searching comes after the processor that holds the buffers, so that a match can't clear them: windows are those of
    ``identify_stream(feedback=False)``.  ``new_matches`` drops repeated results from what the sink has stored.
    """

    def run(df: DataFrame, n: int) -> None:
        sink(search_windows(written(df), index), n)

    return stream_windows(chunks, signed).writeStream.foreachBatch(run)


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """The state store that processors need, for streams that are started inside; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (stream_id, seq, pcm) of files named ``<stream>-<number>.pcm``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)-\d+\.pcm$", 1).alias("stream_id"), F.regexp_extract("path", r"-(\d+)\.pcm$", 1).cast("long").alias("seq"), F.col("content").alias("pcm"))
