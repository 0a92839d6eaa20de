"""The plain-text signature database: five header lines for each entry, then a line of 200 hex digits for each signature."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_LINE, DIGITS = 1022, 200
#: Folders of appended databases; sorts after the names of Spark's part files.
LATER = "then-"


class DatabaseError(ValueError):
    pass


def parse_database(text: bytes) -> Iterator[tuple[str, str, str, str, list[bytes]]]:
    """(filename, artist, track_title, album_title, signatures) of each entry; anything malformed ends the whole load."""
    lines = text.split(b"\n")
    if lines.pop():
        raise DatabaseError("DECODING_ERROR: the last line has no end")
    if any(len(x) > MAX_LINE for x in lines):
        raise DatabaseError("DECODING_ERROR: a line is too long")
    at = 0
    while at < len(lines):
        if at + 5 > len(lines):
            raise DatabaseError("DECODING_ERROR: an entry is cut short")
        names = [x.decode("utf-8", "replace") for x in lines[at : at + 4]]
        if not lines[at + 4].isdigit():
            raise DatabaseError("DECODING_ERROR: no count")
        n = int(lines[at + 4])
        own = lines[at + 5 : at + 5 + n]
        if len(own) < n or any(len(x) != DIGITS for x in own):
            raise DatabaseError("DECODING_ERROR: a signature is malformed")
        try:
            yield (*names, [bytes.fromhex(x.decode("ascii")) for x in own])
        except ValueError as e:
            raise DatabaseError("DECODING_ERROR: not a hex digit") from e
        at += 5 + n


def read_text_database(spark: SparkSession, path: str, permissive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entries, signatures).  Files count in the order of their paths, entries in the order of their lines.

    A malformed file raises; with ``permissive`` it gives no entries.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    out += [{"path": p, "ordinal": i, "filename": e[0], "artist": e[1], "track_title": e[2], "album_title": e[3], "minhashes": e[4]} for i, e in enumerate(list(parse_database(content)))]
                except DatabaseError:
                    if not permissive:
                        raise
            kinds = [("path", pa.string()), ("ordinal", pa.int32()), ("filename", pa.string()), ("artist", pa.string()), ("track_title", pa.string()), ("album_title", pa.string()), ("minhashes", pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))

    parsed = files.mapInArrow(run, "path string, ordinal int, filename string, artist string, track_title string, album_title string, minhashes array<binary>")
    # ids count entries over files: a running sum of each file's number of entries, one row a file
    sizes = parsed.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("path", F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = parsed.join(before, "path").withColumn("entry_id", (F.col("before") + F.col("ordinal")).cast("int"))
    entries = numbered.select("entry_id", "filename", "artist", "track_title", "album_title", F.size("minhashes").alias("n_signatures"))
    signatures = numbered.select("entry_id", F.posexplode("minhashes").alias("sig_idx", "minhash"))
    return entries, signatures


def database_text(entries: DataFrame, signatures: DataFrame) -> DataFrame:
    """(entry_id, value): the text of each entry, without its last line end; null names are empty lines."""
    lines = signatures.groupBy("entry_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("sig_idx", F.lower(F.hex("minhash")).alias("h")))), lambda x: x["h"]).alias("hex"))
    name = lambda c: F.coalesce(c, F.lit(""))
    both = entries.join(lines, "entry_id", "left").withColumn("hex", F.coalesce("hex", F.array().cast("array<string>")))
    head = F.array(*(name(F.col(c)) for c in ("filename", "artist", "track_title", "album_title")), F.size("hex").cast("string"))
    return both.select("entry_id", F.array_join(F.concat(head, "hex"), "\n").alias("value"))


def write_text_database(entries: DataFrame, signatures: DataFrame, path: str, mode: str = "error") -> None:
    """Entries in the order of their ids, in files whose names sort in that order.

    ``mode='append'`` joins databases: each further one goes to a numbered folder that sorts after all that is there, so that the
    positions of entries, which are their ids when read back, stay as they are.
    """
    spark = entries.sparkSession
    if mode == "append":
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(at):
            names = [x.getPath().getName() for x in fs.listStatus(at)]
            number = 1 + max([0, *(int(x.removeprefix(LATER)) for x in names if x.startswith(LATER))])
            path, mode = f"{path}/{LATER}{number:09d}", "error"
    database_text(entries, signatures).repartitionByRange("entry_id").sortWithinPartitions("entry_id").select("value").write.mode(mode).text(path)
