"""``python -m echofold index FILE...`` prints a text database; ``search FILE DATABASE`` prints the best entry;
``listen FOLDER DATABASE`` prints the songs of streams as their chunks come in."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from echofold.operators import audio, search
from echofold.session import ship
from echofold.sources import text_db, wav
from echofold.streaming import identify


def follow(spark: SparkSession, folder: str, database: str, once: bool = False) -> int:
    """Print each new match of the streams whose chunks come into ``folder`` as files ``<stream>-<number>.pcm``."""
    entries, signatures = text_db.read_text_database(spark, database)
    entries = entries.cache()

    def say(df, n: int) -> None:
        for r in search.report(df.filter("is_new"), entries).orderBy("stream_id", "window_no").collect():  # one row a change of song
            print(f"{r['stream_id']}: " + " - ".join(x for x in (r["filename"], r["artist"], r["track_title"], r["album_title"]) if x), flush=True)

    with identify.rocksdb(spark):
        out = identify.identify_stream(identify.chunk_files(spark, folder), identify.local_index(signatures)).writeStream.foreachBatch(say)
        (out.trigger(availableNow=True) if once else out).start().awaitTermination()
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="echofold")
    sub = parser.add_subparsers(dest="verb", required=True)
    sub.add_parser("index").add_argument("files", nargs="+")
    s = sub.add_parser("search")
    s.add_argument("sample")
    s.add_argument("database")
    s.add_argument("--verbose", action="store_true")
    listen = sub.add_parser("listen")
    listen.add_argument("folder")
    listen.add_argument("database")
    listen.add_argument("--once", action="store_true", help="end when the chunks that are there have been read")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("echofold").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    ship(spark)
    if args.verb == "index":
        entries, signatures = audio.to_index(audio.fingerprint_table(wav.binary_files(spark, args.files)), keep_failed=True)
        bad = entries.filter("status is not null").select("filename", "status").collect()
        for r in bad:
            print(f"{r['filename']}: {r['status']}", file=sys.stderr)
        for r in text_db.database_text(entries.filter("status is null"), signatures).orderBy("entry_id").toLocalIterator():
            print(r["value"])
        return int(bool(bad))
    if args.verb == "listen":
        return follow(spark, args.folder, args.database, args.once)
    began = time.time()
    entries, index = (x.cache() for x in text_db.read_text_database(spark, args.database))
    index.count()
    print(f"Database loaded in {1000 * (time.time() - began):.0f} ms")
    _, own = audio.to_index(audio.fingerprint_table(wav.binary_files(spark, args.sample)))
    queries = audio.as_queries(own, "entry_id").cache()
    print(f"Found {queries.count()} signatures")
    began = time.time()
    if args.verbose:
        for r in search.explain_search(queries, index).collect():
            print(f"average {r['average']:.2f}, {r['n_matches']} matches, entry {r['entry_id']}{' *' if r['qualified'] else ''}")
    found = search.report(search.search(queries, index), entries).collect()
    print(f"Search took {1000 * (time.time() - began):.0f} ms")
    for r in found:
        print("Found match:", " - ".join(x for x in (r["filename"], r["artist"], r["track_title"], r["album_title"]) if x))
    return 0 if found else 1
