"""The engine's queries over the driver's tables.  Each takes (spark, sf_dir)."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echofold.functions import columns as X
from echofold.functions import constants as C
from echofold.operators import minhash as M
from echofold.operators import search as S
from echofold.operators import signal as G
from echofold.session import shared_dir, written
from echofold.sources import wav
from echofold.streaming import identify as I

#: Parameters of the queries on 64-value vectors and on event series: small relatives of the audio path's.
VECTOR, SPECTRUM_EDGES = 64, (1, 2, 3, 5, 8, 13, 21, 33)
FRAME, HOP, WIDTH, IMAGE_HOP = 16, 4, 8, 2
TOP, VECTOR_LOUD, VECTOR_LEAST = 16, 0.2, 4
BITS, PERMS, RANKS, BANDS = 128, 20, 64, 5
DOC_BITS, DOC_PERMS, DOC_MIN_SCORE = C.N_BITS, C.N_PERMUTATIONS, C.MIN_SCORE
PASSAGE_BITS, PASSAGE_WIDTH, PASSAGE_HOP = 512, 16, 2
STREAM_RATE = 40
#: Bytes of a chunk of the synthetic streams: a seventh of a second.
STREAM_CHUNK = I.RATE // 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return G.series_of(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return G.series_of_arrays(table(spark, d, "embeddings"), "vec_id", "embedding")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


def rms_normalize(spark, d):
    return rounded(G.rms_normalize(events(spark, d)), "y")


def fir_decimate(spark, d):
    return rounded(G.fir_decimate(events(spark, d)), "y")


def hann_window(spark, d):
    return rounded(G.hann_window(vectors(spark, d), VECTOR), "y")


def frame_counts(spark, d):
    return G.frame_counts(events(spark, d), FRAME, HOP, WIDTH, IMAGE_HOP)


def frame_slices(spark, d):
    return rounded(G.slices(events(spark, d), FRAME, HOP), "value")


def image_slices(spark, d):
    """Images of frame means: the mean of each frame is a sample of a slower series."""
    means = G.slices(events(spark, d), FRAME, HOP).groupBy("series_id", F.col("slice_no").alias("idx")).agg(F.avg("value").alias("value"))
    return rounded(G.slices(means, WIDTH, IMAGE_HOP), "value")


def dft_power(spark, d):
    return rounded(G.dft_power(vectors(spark, d), VECTOR), "power")


def log_bins(spark, d):
    return rounded(G.log_bins(G.dft_power(vectors(spark, d), VECTOR), SPECTRUM_EDGES), "mean_power")


def log_bin_edges(spark, d):
    return G.log_bin_edges(spark)


def image_scale(spark, d):
    return rounded(G.image_scale(vectors(spark, d).withColumn("value", F.abs("value"))), "scaled")


def haar_1d(spark, d):
    return rounded(G.haar_1d(vectors(spark, d), VECTOR), "coeff")


def haar_2d(spark, d):
    return rounded(G.haar_2d(vectors(spark, d), 8, 8), "coeff")


def _top(spark, d):
    return G.top_wavelets(G.haar_2d(vectors(spark, d), 8, 8), TOP)


def topk_wavelets(spark, d):
    return rounded(_top(spark, d), "coeff")


def sign_bits(spark, d):
    return G.sign_bits(_top(spark, d))


def silence_flags(spark, d):
    return G.silence(_top(spark, d), VECTOR_LOUD, VECTOR_LEAST)


def _vector_signatures(spark, d):
    loud = silence_flags(spark, d).filter("not is_silence").select("series_id")
    return M.signatures_of_bits(sign_bits(spark, d).join(loud, "series_id", "left_semi"), BITS, PERMS, RANKS)


def minhash_signatures(spark, d):
    return _vector_signatures(spark, d).select("series_id", F.posexplode(X.bytes_of(F.col("minhash"))).alias("perm", "rank"))


def signature_hex(spark, d):
    return _vector_signatures(spark, d).select("series_id", F.lower(F.hex("minhash")).alias("signature"))


def band_keys(spark, d):
    return M.band_table(_vector_signatures(spark, d), BANDS).select("series_id", "band_no", "band_key")


def band_bucket_mod(spark, d):
    """Chained-table buckets: keys modulo half the number of signatures."""
    keys = band_keys(spark, d)
    size = keys.select("series_id").distinct().agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 2)).alias("size"))
    return keys.join(F.broadcast(size)).groupBy("band_no", F.pmod("band_key", "size").alias("bucket")).agg(F.count(F.lit(1)).alias("n_signatures"))


def _doc_signatures(spark, d):
    return M.text_signatures(table(spark, d, "documents"), "doc_id", "text", DOC_BITS, DOC_PERMS, C.NO_BIT)


def document_signatures(spark, d):
    return _doc_signatures(spark, d).select(F.col("series_id").alias("doc_id"), F.lower(F.hex("minhash")).alias("signature"))


def _doc_pairs(spark, d, min_score):
    own = written(_doc_signatures(spark, d)).withColumnRenamed("series_id", "entry_id")
    return S.self_pairs(own, min_score=min_score)


def lsh_candidates(spark, d):
    return _doc_pairs(spark, d, 0).select("query_id", "entry_id", "n_bands")


def pair_scores(spark, d):
    return _doc_pairs(spark, d, DOC_MIN_SCORE)


def database_stats(spark, d):
    """Signatures of each document that has any."""
    return _index(spark, d).groupBy("entry_id").agg(F.count(F.lit(1)).alias("n_signatures"))


def _index(spark, d):
    return M.window_signatures(table(spark, d, "documents"), "doc_id", "text", PASSAGE_BITS, width=PASSAGE_WIDTH, hop=PASSAGE_HOP).select("entry_id", "sig_idx", "minhash")


def _queries(spark, d):
    own = M.window_signatures(table(spark, d, "benchmark"), "item_id", "text", PASSAGE_BITS, width=PASSAGE_WIDTH, hop=PASSAGE_HOP)
    return own.select(F.col("entry_id").alias("query_id"), F.col("sig_idx").alias("query_sig"), "minhash")


def _scored(spark, d):
    return S.scored_pairs(_queries(spark, d), _index(spark, d))


def passage_pairs(spark, d):
    return _scored(spark, d)


def entry_scores(spark, d):
    return rounded(S.entry_scores(_scored(spark, d)), "average")


def qualified_entries(spark, d):
    return entry_scores(spark, d).filter(S.qualifies())


def rank_entries(spark, d):
    return rounded(S.rank_entries(S.entry_scores(_scored(spark, d))), "average")


def best_match(spark, d):
    """With the entry's own columns."""
    best = rounded(S.search(_queries(spark, d), _index(spark, d)), "average")
    return best.join(table(spark, d, "documents").select(F.col("doc_id").alias("entry_id"), "lang", "source"), "entry_id")


def identify_passage(spark, d):
    """Which document does each passage come from?  Passages without an answer have nulls."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return items.join(rounded(S.search(_queries(spark, d), _index(spark, d)), "average"), "query_id", "left")


def search_compat(spark, d):
    return rounded(S.search(_queries(spark, d), _index(spark, d), compat=True), "average")


def metadata_parse(spark, d):
    """Tags of metadata lines that are made of the pages: artist is the host, title the path, album the query."""
    url = F.col("url")
    lines = F.array(F.concat(F.lit("title="), F.regexp_extract(url, r"://[^/]*(/[^?#]*)", 1)), F.concat(F.lit("artist="), F.regexp_extract(url, r"://([^/]*)", 1)), F.lit("comment=artist=none"), F.concat(F.lit("artist="), F.lit("later")), F.concat(F.lit("album="), F.regexp_extract(url, r"\?(.*)$", 1)))
    return wav.metadata_columns(table(spark, d, "pages").select("page_id", F.posexplode(lines).alias("no", "line")), "page_id", "line", "no")


def _chunks(spark, d):
    """Chunks of bytes of each user's events, in order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("stream_id"), F.row_number().over(w).cast("long").alias("seq"), (1 + F.pmod("event_id", F.lit(17))).cast("long").alias("size"))


def stream_windows(spark, d):
    return I.replay_windows(_chunks(spark, d), STREAM_RATE)


def stream_dedup(spark, d):
    """Users' events where the type is new, purchases aside."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = table(spark, d, "events").select(F.col("user_id").alias("stream_id"), F.row_number().over(w).alias("window_no"), F.when(F.col("event_type") != "purchase", F.col("event_type")).alias("entry_id"))
    return I.new_matches(own)


@functools.cache
def _synthetic() -> tuple[tuple[str, bytes], ...]:
    """Wave files made of chirps, as (name, content): three songs, an excerpt, silence and a file that is no wave."""
    import tempfile
    from pathlib import Path

    import numpy as np

    out = []
    with tempfile.TemporaryDirectory() as at:
        def wave(name, x, tags=None):
            pcm = np.repeat((np.clip(x, -1, 1) * 32000).astype("<i2"), 2).tobytes()
            wav.write_wave(f"{at}/{name}", pcm, 2, tags)
            out.append((name, Path(at, name).read_bytes()))

        songs = []
        for k in range(3):
            r = np.random.default_rng(k)
            t = np.arange(12 * C.SAMPLE_RATE) / C.SAMPLE_RATE
            notes = sum(0.2 * np.sin(2 * np.pi * np.cumsum(np.repeat(r.uniform(320, 1900, 60), len(t) // 60)) / C.SAMPLE_RATE) for _ in range(4))
            songs.append(notes)
            wave(f"song{k}.wav", notes, {"artist": f"artist {k}", "track_title": f"title {k}"})
        wave("excerpt.wav", songs[1][123_457 : 123_457 + 5 * C.SAMPLE_RATE])
        wave("silence.wav", np.zeros(5 * C.SAMPLE_RATE))
        out.append(("text.wav", b"no wave at all"))
    return tuple(out)


def _files(spark):
    return spark.createDataFrame(list(_synthetic()), "path string, content binary")


def wav_roundtrip(spark, d):
    return wav.wave_headers(_files(spark))


def fingerprint_audio(spark, d):
    from echofold.operators import audio

    return audio.fingerprint_table(_files(spark)).groupBy("path", "status").agg(F.count("minhash").alias("n_signatures"))


def identify_audio(spark, d):
    """The excerpt's song."""
    from echofold.operators import audio

    entries, index = audio.to_index(audio.fingerprint_table(_files(spark).filter("path like 'song%'")))
    _, own = audio.to_index(audio.fingerprint_table(_files(spark).filter("path = 'excerpt.wav'")))
    return S.report(S.search(audio.as_queries(own, "entry_id"), index), entries)


def _microphones(spark):
    """Chunks of two streams: parts of two songs one after the other, and one song alone."""
    files, rows = dict(_synthetic()), []
    for stream, names in (("two songs", ("song1.wav", "song0.wav")), ("one song", ("song2.wav",))):
        parts = [(files[n], wav.parse_wave(files[n]).data_pos) for n in names]
        pcm = b"".join(f[at : at + 6 * I.RATE] for f, at in parts)
        rows += [(stream, k, bytearray(pcm[at : at + STREAM_CHUNK])) for k, at in enumerate(range(0, len(pcm), STREAM_CHUNK))]
    return spark.createDataFrame(rows, "stream_id string, seq long, pcm binary")


def stream_identify(spark, d):
    """Windows of two streams and their songs, by a streaming query that runs until its source is read."""
    from echofold.operators import audio

    _, signatures = audio.to_index(audio.fingerprint_table(_files(spark).filter("path like 'song%'")))
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    _microphones(spark).write.parquet(f"{at}/chunks")
    chunks = spark.readStream.schema("stream_id string, seq long, pcm binary").parquet(f"{at}/chunks")
    with I.rocksdb(spark):
        out = I.identify_stream(chunks, I.local_index(signatures)).writeStream.format("parquet").option("path", f"{at}/found").option("checkpointLocation", f"{at}/state")
        out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(I.OUTPUT).parquet(f"{at}/found")


NAMES = """rms_normalize fir_decimate hann_window frame_counts frame_slices image_slices dft_power log_bins log_bin_edges image_scale
haar_1d haar_2d topk_wavelets sign_bits silence_flags minhash_signatures signature_hex band_keys band_bucket_mod
document_signatures lsh_candidates pair_scores database_stats passage_pairs entry_scores qualified_entries rank_entries best_match
identify_passage search_compat metadata_parse stream_windows stream_dedup wav_roundtrip fingerprint_audio identify_audio stream_identify""".split()
QUERIES = {n: globals()[n] for n in NAMES}
