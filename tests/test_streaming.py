import numpy as np
import pytest

from echofold.functions import constants as C
from echofold.operators import audio
from echofold.operators import search as S
from echofold.plans.queries import QUERIES, _files, _microphones, _synthetic
from echofold.sources import wav
from echofold.streaming import identify as I


def test_stream_is_identified(spark, tmp_path):
    files = dict(_synthetic())
    songs = spark.createDataFrame([(n, files[n]) for n in ("song0.wav", "song1.wav")], "path string, content binary")
    entries, signatures = audio.to_index(audio.fingerprint_table(songs))
    names = {r["entry_id"]: r["filename"] for r in entries.collect()}
    r = np.random.default_rng(1)  # an index of several MB, as real ones are
    other = spark.createDataFrame([(100 + i, i, h.tobytes()) for i, h in enumerate(r.integers(0, 255, (30_000, 100), np.uint8))], "entry_id int, sig_idx int, minhash binary")
    index = I.local_index(signatures.select("entry_id", "sig_idx", "minhash").unionAll(other))
    pcm = b""
    for n in ("song1.wav", "song0.wav"):
        w = wav.parse_wave(files[n])
        pcm += files[n][w.data_pos : w.data_pos + 6 * 4 * C.SAMPLE_RATE]
    sizes = np.random.default_rng(3).integers(20_000, 90_000, 200)
    source, at = tmp_path / "in", 0
    source.mkdir()
    for k, n in enumerate(sizes.tolist()):
        n -= n % 4
        if at < len(pcm):
            (source / f"mic-{k}.pcm").write_bytes(pcm[at : at + n])
        at += n
    out = I.identify_stream(I.chunk_files(spark, str(source)), index)
    q = out.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    new = [names[r["entry_id"]] for r in spark.table("found").orderBy("window_no").collect() if r["is_new"]]
    assert new == ["song1.wav", "song0.wav"]


def test_new_matches(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, 5), (1, 2, None), (1, 3, 5), (1, 4, 6), (1, 5, 5)], "stream_id int, window_no int, entry_id int")
    assert [r["window_no"] for r in I.new_matches(df).orderBy("window_no").collect()] == [0, 4, 5]


def test_large_indexes_are_refused(spark):
    signatures = spark.createDataFrame([(i, bytes(100)) for i in range(3)], "entry_id int, minhash binary")
    with pytest.raises(ValueError, match="3 signatures are too many .* takes 2; search_batches"):
        I.local_index(signatures, limit=2)


def test_registered_stream_equals_its_replay(spark, sf_dir):
    """Songs by stream in order, and the schedule of windows between matches."""
    found = QUERIES["stream_identify"](spark, sf_dir).orderBy("stream_id", "window_no").collect()
    songs = {r["entry_id"]: r["filename"] for r in audio.to_index(audio.fingerprint_table(_files(spark).filter("path like 'song%'")))[0].collect()}
    new = [(r["stream_id"], songs[r["entry_id"]]) for r in found if r["is_new"]]
    assert new == [("one song", "song2.wav"), ("two songs", "song1.wav"), ("two songs", "song0.wav")]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    # until the first match the schedule is that of a stream without feedback
    sizes = [len(r["pcm"]) for r in _microphones(spark).filter("stream_id = 'one song'").orderBy("seq").collect()]
    plain = audio.kernels.stream_windows(sizes)
    own = [(r["start_byte"], r["start_byte"] + r["n_bytes"]) for r in found if r["stream_id"] == "one song"]
    until = [r["is_new"] for r in found if r["stream_id"] == "one song"].index(True) + 1
    assert own[:until] == plain[:until]


def test_batches_find_what_the_processor_finds(spark, tmp_path):
    """The band join of each micro-batch against the index in memory, without feedback."""
    _, signatures = audio.to_index(audio.fingerprint_table(_files(spark).filter("path like 'song%'")))
    signatures = signatures.cache()
    _microphones(spark).repartition(3).write.parquet(str(tmp_path / "chunks"))
    read = lambda: spark.readStream.schema("stream_id string, seq long, pcm binary").parquet(str(tmp_path / "chunks"))
    q = I.identify_stream(read(), I.local_index(signatures), feedback=False).writeStream.format("memory").queryName("plain").option("checkpointLocation", str(tmp_path / "a"))
    q.trigger(availableNow=True).start().awaitTermination()
    want = {(r["stream_id"], r["window_no"], r["start_byte"], r["n_bytes"]): (r["entry_id"], r["average"], r["n_matches"]) for r in spark.table("plain").collect()}
    got = {}

    def sink(df, n):
        got.update({(r["stream_id"], r["window_no"], r["start_byte"], r["n_bytes"]): (r["entry_id"], r["average"], r["n_matches"]) for r in df.collect()})

    I.search_batches(read(), signatures, sink).option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start().awaitTermination()
    assert len(want) > 10 and {v[0] for v in want.values()} >= {0, 1, 2} and got.keys() == want.keys()
    assert all(a[0] == b[0] and a[2] == b[2] and (a[1] is None or abs(a[1] - b[1]) < 1e-9) for a, b in ((got[k], want[k]) for k in want))


def test_local_order_is_the_order_of_the_join(spark):
    r = np.random.default_rng(11)
    hashes = [r.integers(0, 3, 100).astype(np.uint8).tobytes() for _ in range(60)]
    index = spark.createDataFrame([(i % 7, i, h) for i, h in enumerate(hashes)], "entry_id int, sig_idx int, minhash binary")
    queries = [hashes[k] for k in (3, 10, 17, 24, 31)] + [r.integers(0, 3, 100).astype(np.uint8).tobytes() for _ in range(10)]
    own = spark.createDataFrame([(1, k, h) for k, h in enumerate(queries)], "query_id int, query_sig int, minhash binary")
    found = S.search(own, index).collect()
    best = I.local_index(index).search(queries)
    assert [(x["entry_id"], x["average"], x["n_matches"]) for x in found] == ([best] if best else [])
