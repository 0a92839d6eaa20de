import struct

import numpy as np
import pytest

from echofold.operators import audio
from echofold.sources import text_db, wav


def pcm(n=60_000, channels=2, seed=0):
    return (np.random.default_rng(seed).normal(size=(n, channels)) * 3000).astype("<i2").tobytes()


def made(path, body):
    path.write_bytes(body)
    return body


def test_tags_and_padding(tmp_path):
    p = tmp_path / "a.wav"
    wav.write_wave(str(p), pcm(), 2, {"artist": "An Artist", "album_title": "Odd"})
    w = wav.parse_wave(p.read_bytes())
    assert (w.channels, w.sample_rate, w.artist, w.track_title, w.album_title, w.data_size) == (2, 44100, "An Artist", None, "Odd", 240_000)
    raw = p.read_bytes()
    extra = raw[:36] + b"junk" + struct.pack("<I", 3) + b"abc\0" + raw[36:]
    assert wav.parse_wave(extra).data_pos == w.data_pos + 12
    with pytest.raises(wav.WaveError):
        wav.parse_wave(extra, strict_padding=True)


@pytest.mark.parametrize(
    "change, status",
    [
        (lambda b: b"", "NOT_A_WAVE_FILE"), (lambda b: b"text" * 20, "NOT_A_WAVE_FILE"),
        (lambda b: b[:34] + struct.pack("<H", 8) + b[36:], "UNSUPPORTED_WAVE_FILE"), (lambda b: b[:24] + struct.pack("<I", 48000) + b[28:], "UNSUPPORTED_WAVE_FILE"),
        (lambda b: b[:20] + struct.pack("<h", 3) + b[22:], "UNSUPPORTED_WAVE_FILE"), (lambda b: b[:1000], "DECODING_ERROR"), (lambda b: b[:12] + b"data" + b[16:], "DECODING_ERROR"),
    ],
)
def test_status(tmp_path, spark, change, status):
    p = tmp_path / "a.wav"
    wav.write_wave(str(p), pcm())
    files = spark.createDataFrame([(str(p), change(p.read_bytes()))], "path string, content binary")  # Spark's reader skips empty files
    (r,) = wav.wave_headers(files).collect()
    assert r["status"] == status


def test_length_limit():
    body = lambda n: struct.pack("<4sI4s4sIhHIIHH", b"RIFF", 0, b"WAVE", b"fmt ", 16, 1, 1, 44100, 88200, 2, 16) + struct.pack("<4sI", b"data", 2 * n) + pcm(n, 1)
    assert audio.fingerprint_bytes(body(8 * 10_176 - 1))[0] == "FILE_TOO_SMALL"
    assert audio.fingerprint_bytes(body(8 * 10_176))[0] is None


def test_channels_are_averaged():
    one = pcm(120_000, 1)
    same = [audio.kernels.pcm_to_mono(np.repeat(np.frombuffer(one, "<i2"), c).astype("<i2").tobytes(), c) for c in (1, 2, 4)]
    assert np.allclose(same[0], same[1]) and np.allclose(same[0], same[2])


def test_data_source(spark, tmp_path):
    wav.write_wave(str(tmp_path / "a.wav"), pcm())
    (tmp_path / "b.wav").write_bytes(b"no")
    spark.dataSource.register(wav.WaveDataSource)
    got = {r["path"].rsplit("/", 1)[-1]: (r["status"], r["pcm"] and len(r["pcm"])) for r in spark.read.format("echofold_wav").load(str(tmp_path)).collect()}
    assert got == {"a.wav": (None, 240_000), "b.wav": ("NOT_A_WAVE_FILE", None)}


def test_ffmetadata():
    assert wav.parse_ffmetadata("x=1\nartist=A\nartist=B\ntitle=T\n") == {"artist": "A", "track_title": "T"}


def entries(spark):
    e = spark.createDataFrame([(0, "a.wav", "A", None, ""), (1, "b.wav", None, "T", "L"), (2, "c.wav", None, None, None)], "entry_id int, filename string, artist string, track_title string, album_title string")
    s = spark.createDataFrame([(0, 0, bytes(range(100))), (0, 1, bytes(100)), (1, 0, bytes([255] * 100))], "entry_id int, sig_idx int, minhash binary")
    return e, s


def test_text_database_round_trip(spark, tmp_path):
    e, s = entries(spark)
    for mode in ("error", "append"):
        text_db.write_text_database(e, s, str(tmp_path / "db"), mode)
    got_e, got_s = text_db.read_text_database(spark, str(tmp_path / "db"))
    assert got_e.count() == 6 and got_e.agg({"n_signatures": "sum"}).first()[0] == 6
    assert sorted(bytes(r["minhash"]) for r in got_s.collect()) == sorted(2 * [bytes(range(100)), bytes(100), bytes([255] * 100)])
    assert sorted(r["entry_id"] for r in got_e.collect()) == list(range(6))
    names = {(r["filename"], r["artist"], r["track_title"]) for r in got_e.collect()}
    assert ("a.wav", "A", "") in names and ("b.wav", "", "T") in names


def test_appended_entries_keep_their_positions(spark, tmp_path):
    for k in range(4):
        e = spark.createDataFrame([(i, f"{k}-{i}.wav", None, None, None) for i in range(7)], "entry_id int, filename string, artist string, track_title string, album_title string")
        s = spark.createDataFrame([(i, 0, bytes([k, i] * 50)) for i in range(7)], "entry_id int, sig_idx int, minhash binary")
        text_db.write_text_database(e, s, str(tmp_path / "db"), "append")
        got_e, got_s = text_db.read_text_database(spark, str(tmp_path / "db"))
        assert [r["filename"] for r in got_e.orderBy("entry_id").collect()] == [f"{j}-{i}.wav" for j in range(k + 1) for i in range(7)]
    assert {r["entry_id"]: bytes(r["minhash"])[:2] for r in got_s.collect()} == {7 * k + i: bytes([k, i]) for k in range(4) for i in range(7)}


def test_images_and_raw_fingerprints_make_the_signatures(spark):
    t = np.arange(13_000) / 5512.5
    x = audio.kernels.rms_normalize(sum(np.sin(2 * np.pi * f * t * (1 + 0.1 * np.sin(t))) for f in (400, 900, 1500)).astype(np.float32))
    series = spark.createDataFrame([("a", x.tolist()), ("quiet", [0.0] * 11_000), ("short", [1.0] * 50), ("none", None)], "series_id string, samples array<float>")
    images = audio.spectral_images(series)
    raw = audio.raw_fingerprints(images).collect()
    assert {(r["series_id"], r["is_silence"]) for r in raw} == {("a", False), ("quiet", True)}
    assert len(images.filter("series_id = 'a'").first()["image"]) == 128 * 32 and all(1 <= len(r["bits"]) <= 200 and r["bits"] == sorted(r["bits"]) for r in raw if r["series_id"] == "a")
    own = {r["image_idx"]: audio.kernels.minhash(np.array(r["bits"])).tobytes() for r in raw if not r["is_silence"]}
    assert own == {r["image_idx"]: bytes(r["minhash"]) for r in audio.fingerprint_samples(series.filter("samples is not null")).collect()}


@pytest.mark.parametrize("text", ["a\nb\nc\nd\n1\n" + "0" * 199 + "\n", "a\nb\nc\nd\n2\n" + "0" * 200 + "\n", "a\nb\nc\nd\n1\n" + "0" * 200, "a\nb\nc\nd\nx\n", "a\nb\nc\n", "x" * 1100 + "\n\n\n\n0\n", "a\nb\nc\nd\n1\n" + "g" * 200 + "\n"])
def test_malformed_database(spark, tmp_path, text):
    with pytest.raises(text_db.DatabaseError):
        list(text_db.parse_database(text.encode()))
    (tmp_path / "db").write_text(text)
    assert text_db.read_text_database(spark, str(tmp_path / "db"), permissive=True)[0].count() == 0


def test_upper_case_hex_and_empty():
    assert list(text_db.parse_database(b"")) == []
    ((*_, found),) = text_db.parse_database(b"a\n\n\n\n1\n" + b"AB" * 100 + b"\n")
    assert found == [b"\xab" * 100]
