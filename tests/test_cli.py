import pytest

from echofold import cli
from echofold.functions import constants as C
from echofold.operators import audio, search
from echofold.plans.queries import _synthetic
from echofold.sources import wav


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("audio")
    for name, content in _synthetic():
        (at / name).write_bytes(content)
    return at


@pytest.fixture(scope="module")
def database(spark, folder):
    import contextlib
    import io

    with contextlib.redirect_stdout(said := io.StringIO()):
        assert cli.main(["index", *(str(folder / f"song{k}.wav") for k in range(3))]) == 0
    (folder / "db").write_text(said.getvalue())
    return str(folder / "db")


def test_index_and_search(spark, folder, database, capsys):
    assert cli.main(["search", str(folder / "excerpt.wav"), database, "--verbose"]) == 0
    said = capsys.readouterr().out
    assert "song1.wav - artist 1 - title 1" in said and "Database loaded in" in said and "Search took" in said and "average" in said
    assert cli.main(["search", str(folder / "silence.wav"), database]) == 1
    assert cli.main(["index", str(folder / "text.wav")]) == 1 and "NOT_A_WAVE_FILE" in capsys.readouterr().err


def test_listen(spark, folder, database, capsys, tmp_path):
    song = dict(_synthetic())["song2.wav"]
    at = wav.parse_wave(song).data_pos
    for k in range(28):
        (tmp_path / f"hall-{k}.pcm").write_bytes(song[at + k * 25_200 : at + (k + 1) * 25_200])
    assert cli.main(["listen", str(tmp_path), database, "--once"]) == 0
    lines = [x for x in capsys.readouterr().out.splitlines() if x.startswith("hall: ")]
    assert len(lines) == 1 and "song2.wav - artist 2 - title 2" in lines[0]


def test_files_and_samples_give_the_same_signatures(spark, folder):
    _, signatures = audio.fingerprint_files(spark, str(folder / "song0.wav"), partitions=2)
    content = (folder / "song0.wav").read_bytes()
    w = wav.parse_wave(content)
    x = audio.kernels.from_44100(audio.kernels.pcm_to_mono(content[w.data_pos : w.data_pos + w.data_size]))
    series = spark.createDataFrame([("song0", x.tolist())], "series_id string, samples array<float>")
    own = audio.fingerprint_samples(series)
    key = lambda df: {r["image_idx"]: bytes(r["minhash"]) for r in df.collect()}
    assert len(x) > C.MIN_SAMPLES and key(own) == key(signatures) and len(key(own)) > 80
    best = search.explain_search(audio.as_queries(own), signatures).collect()
    assert [(r["entry_id"], r["qualified"], r["rank"]) for r in best] == [(0, True, 1)]


def test_ffmpeg_path_with_a_stub(spark, folder, monkeypatch, tmp_path):
    """A program named ffmpeg that hands out a wave file and its tags."""
    stub = tmp_path / "ffmpeg"
    stub.write_text(f"#!/bin/sh\nfor last; do :; done\ncase \"$*\" in *ffmetadata*) printf 'artist=Stub\\ntitle=T\\n' > \"$last\";; *) cp {folder}/song0.wav \"$last\";; esac\n")
    stub.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:/usr/bin:/bin")
    status, tags, found = audio.fingerprint_bytes(b"some other format")
    assert status is None and tags == {"artist": "Stub", "track_title": "T"} and len(found) > 80
    assert audio.fingerprint_bytes(b"some other format", use_ffmpeg=False)[0] == "NOT_A_WAVE_FILE"
    stub.write_text("#!/bin/sh\nexit 1\n")
    assert audio.fingerprint_bytes(b"some other format")[0] == "NOT_A_WAVE_FILE"
