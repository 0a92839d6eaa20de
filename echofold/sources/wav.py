"""WAV files: header, tags and samples, read through Spark's binary file source."""

from __future__ import annotations

import shutil
import struct
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from echofold.functions import constants as C

NOT_WAVE, UNSUPPORTED, DECODING, TOO_SMALL, UNREADABLE = "NOT_A_WAVE_FILE", "UNSUPPORTED_WAVE_FILE", "DECODING_ERROR", "FILE_TOO_SMALL", "CANNOT_READ_FILE"
TAGS = {b"IART": "artist", b"INAM": "track_title", b"IPRD": "album_title"}
HEADER = "format_tag int, channels int, sample_rate long, avg_bytes long, block_align int, bits int, data_pos long, data_size long, artist string, track_title string, album_title string, status string"


class WaveError(ValueError):
    """Its first argument is the status."""


@dataclass
class Wave:
    format_tag: int
    channels: int
    sample_rate: int
    avg_bytes: int
    block_align: int
    bits: int
    data_pos: int
    data_size: int
    artist: str | None = None
    track_title: str | None = None
    album_title: str | None = None


def parse_wave(data: bytes, strict_padding: bool = False) -> Wave:
    """Header and tags of a RIFF file.

    ``fmt `` must come first and be 44.1 kHz, 16-bit PCM of exactly 16 bytes; other chunks up to ``data`` are skipped, with their pad byte
    unless ``strict_padding``; one LIST chunk straight after ``data`` may hold tags, of which the last of a kind counts.
    """
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise WaveError(NOT_WAVE)
    if len(data) < 36 or data[12:16] != b"fmt ":
        raise WaveError(DECODING)
    size, tag, channels, rate, avg, align, bits = struct.unpack_from("<IhHIIHH", data, 16)
    if size < 16:
        raise WaveError(DECODING)
    if size != 16 or tag != 1 or rate != C.SAMPLE_RATE or bits != 16 or not channels or align != 2 * channels:
        raise WaveError(UNSUPPORTED)
    at, pad = 36, 0 if strict_padding else 1
    while True:
        if at + 8 > len(data):
            raise WaveError(DECODING)
        name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"data":
            break
        at += 8 + n + (n & pad)
    if at + 8 + n > len(data):
        raise WaveError(DECODING)
    wave = Wave(tag, channels, rate, avg, align, bits, at + 8, n)
    after = at + 8 + n + (n & pad)
    if data[after : after + 4] == b"LIST" and data[after + 8 : after + 12] == b"INFO":
        end, at = min(len(data), after + 8 + struct.unpack_from("<I", data, after + 4)[0]), after + 12
        while at + 8 <= end:
            kind, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if kind in TAGS:
                setattr(wave, TAGS[kind], data[at + 8 : at + 8 + n].split(b"\0", 1)[0].decode("utf-8", "replace"))
            at += 8 + n + (n & pad)
    return wave


def write_wave(path: str, pcm: bytes, channels: int = 2, tags: dict[str, str] | None = None) -> None:
    body = b"WAVE" + struct.pack("<4sIhHIIHH", b"fmt ", 16, 1, channels, C.SAMPLE_RATE, C.SAMPLE_RATE * 2 * channels, 2 * channels, 16)
    body += struct.pack("<4sI", b"data", len(pcm)) + pcm + b"\0" * (len(pcm) & 1)
    if tags:
        names, info = {v: k for k, v in TAGS.items()}, b"INFO"
        for k, v in tags.items():
            raw = v.encode() + b"\0"
            info += struct.pack("<4sI", names[k], len(raw)) + raw + b"\0" * (len(raw) & 1)
        body += struct.pack("<4sI", b"LIST", len(info)) + info
    Path(path).write_bytes(struct.pack("<4sI", b"RIFF", len(body)) + body)


def transcode(data: bytes) -> tuple[bytes, dict[str, str]] | None:
    """Any audio file as WAV bytes and tags, by the program ffmpeg where it is installed; None if it can't."""
    program = shutil.which("ffmpeg")
    if not program:
        return None
    with tempfile.TemporaryDirectory() as d:
        source, wave, meta = Path(d, "in"), Path(d, "out.wav"), Path(d, "meta")
        source.write_bytes(data)
        common = [program, "-v", "error", "-y", "-i", str(source)]
        done = subprocess.run([*common, "-acodec", "pcm_s16le", "-ar", str(C.SAMPLE_RATE), "-f", "wav", str(wave)], check=False)
        if done.returncode:
            return None
        subprocess.run([*common, "-f", "ffmetadata", str(meta)], check=False)
        return wave.read_bytes(), parse_ffmetadata(meta.read_text("utf-8", "replace") if meta.exists() else "")


def parse_ffmetadata(text: str) -> dict[str, str]:
    """The first line of each of artist=, title= and album=."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        for prefix, name in (("artist=", "artist"), ("title=", "track_title"), ("album=", "album_title")):
            if line.startswith(prefix):
                out.setdefault(name, line[len(prefix) :])
    return out


def metadata_columns(lines: DataFrame, id_col: str, line_col: str, number_col: str) -> DataFrame:
    """id, artist, title, album: the first line of each prefix, as columns."""
    own = [F.min(F.when(F.startswith(F.col(line_col), F.lit(f"{n}=")), F.struct(number_col, F.expr(f"substring({line_col}, {len(n) + 2})").alias("v")))).getField("v").alias(n) for n in ("artist", "title", "album")]
    return lines.groupBy(id_col).agg(*own)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def wave_headers(files: DataFrame) -> DataFrame:
    """path with the header's columns and a status (null if the file is sound) of (path, content)."""
    names = [x.split()[0] for x in HEADER.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    out.append((path, *vars(parse_wave(bytes(content))).values(), None))
                except WaveError as e:
                    out.append((path, *[None] * (len(names) - 1), e.args[0]))
            yield pd.DataFrame(out, columns=["path", *names]).astype(object)

    return files.mapInPandas(run, f"path string, {HEADER}")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WaveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]

    def partitions(self):
        import pyarrow.fs as pafs

        fs, at = pafs.FileSystem.from_uri(self.root) if "://" in self.root else (pafs.LocalFileSystem(), self.root)
        info = fs.get_file_info(at)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True))
        return [_File(x.path) for x in sorted(found, key=lambda x: x.path) if x.type == pafs.FileType.File and x.path.lower().endswith(".wav")] or [_File("")]

    def read(self, part):
        import pyarrow.fs as pafs

        if not part.path:
            return
        fs = pafs.FileSystem.from_uri(self.root)[0] if "://" in self.root else pafs.LocalFileSystem()
        with fs.open_input_file(part.path) as f:
            data = f.read()
        try:
            wave = parse_wave(data)
            yield (part.path, *vars(wave).values(), None, data[wave.data_pos : wave.data_pos + wave.data_size])
        except WaveError as e:
            yield (part.path, *[None] * 11, e.args[0], None)


class WaveDataSource(DataSource):
    """``format("echofold_wav")``: a row for each .wav file under a path, with its PCM bytes."""

    @classmethod
    def name(cls):
        return "echofold_wav"

    def schema(self):
        return f"path string, {HEADER}, pcm binary"

    def reader(self, schema):
        return WaveReader(self.options)
