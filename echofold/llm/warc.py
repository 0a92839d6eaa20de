"""A Python data source for WARC archives: ``format("echofold_warc")``.

Reading: archives written here are cut into partitions of about ``split`` bytes, at record borders that their manifest
lists; those of other writers are a partition a file, as nothing tells where their records start.  Filters of equality or IN on
``record_type``, ``record_id``, ``target_uri`` and ``payload_digest`` are taken over by the reader: the header is parsed first.
Where a record is a gzip member that states its own length (as in archives written here), the payload of a record that a
filter rejects, or of any record where option ``payload`` is ``false``, is neither inflated nor decoded.  Other gzip
members are inflated as a stream, of which rejected payloads are dropped piece by piece: memory holds a piece, and
one payload that is wanted.

Writing: a file for each task attempt, one gzip member for each record; each commit lists the files of
the attempts that count in a manifest of its own, so that those of lost attempts are never read and appended jobs add up.
Mode ``overwrite`` takes back the manifests that were there.

Digests labelled ``sha1`` (base 32 or hex) are given as bare lower-case hex; those of other algorithms as they stand.

Paths are opened by pyarrow's file systems: local folders, HDFS and object stores alike.
"""

from __future__ import annotations

import base64
import datetime
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary"
HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest"}
#: Manifests are named by a job each: ``_manifest-<uuid>.json``.
MANIFEST = "_manifest"
#: Bytes of a partition, between places that a manifest lists, and of a piece of a stream; the longest head.
SPLIT, MARK, PIECE, MAX_HEAD = 64 << 20, 4 << 20, 1 << 16, 1 << 20
CRLF = b"\r\n"
#: A gzip header with an extra field ``SL``: the length of the member, 8 bytes.
GZIP_HEAD = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 12) + b"SL" + struct.pack("<H", 8)


def member(record: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    total = len(GZIP_HEAD) + 8 + len(body) + 8
    return GZIP_HEAD + struct.pack("<Q", total) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    return head + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + CRLF + CRLF


def parse_head(head: bytes) -> dict[str, str]:
    """Header names in lower case; folded lines belong to the one before."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def hex_digest(value: str | None) -> str | None:
    """A SHA-1 in base 32 or hex as bare lower-case hex; digests of other algorithms as they are."""
    if value is None:
        return None
    label, _, bare = value.strip().rpartition(":")
    if label.lower() in ("sha1", "sha-1") and len(bare) == 32:
        try:
            return base64.b32decode(bare.upper()).hex()
        except ValueError:
            return value
    return bare.lower() if label.lower() in ("", "sha1", "sha-1") and len(bare) == 40 else value


@dataclass
class Wanted:
    """What the reader takes over: header values by header name, and whether payloads are wanted."""

    values: dict[str, set[str]] = field(default_factory=dict)
    payload: bool = True

    def takes(self, h: dict[str, str]) -> bool:
        for k, v in self.values.items():
            have = h.get(k)
            if (hex_digest(have) if k == "warc-payload-digest" else have) not in v:
                return False
        return True


def row(h: dict[str, str], block: bytes | None) -> tuple:
    size = h.get("x-payload-length")
    return (
        h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-refers-to"), hex_digest(h.get("warc-payload-digest")),
        int(size) if size else int(h.get("content-length", 0)), h, block if h.get("warc-type") != "revisit" else None,
    )


def members(f: pafs.NativeFile, start: int, end: int, wanted: Wanted) -> Iterator[tuple]:
    """Records whose gzip member starts in [start, end)."""
    at = start
    size = f.size()
    while at < min(end, size):
        f.seek(at)
        head = f.read(len(GZIP_HEAD) + 8)
        if head[: len(GZIP_HEAD)] == GZIP_HEAD:
            total = struct.unpack("<Q", head[-8:])[0]
            yield from _one(f, at + len(head), total - len(head) - 8, wanted)
            at += total
        else:
            at += yield from _unsized(f, at, wanted)


def _one(f: pafs.NativeFile, at: int, length: int, wanted: Wanted) -> Iterator[tuple]:
    """A member of known length: the head is inflated first, the rest only if the record is wanted."""
    z, got, left = zlib.decompressobj(-15), b"", length
    f.seek(at)
    while (cut := got.find(b"\r\n\r\n")) < 0:
        piece = z.unconsumed_tail or f.read(min(left, 4096))
        if not z.unconsumed_tail:
            left -= len(piece)
        if not piece:
            raise ValueError("a WARC record's head is cut short")
        got += z.decompress(piece, 2048)
    h = parse_head(got[:cut])
    if not wanted.takes(h):
        return
    block = None
    if wanted.payload:
        n = int(h.get("content-length", 0))
        rest = [got[cut + 4 :], z.decompress(z.unconsumed_tail), z.decompress(f.read(left)) if left else b"", z.flush()]
        block = b"".join(rest)[:n]
        if len(block) < n:
            raise ValueError("a WARC record is cut short")
    yield row(h, block)


class Inflated:
    """The bytes of a gzip member of unknown length, inflated piece by piece."""

    def __init__(self, f: pafs.NativeFile, at: int):
        f.seek(at)
        self.f, self.z, self.held, self.read = f, zlib.decompressobj(31), bytearray(), 0

    def more(self) -> bool:
        if self.z.eof:
            return False
        piece = self.z.unconsumed_tail
        if not piece:
            piece = self.f.read(PIECE)
            self.read += len(piece)
        if not piece:
            raise ValueError("a gzip member is cut short")
        self.held += self.z.decompress(piece, PIECE)
        return True

    def used(self) -> int:
        """Bytes of the file that the member took, once it has ended."""
        return self.read - len(self.z.unused_data)

    def head(self) -> bytes | None:
        """The next record's head; None at the end."""
        while True:
            del self.held[: len(self.held) - len(self.held.lstrip(CRLF))]
            if (cut := self.held.find(b"\r\n\r\n")) >= 0:
                out = bytes(self.held[:cut])
                del self.held[: cut + 4]
                return out
            if len(self.held) > MAX_HEAD:
                raise ValueError("a WARC record's head is too long")
            if not self.more():
                if self.held:
                    raise ValueError("a WARC record's head is cut short")
                return None

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes."""
        while n:
            if not self.held and not self.more():
                raise ValueError("a WARC record is cut short")
            out = bytes(self.held[:n])
            del self.held[:n]
            n -= len(out)
            yield out


def _unsized(f: pafs.NativeFile, at: int, wanted: Wanted):
    """A member of unknown length, of one record or many; returns its length."""
    data = Inflated(f, at)
    while (head := data.head()) is not None:
        h = parse_head(head)
        body, takes = data.pieces(int(h.get("content-length", 0))), wanted.takes(h)
        if takes and wanted.payload:
            yield row(h, b"".join(body))
        else:
            for _ in body:
                pass
            if takes:
                yield row(h, None)
    return data.used()


def plain(f: pafs.NativeFile, wanted: Wanted) -> Iterator[tuple]:
    """Records of an archive that is not compressed: unwanted payloads are skipped by seeking."""
    at, size = 0, f.size()
    while at < size:
        f.seek(at)
        got = b""
        while (cut := got.find(b"\r\n\r\n")) < 0:
            piece = f.read(4096)
            if not piece:
                if not got.strip():
                    return
                raise ValueError("a WARC record's head is cut short")
            got += piece
        h = parse_head(got[:cut])
        n = int(h.get("content-length", 0))
        if wanted.takes(h):
            block = None
            if wanted.payload:
                f.seek(at + cut + 4)
                block = f.read(n)
                if len(block) < n:
                    raise ValueError("a WARC record is cut short")
            yield row(h, block)
        at += cut + 4 + n + 4


class Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int, packed: bool):
        self.path, self.start, self.end, self.packed = path, start, end, packed


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/"):
        uri = "file:///" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.wanted, self.split = options["path"], Wanted(payload=options.get("payload", "true").lower() == "true"), int(options.get("split", SPLIT))

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name not in HEADER_OF:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            key = HEADER_OF[name]
            values = {v for v in values if v is not None}
            self.wanted.values[key] = values & self.wanted.values[key] if key in self.wanted.values else values

    def partitions(self):
        fs, at = open_fs(self.path)
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        inside = [info] if info.type == pafs.FileType.File else [x for x in fs.get_file_info(pafs.FileSelector(at)) if x.type == pafs.FileType.File]
        listed = [x.path for x in inside if info.type != pafs.FileType.File and x.base_name.startswith(MANIFEST)]
        if not listed:
            return [Piece(x.path, 0, x.size, x.path.endswith(".gz")) for x in sorted(inside, key=lambda x: x.path) if x.size and x.path.endswith((".warc", ".warc.gz"))] or [Piece("", 0, 0, True)]
        out = []
        for manifest in listed:
            with fs.open_input_file(manifest) as f:
                for name, size, marks in json.loads(f.read())["files"]:
                    start = 0
                    for end in [*marks, size]:
                        if end - start >= self.split or end == size:
                            out.append(Piece(f"{at}/{name}", start, end, True))
                            start = end
        return sorted(out, key=lambda x: (x.path, x.start)) or [Piece("", 0, 0, True)]

    def read(self, piece):
        if not piece.path:
            return
        fs, _ = open_fs(self.path)
        with fs.open_input_file(piece.path) as f:
            yield from members(f, piece.start, piece.end, self.wanted) if piece.packed else plain(f, self.wanted)


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    marks: list[int]  # where records start, about ``MARK`` bytes apart


class WarcWriter(DataSourceArrowWriter):
    """Rows of record_id, record_type, target_uri, refers_to, payload_digest (hex SHA-1), payload_bytes, payload; content_type if there."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.mark, self.overwrite = options["path"], int(options.get("mark", MARK)), overwrite

    def write(self, iterator):
        fs, at = open_fs(self.path)
        fs.create_dir(at, recursive=True)
        name, size, marks = f"{uuid.uuid4().hex}.warc.gz", 0, []
        now = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        columns = ("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload")
        with fs.open_output_stream(f"{at}/{name}", compression=None) as out:
            for b in iterator:
                kinds = b.column(b.schema.get_field_index("content_type")).to_pylist() if "content_type" in b.schema.names else [None] * len(b)
                for (rid, kind, uri, refers, sha, n, payload), content in zip(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns), strict=True), kinds, strict=True):
                    heads = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", now), ("Content-Type", content or "application/octet-stream")]
                    if uri is not None:
                        heads.append(("WARC-Target-URI", " ".join(uri.split())))
                    if refers is not None:
                        heads += [("WARC-Refers-To", refers), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                    heads += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha)).decode()), ("X-Payload-Length", str(n))]
                    if size - (marks[-1] if marks else 0) >= self.mark:
                        marks.append(size)
                    packed = member(record(heads, b"" if kind == "revisit" else bytes(payload or b"")))
                    out.write(packed)
                    size += len(packed)
        return Written(name, size, marks)

    def _manifests(self, fs: pafs.FileSystem, at: str) -> list[str]:
        return [x.path for x in fs.get_file_info(pafs.FileSelector(at)) if x.base_name.startswith(MANIFEST)]

    def commit(self, messages):
        fs, at = open_fs(self.path)
        fs.create_dir(at, recursive=True)
        before = self._manifests(fs, at) if self.overwrite else []
        with fs.open_output_stream(f"{at}/{MANIFEST}-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps({"files": sorted([m.name, m.size, m.marks] for m in messages if m and m.size)}).encode())
        for x in before:
            fs.delete_file(x)

    def abort(self, messages):
        fs, at = open_fs(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{at}/{m.name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "echofold_warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool):
        return WarcWriter(self.options, overwrite)
