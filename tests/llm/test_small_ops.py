"""URL filters, licence scans, WARC, packing and fingerprints on small fixtures."""

import gzip
import hashlib
import itertools
import re
import textwrap
from importlib.resources import files

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echofold.llm import catalog, op2_packing, op5_fingerprint, op7_warc, op8_license_scan, op10_url_filter, warc
from tests.compare import same

ODD = [(None, "a text without an id"), (1, None), (2, ""), (3, "word"), (3, "word"), (4, "wörd wörd\nCopyright 2020 X\n" * 3), (5, "x " * 50_000), (6, "ñ" * 40), (7, "a b c d e f g")]


def docs(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "clash", 0.5) for i, t in rows], "doc_id long, text string, digest string, score double")


@pytest.mark.parametrize("name", ["op1_decontaminate", "op7_warc", "op8_license_scan", "op10_url_filter"])
def test_oracle(name, spark, sf_dir, duck):
    same(catalog.queries()[name](spark, sf_dir), duck, catalog.oracle_sql()[name])


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 5000), max_size=300), st.sets(st.integers(0, 5000), max_size=3000))
def test_cascade_is_exact(listed, universe):
    def hashes(s):
        return op10_url_filter._hashes([str(x) for x in sorted(s)])

    mine, others = listed & universe, universe - listed
    levels = op10_url_filter.build_cascade(hashes(mine)[0], hashes(others)[0])
    if mine:
        assert op10_url_filter.look_up(levels, *hashes(mine)).all()
    if others:
        assert not op10_url_filter.look_up(levels, *hashes(others)).any()


def test_cascade_in_several_passes(spark):
    df = spark.createDataFrame([(i, f"h{i % 700}") for i in range(2000)] + [(None, "")], "page_id long, host string")
    listed = spark.createDataFrame([(f"h{i}",) for i in range(0, 900, 3)] + [(None,)], "key string")
    out = op10_url_filter.listed_by_cascade(df, "host", listed, shard_keys=50, limit=100).collect()
    assert len(out) == 2001 and all(r["listed"] == (r["host"] != "" and int(r["host"][1:]) % 3 == 0) for r in out)


def test_url_edges(spark):
    urls = [None, "no scheme", "http://X.Example.ORG/en/12?q", "a://b://c/d", "http://example.org", "http://evil.com/de/x#y", "http://notexample.org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "key string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in op10_url_filter.filter_urls(pages, none).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("x.example.org", "/en/12", "example.org/en/1", "block")
    assert got[3] == ("b:", "//c/d", None, "allow") and got[4] == ("example.org", "", None, "allow")
    assert got[5][2:] == ("com/de/", "block") and got[6][2:] == ("org/", "allow")


def test_empty_tables(spark):
    assert op10_url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "key string")).count() == 0
    none = docs(spark, [])
    assert op8_license_scan.scan_licenses(none, op8_license_scan.known_digests(spark)).count() == 0
    assert op2_packing.pack_documents(none).count() == 0
    assert op5_fingerprint.compare_edited(op5_fingerprint.dealt_with_next(none)).count() == 0


def test_licences(spark):
    mit = op8_license_scan.MIT
    rows = [(1, mit), (2, f"Copyright (c) 2020 Somebody\n\n{mit.upper().replace(',', ' ,')}"), (3, mit + " more"), (4, "Intro\nreleased under the MIT licence\n..."), (5, None), (6, "(c) 2001\n!!!"), (7, "")]
    got = {r["doc_id"]: r for r in op8_license_scan.scan_licenses(docs(spark, rows), op8_license_scan.known_digests(spark)).collect()}
    assert [got[i]["license_id"] for i in range(1, 8)] == ["MIT", "MIT", None, None, None, None, None]
    assert got[4]["notices"] == "MIT" and got[1]["text_digest"] == got[2]["text_digest"] and got[5]["text_digest"] == got[6]["text_digest"] == got[7]["text_digest"]
    assert op8_license_scan.scan_licenses(docs(spark), op8_license_scan.known_digests(spark)).count() == len(ODD)


def test_entire_licences_are_known(spark):
    """Entire texts as other projects hold them: reflowed, with an owner's line, with and without the appendix."""
    at = files("echofold.llm").joinpath("licenses")
    text = {f.name.removesuffix(".txt"): f.read_text() for f in at.iterdir()}
    reflowed = {k: "  ".join(v.split(" ")).replace("\n", "\r\n") for k, v in text.items()}
    terms = text["Apache-2.0"].split("   APPENDIX:")[0]
    bsd = "BSD 3-Clause License\n\nCopyright (c) 2020, Somebody\nAll rights reserved.\n\n" + text["BSD-3-Clause"].replace("HOLDER OR", "OWNER OR")
    gpl = text["GPL-2.0-only"].replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA")
    cases = [*((k.removesuffix(".regents"), v) for k, v in reflowed.items()), ("Apache-2.0", terms), ("BSD-3-Clause", bsd), ("GPL-2.0-only", gpl), (None, terms[:-400])]
    got = {r["doc_id"]: r["license_id"] for r in op8_license_scan.scan_licenses(docs(spark, [(i, t) for i, (_, t) in enumerate(cases)]), op8_license_scan.known_digests(spark)).collect()}
    assert [got[i] for i in range(len(cases))] == [k for k, _ in cases]


def wrapped(text, width):
    """Paragraphs filled anew to a width; 0 puts all on one line."""
    if not width:
        return " ".join(text.split())
    return "\n\n".join(textwrap.fill(" ".join(x.split()), width, break_long_words=False, break_on_hyphens=False) for x in re.split(r"\n[ \t]*\n", text))


def test_digests_do_not_depend_on_line_breaks(spark):
    """Every known licence wrapped at several widths, with the owner's line before it."""
    at = files("echofold.llm").joinpath("licenses")
    text = {f.name.removesuffix(".txt"): f.read_text() for f in at.iterdir()} | {"MIT": op8_license_scan.MIT, "ISC": op8_license_scan.ISC}
    del text["BSD-3-Clause.regents"]  # its first line is a notice, which one line can't tell from the rest
    cases = [(k, f"Copyright (c) 2019 somebody\n\n{wrapped(t, n)}") for k, t in text.items() for n in (60, 72, 80, 0)]
    cases += [("MIT", f"MIT License\n\n© Some Body\n\n{wrapped(op8_license_scan.MIT, 50)}"), ("MIT", "# Copyright: 2001-2020 X\n" + op8_license_scan.MIT.replace("OR\nCOPYRIGHT", "OR COPYRIGHT\n"))]
    got = {r["doc_id"]: r for r in op8_license_scan.scan_licenses(docs(spark, [(i, t) for i, (_, t) in enumerate(cases)]), op8_license_scan.known_digests(spark)).collect()}
    assert [got[i]["license_id"] for i in range(len(cases))] == [k for k, _ in cases]
    assert all(len({got[4 * k + n]["text_digest"] for n in range(4)}) == 1 for k in range(len(text)))


def test_large_known_tables_are_shuffled(spark, monkeypatch):
    known, rows = op8_license_scan.known_digests(spark), [(1, op8_license_scan.MIT), (2, "x\nAll rights reserved.\ny"), (3, None)]
    want = sorted(op8_license_scan.scan_licenses(docs(spark, rows), known).collect())
    monkeypatch.setattr(op8_license_scan, "BROADCAST_KNOWN", 3)
    assert sorted(op8_license_scan.scan_licenses(docs(spark, rows), known).collect()) == want and [r["notices"] for r in want] == ["", "ARR", ""]


def test_licence_scan_is_native(spark, sf_dir):
    plan = catalog.queries()["op8_license_scan"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600
    pages = spark.createDataFrame([(1, "http://a/", big), (2, "http://b/\nx", big), (3, None, "small"), (4, "u", "small"), (5, "v", None), (6, "w", big + "!"), (7, "x", "z" * 1000)], "page_id long, url string, html string")
    op7_warc.write_archives(op7_warc.archive_records(pages), str(tmp_path / "w"))
    got = {r["record_id"]: r for r in op7_warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert len(got) == 7 and got["<urn:page:1>"]["record_type"] == "revisit" and got["<urn:page:1>"]["refers_to"] == "<urn:page:2>"
    assert bytes(got["<urn:page:2>"]["payload"]) == big.encode() and got["<urn:page:1>"]["payload_bytes"] == 1200
    assert got["<urn:page:2>"]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest() and got["<urn:page:2>"]["target_uri"] == "http://b/ x"
    assert {got[f"<urn:page:{i}>"]["record_type"] for i in (2, 3, 4, 5, 6, 7)} == {"response"}
    # archives of other writers: members of unknown length, and files without compression
    plain = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:page:1>")], b"one\r\n\r\n") + warc.record([("WARC-Type", "metadata"), ("WARC-Record-ID", "<urn:page:2>")], b"two")
    other = tmp_path / "o"
    other.mkdir()
    (other / "a.warc").write_bytes(plain)
    (other / "b.warc.gz").write_bytes(gzip.compress(plain) + gzip.compress(plain))
    assert op7_warc.read_archives(spark, str(other)).count() == 6
    found = op7_warc.read_archives(spark, str(other)).filter("record_type = 'response'").collect()
    assert [bytes(r["payload"]) for r in found] == [b"one\r\n\r\n"] * 3


def test_warc_filters_are_pushed(spark, tmp_path):
    op7_warc.write_archives(op7_warc.archive_records(spark.createDataFrame([(i, "u", "p" * i) for i in range(40)], "page_id long, url string, html string")), str(tmp_path / "w"))
    df = op7_warc.read_archives(spark, str(tmp_path / "w"), payload=False).filter("record_id = '<urn:page:7>' and record_type in ('response', 'revisit')")
    assert [(r["payload_bytes"], r["payload"]) for r in df.collect()] == [(7, None)]
    reader = warc.WarcReader({"path": str(tmp_path / "w")})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert len(list(reader.pushFilters([EqualTo(("record_type",), "x"), GreaterThan(("payload_bytes",), 3)]))) == 1
    assert [x for p in reader.partitions() for x in reader.read(p)] == []


def records_of(spark, ids, n=1200):
    return op7_warc.archive_records(spark.createDataFrame([(i, f"http://h/{i}", f"{i} " + "p" * n) for i in ids], "page_id long, url string, html string"))


def test_warc_jobs_add_up(spark, tmp_path):
    """Two appends, a failed attempt's file, and an overwrite."""
    at = str(tmp_path / "w")
    op7_warc.write_archives(records_of(spark, range(3)), at)
    op7_warc.write_archives(records_of(spark, range(10, 13)), at)
    (tmp_path / "w" / "lost.warc.gz").write_bytes(warc.member(warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:page:99>")], b"x")))
    ids = lambda: sorted(r["record_id"] for r in op7_warc.read_archives(spark, at).collect())
    assert ids() == sorted(f"<urn:page:{i}>" for i in (0, 1, 2, 10, 11, 12))
    spark.dataSource.register(warc.WarcDataSource)
    records_of(spark, [7]).write.format("echofold_warc").mode("overwrite").option("path", at).save()
    assert ids() == ["<urn:page:7>"]
    head = op7_warc.read_archives(spark, at).first()["headers"]
    assert head["content-type"] == "text/html; charset=utf-8" and not head["warc-date"].startswith("1970")


def test_warc_files_are_split(spark, tmp_path):
    at = str(tmp_path / "w")
    spark.dataSource.register(warc.WarcDataSource)
    r = np.random.default_rng(3)
    pages = spark.createDataFrame([(i, "u", r.bytes(700).hex()) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    op7_warc.archive_records(pages).write.format("echofold_warc").mode("append").option("mark", "1000").option("path", at).save()
    reader = warc.WarcReader({"path": at, "split": "20000"})
    pieces = reader.partitions()
    assert len(pieces) >= 3 and all(a.end == b.start for a, b in zip(pieces, pieces[1:], strict=False) if a.path == b.path)
    found = [[x[0] for x in reader.read(p)] for p in pieces]
    assert min(map(len, found)) > 0 and sorted(x for own in found for x in own) == sorted(f"<urn:page:{i}>" for i in range(60))
    df = spark.read.format("echofold_warc").option("split", "20000").load(at)
    assert df.rdd.getNumPartitions() == len(pieces) and df.count() == 60


@pytest.mark.parametrize("value, want", [("md5:d41d8cd98f00b204e9800998ecf8427e", "md5:d41d8cd98f00b204e9800998ecf8427e"), ("sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ", "da39a3ee5e6b4b0d3255bfef95601890afd80709"), ("SHA1:DA39A3EE5E6B4B0D3255BFEF95601890AFD80709", "da39a3ee5e6b4b0d3255bfef95601890afd80709"), ("sha256:abc", "sha256:abc"), ("sha1:!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!", "sha1:!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!"), (None, None), ("d41d8cd98f00b204e9800998ecf8427e", "d41d8cd98f00b204e9800998ecf8427e")])
def test_digests_of_other_writers(value, want):
    assert warc.hex_digest(value) == want


def test_single_member_archives_are_streamed(tmp_path):
    """30 MB of rejected payloads in one gzip member, in a few MB of memory."""
    import tracemalloc

    big = b"".join(warc.record([("WARC-Type", "response" if i % 10 else "metadata"), ("WARC-Record-ID", f"<r{i}>"), ("WARC-Payload-Digest", "md5:d41d8cd98f00b204e9800998ecf8427e")], bytes([i % 251]) * 300_000) for i in range(100))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(big, 1) + gzip.compress(b"") + gzip.compress(warc.record([("WARC-Type", "metadata"), ("WARC-Record-ID", "<last>")], b"z")))
    reader = warc.WarcReader({"path": str(tmp_path / "a.warc.gz"), "payload": "false"})
    reader.wanted.values["warc-type"] = {"metadata"}
    del big
    tracemalloc.start()
    got = [x[0] for p in reader.partitions() for x in reader.read(p)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [f"<r{i}>" for i in range(0, 100, 10)] + ["<last>"] and peak < 4_000_000
    whole = warc.WarcReader({"path": str(tmp_path / "a.warc.gz")})
    assert [len(x[-1]) for p in whole.partitions() for x in whole.read(p)] == [300_000] * 100 + [1]
    (tmp_path / "cut.warc.gz").write_bytes((tmp_path / "a.warc.gz").read_bytes()[:20_000])
    cut = warc.WarcReader({"path": str(tmp_path / "cut.warc.gz")})
    with pytest.raises(ValueError, match="cut short"):
        [x for p in cut.partitions() for x in cut.read(p)]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_warc_of_odd_pages(spark, tmp_path, limit):
    """No ids, repeated rows, a large payload, columns with clashing names; recurring digests broadcast and shuffled."""
    big = "é" * 2_000_000
    rows = [(None, None, "a"), (None, "u", "b" * 1000), (1, "u", big), (1, "u", big), (2, "u", big), (3, "u", "b" * 1000), (4, "u", None)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, response int")
    op7_warc.write_archives(op7_warc.archive_records(pages, limit=limit), str(tmp_path / "w"))
    got = sorted((r["record_id"], r["record_type"], r["refers_to"] or "", r["payload_bytes"]) for r in op7_warc.read_archives(spark, str(tmp_path / "w")).collect())
    page = lambda i: f"<urn:page:{i}>"
    want = [(page(""), "response", "", 1), (page(""), "revisit", page(3), 1000), *[(page(1), "revisit", page(2), 4_000_000)] * 2, (page(2), "response", "", 4_000_000), (page(3), "response", "", 1000), (page(4), "response", "", 0)]
    assert got == sorted(want)


def test_warc_of_nothing(spark, tmp_path):
    op7_warc.write_archives(op7_warc.archive_records(spark.createDataFrame([], "page_id long, url string, html string")), str(tmp_path / "w"))
    assert op7_warc.read_archives(spark, str(tmp_path / "w")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
def test_boundaries_are_best(histogram, k):
    lengths, counts = np.array(sorted(histogram)), np.array([histogram[x] for x in sorted(histogram)])
    got = op2_packing.best_boundaries(lengths, counts, k)
    every = (sorted({*c, lengths[-1]}) for n in range(k) for c in itertools.combinations(lengths.tolist(), n))
    assert len(got) <= k and op2_packing.padding(lengths, counts, got) == min(op2_packing.padding(lengths, counts, b) for b in every)


def test_packing(spark):
    r = np.random.default_rng(4)
    rows = [(int(i), " ".join(["w"] * int(n))) for i, n in enumerate(r.integers(0, 90, 300))] + [(None, None), (900, "w " * 1000), (5, "w")]
    out = op2_packing.pack_documents(docs(spark, rows), max_len=64, n_buckets=4, token_budget=256).collect()
    assert sum(x["n_tokens"] for x in out) == sum(len((t or "").split()) for _, t in rows)
    batches = {}
    for x in out:
        if x["n_tokens"] == 0:
            assert (x["bucket_len"], x["batch"]) == (0, None)
            continue
        assert x["n_tokens"] <= x["bucket_len"] <= 64 and x["start_token"] == 64 * x["piece"]
        batches.setdefault((x["bucket_len"], x["batch"]), []).append(x["slot"])
    for (b, _), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= max(1, 256 // b)
    for b in {k[0] for k in batches}:  # one batch of a bucket at most isn't full
        sizes = [len(v) for (x, _), v in batches.items() if x == b]
        assert sum(n < 256 // b for n in sizes) <= 1 and len(sizes) == len({k[1] for k in batches if k[0] == b}) == 1 + max(k[1] for k in batches if k[0] == b)
    lengths = [x["n_tokens"] for x in out if x["n_tokens"]]
    own, many = np.unique(lengths, return_counts=True)
    assert sorted({x["bucket_len"] for x in out} - {0}) == op2_packing.best_boundaries(own, many, 4)


def test_tokenizer_counts(spark, monkeypatch):
    """Counts kept by word equal those of whole texts."""
    tokenizers = pytest.importorskip("public_tokenizers")
    r = np.random.default_rng(16)
    parts = ["the", " ", "  ", "\n", "\t", "don't", "x1", "42", "Ünï", "日本語", "!?", "\u00a0", "a" * 30, "\x1f", "\u2028", "'s"]
    rows = [(i, "".join(r.choice(parts, r.integers(0, 25)))) for i in range(300)] + [(300 + i, " ".join(r.choice(["the", "house", "x1,", "日本", "don't\nstop"], 40))) for i in range(50)]
    rows += [(900, None), (901, ""), (902, "hello world"), (903, "word " * 50_000)]
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        counter = op2_packing.TokenCounter(f.read())
    assert op2_packing.PATTERN == tokenizers.PATTERN
    want = {i: len(counter.encoding.encode_ordinary(t or "")) for i, t in rows}
    assert {r["doc_id"]: r["n_tokens"] for r in op2_packing.token_counts(docs(spark, rows), vocabulary=path).collect()} == want
    monkeypatch.setattr(op2_packing, "KEPT_WORDS", 3)
    assert {i: counter.count(t or "") for i, t in rows} == want and len(counter) <= 3 and want[902] == 2
    for size in (1, 7):  # texts parted at every, and at some, spaces between words
        monkeypatch.setattr(op2_packing, "PART_CHARS", size)
        assert {i: counter.count(t or "") for i, t in rows} == want


def brute_signature(text):
    cp = op5_fingerprint.code_points(text)
    with np.errstate(over="ignore"):
        return op5_fingerprint.signature(cp)


def test_fingerprints_follow_edits():
    r = np.random.default_rng(5)
    text = " ".join("".join(r.choice(list("abcdefghij"), 5)) for _ in range(300))
    near = lambda t: op5_fingerprint.likeness(brute_signature(text), brute_signature(t))
    other = " ".join("".join(r.choice(list("abcdefghij"), 5)) for _ in range(300))
    words = text.split()
    assert near(text) == 1 and near(other) < 0.05
    assert 1 > near(text[:900] + "X" + text[901:]) > near(text[:1350] + other[1350:]) > 0.3
    assert near(" ".join(reversed(words))) < 0.2, "order counts, not only content"
    assert not brute_signature("").any() and brute_signature("a").all() and brute_signature("ab" * 5).all()
    repeated = op5_fingerprint.likeness(brute_signature("abcdefgh " * 3), brute_signature("abcdefgh " * 30))
    assert repeated < 0.9, "repeats count"


@pytest.mark.parametrize("per_range", [1, 3, 2000])
def test_fingerprint_query(spark, monkeypatch, per_range):
    monkeypatch.setattr(op5_fingerprint, "ROWS_PER_RANGE", per_range)
    rows = [(i * i % 101, f"text {i} ñé " * (i % 7)) for i in range(40)]
    rows = sorted({i: t for i, t in rows}.items()) + [(5000, None)]
    got = {r["doc_id"]: r for r in op5_fingerprint.compare_edited(op5_fingerprint.dealt_with_next(docs(spark, rows[::-1]))).collect()}
    assert len(got) == len(rows)
    with np.errstate(over="ignore"):
        for k, (i, t) in enumerate(rows):
            t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
            edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
            assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert got[i]["fingerprint"] == op5_fingerprint.to_hex(brute_signature(t)) and got[i]["edited_fingerprint"] == op5_fingerprint.to_hex(brute_signature(edited))
            assert got[i]["near_next"] == op5_fingerprint.likeness(brute_signature(t), brute_signature(nxt))


M64 = (1 << 64) - 1


def plain_mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def plain_signature(text):
    """Order MinHash by its definition, in whole numbers and dictionaries: 64 slots, two occurrence-numbered 8-mers each, in text order."""
    p1, p2, p3, p4 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93
    c = [ord(x) for x in text]
    if not c:
        return [0] * 64
    if len(c) < 8:
        one = len(c)
        for x in c:
            one = plain_mix((one * p1 + x) & M64)
        mers = [one]
    else:
        pair = lambda a, b: (a * p1 + b) & M64
        four = lambda i: (pair(c[i], c[i + 1]) * p2 + pair(c[i + 2], c[i + 3])) & M64
        mers = [plain_mix((four(i) * p3 + four(i + 4)) & M64) for i in range(len(c) - 7)]
    low = (1 << 64) - (1 << 24)
    seen, slots = {}, {}
    for place, m in enumerate(mers):
        m &= low
        number = seen.get(m, 0)
        seen[m] = number + 1
        name = plain_mix((m + number * p4) & M64) & low
        slots.setdefault(name >> 58, []).append((name, place))
    values = {}
    for slot, own in slots.items():
        chosen = [name for name, _ in sorted(sorted(own)[:2], key=lambda x: x[1])]
        v = 0
        for name in (chosen + [0])[:2]:
            v = plain_mix((v * p2 + name) & M64)
        values[slot] = v
    out = []
    for s in range(64):
        far = next(d for d in range(64) if (s + d) % 64 in values)
        v = values[(s + far) % 64]
        out.append((plain_mix((v + far * p3) & M64) if far else v) % 65535 + 1)
    return out


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abñ日 "), max_size=120))
def test_fingerprints_against_plain_numbers(text):
    assert brute_signature(text).tolist() == plain_signature(text)


def test_long_fingerprints_against_plain_numbers():
    r = np.random.default_rng(15)
    for n in (1000, 20_000):
        text = "".join(r.choice(list("abcdefgh "), n))
        assert brute_signature(text).tolist() == plain_signature(text)


def test_very_long_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.example.org/en/1" + "x" * 500_000), (2, "http://" + "h" * 100_000 + ".com/de/")], "page_id long, url string")
    got = {r["page_id"]: r for r in op10_url_filter.filter_urls(pages, spark.createDataFrame([], "key string")).collect()}
    assert (got[1]["rule"], len(got[1]["path"]), got[2]["rule"]) == ("example.org/en/1", 500_005, "com/de/")


def test_fingerprints_of_odd_rows(spark):
    out = op5_fingerprint.compare_edited(op5_fingerprint.dealt_with_next(docs(spark))).collect()
    assert len(out) == len(ODD) and sum(r["doc_id"] is None for r in out) == 1
    assert docs(spark, ODD[:1]).transform(op5_fingerprint.dealt_with_next).transform(op5_fingerprint.compare_edited).first()["near_next"] == 1
    assert op5_fingerprint.fingerprints(docs(spark)).filter(F.length("fingerprint") == 256).count() == len(ODD)
