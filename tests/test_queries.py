"""Every query of the engine against its SQL on the smallest tables."""

import hashlib
import itertools

import numpy as np
import pytest

from echofold.functions import constants as C
from echofold.plans.oracles import ORACLES
from echofold.plans.queries import QUERIES
from tests.compare import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark, sf_dir, duck):
    same(QUERIES[name](spark, sf_dir), duck, ORACLES[name])


def test_document_pairs_against_brute_force(spark, tmp_path):
    """All pairs by the reference's sizes; near copies of similarity 0.6 and more are among them."""
    r = np.random.default_rng(7)
    texts = {}
    for i in range(12):
        base = [f"w{x}" for x in r.integers(0, 5000, 240)]
        texts[10 * i] = " ".join(base)
        for k in range(1, 6):  # each change touches three shingles
            changed = list(base)
            for at in range(2, 3 * k * 4, 3):
                changed[at * 6 % 240] = f"x{i}.{k}.{at}"
            texts[10 * i + k] = " ".join(changed)
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    ranks, sets, hashes = C.rank_table(8192).astype(np.uint8), {}, {}
    for i, t in texts.items():
        w = t.split()
        sets[i] = {" ".join(w[k : k + 3]) for k in range(len(w) - 2)}
        hashes[i] = ranks[sorted({int(hashlib.md5(s.encode()).hexdigest()[:8], 16) % 8192 for s in sets[i]})].min(0)
    want, near = set(), set()
    for a, b in itertools.combinations(sorted(texts), 2):
        same = hashes[a] == hashes[b]
        bands, score = int(same.reshape(25, 4).all(1).sum()), int(same.sum())
        if bands >= 2 and score >= 30:
            want.add((a, b, bands, score))
        if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]):
            near.add((a, b))
    got = {tuple(x) for x in QUERIES["pair_scores"](spark, str(tmp_path)).select("query_id", "entry_id", "n_bands", "score").collect()}
    assert got == want
    assert len(near) > 30 and len(near & {x[:2] for x in got}) >= 0.9 * len(near)


def test_audio(spark, sf_dir):
    status = {r["path"]: r["status"] for r in QUERIES["wav_roundtrip"](spark, sf_dir).collect()}
    assert status["text.wav"] == "NOT_A_WAVE_FILE" and status["song0.wav"] is None
    made = {r["path"]: r["n_signatures"] for r in QUERIES["fingerprint_audio"](spark, sf_dir).collect()}
    assert made["silence.wav"] == 0 and made["song1.wav"] > 80
    (found,) = QUERIES["identify_audio"](spark, sf_dir).collect()
    assert (found["filename"], found["artist"], found["track_title"]) == ("song1.wav", "artist 1", "title 1")


def test_stream_windows(spark, sf_dir):
    from echofold.functions.kernels import stream_windows
    from echofold.plans.queries import STREAM_RATE, _chunks

    want = {}
    for r in _chunks(spark, sf_dir).orderBy("stream_id", "seq").collect():
        want.setdefault(r["stream_id"], []).append(r["size"])
    got = {}
    for r in QUERIES["stream_windows"](spark, sf_dir).orderBy("stream_id", "window_no").collect():
        got.setdefault(r["stream_id"], []).append((r["start"], r["end"]))
    assert got == {k: w for k, v in want.items() if (w := stream_windows(v, STREAM_RATE))}


def test_plans(spark, sf_dir):
    """Only the needed columns are read, the index once, and nothing but scores is shuffled."""
    plan = lambda name: QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan("identify_passage") and "html" not in plan("identify_passage")
    scores = plan("entry_scores")  # ranking reads them from files
    assert scores.count("ReadSchema: struct<doc_id:bigint,text:string>") == 1 and scores.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["pair_scores", "lsh_candidates"])
def test_pairs_of_documents_are_not_shuffled(name, spark, sf_dir):
    """They grow with the square of what shares a band: signatures are shuffled, once, and met by no join."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
