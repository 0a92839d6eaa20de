"""Decontamination, near duplicates, quality, language and toxicity on small fixtures."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echofold.llm import catalog, common, op1_decontaminate, op3_near_dedup, op4_quality, op6_language, op9_toxicity
from tests.compare import same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def brute_hits(words, items, window=13):
    hit, found = set(), set()
    for name, own in items:
        n = min(window, len(own))
        for p in range(len(own) - n + 1 if n else 0):
            for q in range(len(words) - n + 1):
                if words[q : q + n] == own[p : p + n]:
                    hit |= set(range(q, q + n))
                    found.add(name)
    return hit, found


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=4), st.lists(st.sampled_from("abcd"), max_size=60), st.integers(1, 5))
def test_automaton_against_brute_force(items, words, window):
    index = op1_decontaminate.ItemIndex([(str(i), " ".join(x).encode()) for i, x in enumerate(items)], window)
    spans, found = index.match([w.encode() for w in words])
    hit, want = brute_hits(words, [(i, x) for i, x in enumerate(items)], window)
    assert {i for a, b in spans for i in range(a, b)} == hit and found == want


def test_decontamination(spark):
    item = "Eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn"
    bench = spark.createDataFrame([(10, item), (2, "short one"), (2, "short one"), (3, None), (4, "?!"), (None, "xx yy zz")], "item_id long, text string")
    rows = [(1, f"before, {item.upper().replace('Ü', 'ü').replace('Ö', 'ö')}! after"), (2, "a SHORT-one b"), (3, None), (4, ""), (5, " ".join(f"w{i}" for i in range(500)) + f" {item} tail"), (6, item[:-12]), (None, "xx yy zz"), (7, "clean")]
    got = {r["doc_id"]: r for r in op1_decontaminate.find_spans(docs(spark, rows), bench).collect()}
    assert got[1]["n_hit"] == 14 and got[1]["item_ids"] == ["10"] and got[2]["item_ids"] == ["2"] and got[2]["n_hit"] == 2
    assert (got[3]["n_words"], got[4]["n_words"], got[7]["n_hit"]) == (0, 0, 0) and got[6]["n_hit"] in (12, 0, 13) and got[None]["item_ids"] == [""]
    kept = {r["doc_id"]: r for r in op1_decontaminate.decontaminate(docs(spark, rows), bench).collect()}
    assert set(kept) == {3, 4, 5, 6, 7} - ({6} if got[6]["n_hit"] else set())
    assert kept[5]["text"] == " ".join(f"w{i}" for i in range(500)) + "  tail" and kept[5]["n_chars"] == len(kept[5]["text"]) and kept[7]["text"] == "clean"
    small = {r["doc_id"]: (r["n_hit"], r["item_ids"]) for r in op1_decontaminate.find_spans(docs(spark, rows), bench, limit=10).collect()}
    assert small == {i: (r["n_hit"], r["item_ids"]) for i, r in got.items()}, "several blocks"
    assert op1_decontaminate.find_spans(docs(spark, rows), bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert op1_decontaminate.find_spans(docs(spark, []), bench).count() == 0


def brute_components(rows, n, similarity=0.8):
    sets = {i: set(op3_near_dedup.shingle_set((t or "").encode(), n).tolist()) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = sorted(sets)
    for k, a in enumerate(own):
        for b in own[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 100 * similarity * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def corpus(seed, n=260):
    """Families of copies, near copies of all degrees, a passage in many documents, and odd texts."""
    r = np.random.default_rng(seed)
    word = lambda: "".join(r.choice(list("abcdefghijklmnop"), 4))
    base = [word() for _ in range(80)]
    passage = [word() for _ in range(30)]
    rows = []
    for i in range(n):
        kind = r.integers(0, 6)
        if kind <= 1:
            t = list(base)
            for p in r.integers(0, 80, r.integers(0, 6)):
                t[p] = word()
        elif kind == 2:
            t = passage + [word() for _ in range(r.integers(1, 60))]
        elif kind == 3:
            t = base[: r.integers(50, 81)]
        elif kind == 4:
            t = [word() for _ in range(r.integers(0, 6))]
        else:
            t = rows[r.integers(0, len(rows))][1].split() if rows else []
        rows.append((int(i * 7919 % 10_007), " ".join(t)))
    return [*rows, (20_001, None), (20_002, "")]


@pytest.mark.parametrize("seed, list_rows, block, hot, part", [(1, 64, 512, 1000, 1024), (2, 4, 16, 1000, 5), (3, 20, 7, 3, 1), (4, 2, 512, 1, 1024)])
def test_components_against_brute_force(spark, monkeypatch, seed, list_rows, block, hot, part):
    monkeypatch.setattr(op3_near_dedup, "LIST_ROWS", list_rows)
    monkeypatch.setattr(op3_near_dedup, "BLOCK", block)
    monkeypatch.setattr(op3_near_dedup, "HOT", hot)
    monkeypatch.setattr(op3_near_dedup, "FAMILY_PART", part)
    rows = corpus(seed)
    got = {r["doc_id"]: r for r in op3_near_dedup.near_duplicates(docs(spark, rows), n=4).collect()}
    want = brute_components(rows, 4)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (want[i] == i) for i, r in got.items())
    kept = {r["doc_id"] for r in op3_near_dedup.deduplicate(docs(spark, rows), n=4).collect()}
    assert kept == {i for i, c in want.items() if c == i}


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "A  b\tC\nd e"), (3, None), (4, "   "), (5, "a b"), (6, "a  b"), (7, "x " * 30_000)]
    got = op3_near_dedup.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert by[1] == (1, 1, True) and by[2] == (1, 1, False) and by[6] == (1, 5, False) and by[3] == (0, 3, True) and by[4] == (0, 4, True) and by[7] == (1, 7, True) and by[None][2]
    assert op3_near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicates_against_sql(spark, sf_dir, duck):
    same(catalog.queries()["op3_near_dedup"](spark, sf_dir), duck, catalog.oracle_sql()["op3_near_dedup"])


def plain_grams(text):
    """The five characters that end at each one, as tuples."""
    low = re.sub(r"[\x00-\x20\xa0]+", " ", re.sub("[0-9]", "0", (text or "").lower()))
    c = ["^"] * 4 + list(low)
    return [tuple(c[i : i + 5]) for i in range(len(low))]


def brute_kneser_ney(train):
    """Probabilities by the textbook recursion over dictionaries of tuples."""
    top = Counter()
    for t in train:
        top.update(plain_grams(t))
    adjusted = {5: top}
    for size in range(4, 0, -1):
        adjusted[size] = Counter(g[1:] for g in adjusted[size + 1])
    discount = {s: op4_quality.discounts(Counter(c.values())) for s, c in adjusted.items()}
    after = {s: defaultdict(list) for s in adjusted}
    for s, c in adjusted.items():
        for g, n in c.items():
            after[s][g[:-1]].append(n)
    types = len(adjusted[1])

    def p(gram):
        if not gram:
            return 1 / (types + 1)
        s, own = len(gram), after[len(gram)].get(gram[:-1])
        if not own:
            return p(gram[1:])
        cut = lambda n: discount[s][min(n, 3) - 1]
        n = adjusted[s].get(gram, 0)
        return ((n - cut(n)) / sum(own) if n else 0) + sum(map(cut, own)) / sum(own) * p(gram[1:])

    return p


@pytest.mark.parametrize("limit", [10**9, 300])
@pytest.mark.parametrize("letters", ["abcdé", "жзийλμν", "".join(chr(c) for c in range(0x4E00, 0x4E00 + 40)) + "\U0001F600\U0001F601"])
def test_quality_model_against_brute_force(spark, limit, letters):
    r = np.random.default_rng(6)
    texts = [" ".join("".join(r.choice(list(letters), r.integers(1, 6))) for _ in range(30)) for _ in range(12)]
    p = brute_kneser_ney(texts[:8])
    model, unknown = op4_quality.model_table(op4_quality.count_grams(docs(spark, list(enumerate(texts[:8])))))
    odd = [*texts, "Zebra 42 !!\n\n ok", "", None, "漢字 ab", texts[0] * 40, texts[0]]
    got = {x["doc_id"]: x for x in op4_quality.perplexity_sums(docs(spark, list(enumerate(odd))), model, unknown, limit).collect()}
    for i, t in enumerate(odd):
        own = plain_grams(t)
        assert got[i]["n_tokens"] == len(own) and got[i]["n_distinct"] == len(set(own))
        assert math.isclose(got[i]["log_prob"], sum(math.log(p(g)) for g in own), rel_tol=1e-4, abs_tol=1e-3)


def test_quality_tells_junk(spark, sf_dir):
    r = np.random.default_rng(8)
    clean = [(i, " ".join(r.choice(["the", "house", "river", "stone", "light", "under"], 60))) for i in range(120)]
    junk = [(1000 + i, "".join(r.choice(list("#$%&*XQZ"), 200))) for i in range(5)]
    labels = spark.createDataFrame([(i, 1) for i in range(120)] + [(1000, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in op4_quality.judge_quality(docs(spark, [*clean, *junk, (2000, None), (2001, "")]), labels).collect()}
    assert not any(got[i]["kept"] for i, _ in junk) and sum(got[i]["kept"] for i, _ in clean) >= 114
    assert not got[2000]["kept"] and got[2001]["perplexity"] is None
    nothing = op4_quality.judge_quality(docs(spark, clean[:3] + [(9, "")]), labels.limit(0)).collect()
    assert sorted(x["kept"] for x in nothing) == [False, True, True, True]
    assert op4_quality.judge_quality(docs(spark, []), labels).count() == 0


def test_quality_tells_repeated_words(spark):
    r = np.random.default_rng(9)
    words = ["".join(r.choice(list("abcdefghij"), 5)) for _ in range(300)]
    clean = [(i, " ".join(r.choice(words, int(r.integers(30, 400))))) for i in range(200)]
    loops = [(1000 + i, clean[i][1][:60] + f" {w}" * 120) for i, w in enumerate(words[:8])] + [(1100 + i, f"{clean[i][1][:50]}.\n" * 30) for i in range(8)]
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in op4_quality.judge_quality(docs(spark, [*clean, *loops]), labels).collect()}
    assert sum(got[i]["kept"] for i, _ in clean) >= 190
    assert any(got[i]["perplexity"] <= got[i]["threshold"] for i, _ in loops), "perplexity alone keeps them"
    assert not any(got[i]["kept"] for i, _ in loops)


def test_language(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = op6_language.op6_language(spark, "/root/testdata/sf0.01").join(frame.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(out) > 200 and sum(r["lang"] == r["lang_pred"] for r in out) / len(out) >= 0.98 and all(0 <= r["score"] <= 1 for r in out)
    model = op6_language.fit(frame)
    odd = docs(spark, [(1, None), (2, ""), (3, "12 345 !?"), (4, "e"), (None, "the and of the"), (6, "日本語")])
    got = {r["doc_id"]: r for r in op6_language.identify(odd.withColumn("score", F.lit("clash")), model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] != "und" and got[6]["lang_pred"] != "und" and got[1]["score"] == 0
    assert {r["lang_pred"] for r in op6_language.identify(odd, op6_language.fit(odd.limit(0))).collect()} == {"und"}
    assert op6_language.identify(odd.limit(0), model).count() == 0


def test_language_learns_from_long_texts(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    want, got = op6_language.fit(frame, 10**9), op6_language.fit(frame, 10)
    assert got.languages == want.languages and np.array_equal(got.vocabulary, want.vocabulary) and np.allclose(got.weights, want.weights, atol=1e-4)
    rows = [(i, "abc " * 30, "x") for i in range(40)] + [(100 + i, "abd " * 30 + "e" * 70, "x") for i in range(400)] + [(600, "xyz " * 40, "long")]
    mixed = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = op6_language.training_sample(mixed, per_class=20, train_chars=130)
    assert sorted(y for _, y in sample) == ["long"] + ["x"] * 20 and all(isinstance(t, str) for t, y in sample if y == "x")
    many = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(420)], "doc_id long, text string, lang string")
    assert len({y for _, y in op6_language.training_sample(many)}) == 420


def brute_grams(text):
    low = ["*" if not c.isalpha() else c for c in text.lower()]
    return {tuple(low[i : i + n]) for n in (1, 2, 3) for i in range(len(low) - n + 1)}


def brute_scores(sample, texts):
    """Kernel ridge regression with all texts as landmarks: sets, a kernel by its definition, one solve a language."""
    own = [brute_grams(t) for t, _ in sample]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    k = np.array([[kernel(a, b) for b in own] for a in own])
    languages = sorted({y for _, y in sample})
    values, vectors = np.linalg.eigh(k)
    good = values > 1e-8 * values.max()
    half = (vectors[:, good] / np.sqrt(values[good]))
    phi = np.column_stack((k @ half, np.ones(len(sample))))
    weight = np.array([len(sample) / len(languages) / sum(z == y for _, z in sample) for _, y in sample])
    out = []
    for language in languages:
        y = np.array([1.0 if z == language else -1.0 for _, z in sample])
        ridge = np.diag([1e-3 * len(sample)] * (phi.shape[1] - 1) + [1e-9 * len(sample)])
        w = np.linalg.solve(phi.T @ np.diag(weight) @ phi + ridge, phi.T @ (weight * y))
        out.append([np.append(np.array([kernel(brute_grams(t), b) for b in own]) @ half, 1) @ w for t in texts])
    return languages, np.array(out).T


def test_language_scores_against_brute_force():
    """Scripts of many letters, repeated rows and very long texts."""
    r = np.random.default_rng(12)
    alphabets = {"zh": [chr(c) for c in range(0x4E00, 0x4E00 + 900)], "ja": [chr(c) for c in range(0x3041, 0x3090)] + [chr(c) for c in range(0x4F00, 0x4F00 + 300)], "ru": list("абвгдежзийклмнопрстуфхцчшщъыьэюя"), "el": list("αβγδεζηθικλμνξοπρστυφχψω"), "en": list("abcdefghijklmnopqrstuvwxyz")}
    draw = lambda y, n: " ".join("".join(r.choice(alphabets[y], 4)) for _ in range(n))
    sample = [(draw(y, 30), y) for y in alphabets for _ in range(8)]
    sample += sample[:2]
    texts = [draw(y, 12) for y in alphabets for _ in range(6)] + [draw("ru", 20_000), sample[0][0], sample[0][0], "x 1", "한국어", draw("zh", 3) + draw("en", 4)]
    languages, want = brute_scores(sample, texts)
    model = op6_language.train(sample)
    names, scores = op6_language.scorer(model)(texts)
    assert model.languages == languages
    assert np.allclose(scores, np.clip((want.max(1) + 1) / 2, 0, 1), atol=1e-4)
    assert [n for n, w in zip(names, want, strict=True) if np.ptp(np.sort(w)[-2:]) > 1e-3] == [languages[w.argmax()] for w in want if np.ptp(np.sort(w)[-2:]) > 1e-3]
    assert names[:30] == [y for y in alphabets for _ in range(6)] and scores[31] == scores[32]


def test_language_learns_over_400_languages(spark):
    r = np.random.default_rng(13)
    rows = []
    for k in range(420):
        own = [chr(c) for c in r.choice(np.arange(0x4E00, 0x9FA0), 12, replace=False)]
        rows += [(4 * k + i, " ".join("".join(r.choice(own, 5)) for _ in range(12)), f"l{k}") for i in (0, 1, 3)]
    model = op6_language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 420
    names, _ = op6_language.scorer(model)([t for _, t, _ in rows])
    assert np.mean([n == y for n, (_, _, y) in zip(names, rows, strict=True)]) > 0.95


def test_toxicity_held_out(spark):
    at = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{at}/labels.parquet")
    got = op9_toxicity.op9_toxicity(spark, at).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in got) / len(got)
    clean = [r for r in got if not r["toxic"]]
    assert len(got) > 1000 and right >= 0.97 and sum(r["predicted"] for r in clean) / len(clean) <= 0.01


def test_toxicity_grammar(spark):
    scorer = op9_toxicity.Scorer(op9_toxicity.train([]))
    toxic = ["You are an idiot.", "Today was nice. you worthless moron", "What a pathetic loser!", "I will kill you."]
    fine = ["", None, "A sunny day.", "You are not an idiot.", "He said you are an idiot.", 'The word "idiot" is old.', "The virus can kill cells.", "idiotic"]
    assert all(scorer.score(t) >= 0.7 for t in toxic), [scorer.score(t) for t in toxic]
    assert all(scorer.score(t) < 0.7 for t in fine), [scorer.score(t) for t in fine]
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    frame = docs(spark, [(None, "idiot"), (1, None), (2, ""), (3, "you idiot " * 20_000)]).withColumn("toxicity", F.lit("clash"))
    out = {r["doc_id"]: r["toxicity"] for r in op9_toxicity.score_toxicity(frame, op9_toxicity.fit(frame, labels)).collect()}
    assert len(out) == 4 and out[3] >= 0.7 > out[1] == out[2]
    assert op9_toxicity.score_toxicity(frame.limit(0), op9_toxicity.train([])).count() == 0


def brute_kinds(clause, entries):
    """Kinds of a clause's matches by plain loops over its words."""
    words = re.findall(r"[\w']+|[\"“”«»]", clause.lower())
    group = lambda w: "t" if w in op9_toxicity.TARGETS else "n" if w in op9_toxicity.NEGATORS else "r" if w in op9_toxicity.REPORTERS else "q" if w in "\"“”«»" else ""
    match = [next((i for i, e in enumerate(entries) if w == e[0] or not e[1] and w.startswith(e[0])), None) for w in words]
    groups = ["" if i is not None else group(w) for w, i in zip(words, match, strict=True)]
    out = []
    for at, i in enumerate(match):
        if i is None:
            continue
        told = "r" in groups[:at] or groups[:at].count("q") % 2 == 1
        # a trigger reaches so many words; another one starts anew
        near = lambda g, reach, before: any(x == g for x in (groups[max(0, at - reach) : at] if before else groups[at + 1 : at + 1 + reach]))  # noqa: B023, E731
        kind = 3 if told else 2 if near("n", 2, True) else 1 if near("t", 4, True) or near("t", 4, False) else 0
        out.append(kind + 4 * entries[i][2])
    return sorted(out)


def test_toxicity_scores_against_brute_force():
    """Kinds, surprise and score of texts of few words, from the definitions."""
    r = np.random.default_rng(14)
    entries = [("idiot", True, False, 1e-4), ("kill", True, True, 1e-3), ("scum", False, False, 2e-5)]
    grammar = op9_toxicity.Grammar(entries, (2.0, 2.5, 0.2, 0.4, 0.3, 2.4, 0.1, 0.2), -3.5)
    scorer = op9_toxicity.Scorer(grammar)
    pool = ["idiot", "kill", "scum", "scumbags", "you", "he", "not", "never", "said", '"', "the", "house", "idiotic", "Today", "ÉTÉ"]
    for _ in range(300):
        clauses = [" ".join(r.choice(pool, r.integers(1, 12))) for _ in range(r.integers(1, 5))]
        text = ". ".join(clauses)
        counts = Counter()
        for c in clauses:
            for i, e in enumerate(entries):
                for kind, n in Counter(brute_kinds(c, [("", True, False, 1)] * i + [e])).items():
                    counts[i, kind] += n
        n = max(1, len(text.lower().split()))
        total = Counter()
        for (i, kind), k in counts.items():
            expected = entries[i][3] * n
            total[kind] += k * math.log(k / expected) - k + expected if k > expected else 0
        z = -3.5 + sum(math.log2(1 + v) * grammar.weights[kind] for kind, v in total.items())
        assert math.isclose(scorer.score(text), 1 / (1 + math.exp(-z)), rel_tol=1e-9), text


def test_columns_of_any_name_and_long_texts(spark):
    """Names that operators use inside, in several blocks; a text of 300,000 words."""
    item = " ".join(f"w{i}" for i in range(15))
    bench = spark.createDataFrame([(1, item), (2, "zz yy"), (3, "qq")], "item_id long, text string")
    frame = spark.createDataFrame([(1, f"a {item} b", 5, "x", "y"), (2, "n " * 300_000 + item, 6, "x", "y"), (2, "zz yy", 7, None, None), (2, "zz yy", 7, None, None)], "doc_id long, text string, n_hit int, __words string, __items string")
    for limit in (10, 1 << 20):
        out = op1_decontaminate.find_spans(frame, bench, limit=limit).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["__words"]) for r in out if r["n_words"] > 2) == [(1, 17, 15, "x"), (2, 300_015, 15, "x")]
        assert [(r["n_hit"], r["item_ids"], r["__items"]) for r in out if r["n_words"] == 2] == [(2, ["2"], None)] * 2
    near = frame.select("doc_id", "text", F.lit(1).alias("__id"), F.lit("k").alias("key"))
    assert {r["doc_id"] for r in op3_near_dedup.deduplicate(near).collect()} == {1, 2} and op3_near_dedup.deduplicate(near).columns == ["doc_id", "text", "__id", "key"]
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0)], "doc_id long, quality int")
    own = frame.select("doc_id", "text", F.lit("en").alias("lang"), F.lit(1).alias("perplexity"), F.lit(2).alias("__trusted"))
    assert op4_quality.judge_quality(own, labels).count() == 4
    tox = op9_toxicity.score_toxicity(frame.withColumn("toxicity", F.lit(9)), op9_toxicity.train([])).collect()
    assert len(tox) == 4 and tox[0]["__words"] == "x" and len({r["toxicity"] for r in tox if r["n_hit"] == 7}) == 1


def test_large_id_lists_are_shuffled(spark, monkeypatch):
    """Past the broadcast limits of near duplicates and quality, results are the same."""
    rows = corpus(5, 120)
    labels = spark.createDataFrame([(i, 1) for i, _ in rows[::2]], "doc_id long, quality int")
    want = [sorted(tuple(r) for r in op3_near_dedup.deduplicate(docs(spark, rows), n=4).collect()), sorted(map(str, op4_quality.judge_quality(docs(spark, rows), labels).collect()))]
    monkeypatch.setattr(op3_near_dedup, "BROADCAST_IDS", 0)
    monkeypatch.setattr(op4_quality, "BROADCAST_IDS", 0)
    assert [sorted(tuple(r) for r in op3_near_dedup.deduplicate(docs(spark, rows), n=4).collect()), sorted(map(str, op4_quality.judge_quality(docs(spark, rows), labels).collect()))] == want


def test_transducers_compose():
    neg, target = op9_toxicity.Transducer.after(op9_toxicity.NEG, 2, 2), op9_toxicity.Transducer.after(op9_toxicity.TARGET, 4, 4)
    word = [0, 2, 0, 1, 0, 0, 0, 0, 0]
    both = neg.compose(target).run(word)
    assert both == [a | b for a, b in zip(neg.run(word), target.run(word), strict=True)] and both == [0, 0, 2, 2, 4, 4, 4, 4, 0]


def test_shared_helpers(spark):
    assert common.words("Ab-C9_é\x7fß".encode()) == [b"ab", b"c9", "é".encode(), "ß".encode()]
    total = sum(math.comb(64, i) * 0.8**i * 0.2 ** (64 - i) for i in range(common.binomial_floor(64, 0.8, 1e-9)))
    assert total <= 1e-9
    assert hashlib.sha256(b"2,10"[:0]).hexdigest() == op1_decontaminate.items_digest([])


def test_toxicity_learns_threats_that_are_aimed():
    """A word that clean texts hold as often, but not near a target, becomes a threat."""
    r = np.random.default_rng(21)
    plain = "house river garden window mountain letter summer music silver paper".split()
    some = lambda n: " ".join(r.choice(plain, n))
    rows = [(f"{some(12)}. i will smack you {some(3)}.", 1) for _ in range(60)] + [(f"{some(12)}. waves smack the rocks {some(3)}.", 0) for _ in range(60)]
    rows += [(f"{some(9)}. {some(4)} you {some(4)}. i will {some(4)}.", 0) for _ in range(120)]
    grammar = op9_toxicity.train(rows)
    assert [e[0] for e in grammar.entries if e[2] and e[0] not in op9_toxicity.THREATS] == ["smack"]
    scorer = op9_toxicity.Scorer(grammar)
    assert scorer.score("tomorrow i will smack you there") >= 0.7
    assert all(scorer.score(t) < 0.7 for t in ("the waves smack the rocks", "nobody will smack you", 'he said "i will smack you"'))


def test_toxicity_training_rows_are_chosen_among_those_that_qualify(spark, monkeypatch):
    """Long toxic texts don't thin the short ones out; repeated rows and nulls do no harm."""
    long = "x" * (op9_toxicity.TRAIN_CHARS + 1)
    rows = [(i, long if i % 4 else f"short {i}") for i in range(400)] + [(0, "short 0"), (401, None), (None, "no id")]
    frame = docs(spark, rows)
    labels = spark.createDataFrame([(i, 1) for i in range(402)] + [(0, 0), (None, 1)], "doc_id long, toxic int")
    able = [t for i, t in rows if i is not None and t and t != long and zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(t for t, _ in op9_toxicity.training_rows(frame, labels)) == sorted(able)
    monkeypatch.setattr(op9_toxicity, "TOXIC_ROWS", 20)
    assert len(op9_toxicity.training_rows(frame, labels)) == 20
