"""Language ID by string kernels: blended-spectrum n-gram presence, Nyström landmarks, kernel ridge regression.

The kernel of two texts is the number of n-grams (1 to ``MAX_N`` characters) that both hold, whatever
their frequency, over the root of the product of their own numbers.  N-grams are exact: every letter counts as itself, in lower case;
what isn't a letter is one character.  Training takes a bounded sample of
labelled rows: at most ``PER_CLASS`` of each language, by the smallest hashes of the ids, first of texts of at most
``TRAIN_CHARS`` characters.  Where a language lacks those, longer texts are taken too, whole: executors reduce each to its distinct n-grams, if it
is a landmark, and else to those among the landmarks', so that none reaches the driver.  Every labelled language is a class; past ``SAMPLE_ROWS`` over ``PER_CLASS`` languages
each has fewer rows, but one at least.  Of the rows ``LANDMARKS`` are landmarks; the Nyström map of the others goes to one ridge regression for
each language against the rest.  As the map is linear in a text's presence vector, landmarks and
regression fold into one matrix (n-grams by languages), and a batch of texts is scored by one product.

Scale: the model's size is bounded by the landmarks; scoring is a narrow pass over whole texts.

Very long texts are judged whole, by their distinct n-grams.

Edge cases: a null text, or one without a letter, gets ``und`` and score 0; so does every text if no row
is labelled.  Ties go to the language first in order.  Repeated rows get equal answers.  An empty table gives no rows.
Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm.common import crc_mod, spread, table

MAX_N, PER_CLASS, LANDMARKS, TRAIN_CHARS, RIDGE = 3, 300, 256, 20_000, 1e-3
#: Bits of a character in an n-gram's code, and the character of what isn't a letter: no code point, and not 0, so that sizes differ.
BITS, OTHER = 21, (1 << 21) - 1
CODE_POINTS = 0x110000
#: Texts that are scored by one product, and cells of its matrix at most.
BATCH, CELLS = 256, 1 << 23
#: Rows of all languages together, while each has one.
SAMPLE_ROWS = 400 * PER_CLASS
UND = "und"


@dataclass(frozen=True)
class Held:
    """A long text of a sample, by the hash that finds it again."""

    key: int


#: n-gram codes of long texts by key; or, given a vocabulary, (places in it, number of n-grams).
Finder = Callable[[list[int], "np.ndarray | None"], dict]


@dataclass
class Model:
    languages: list[str]
    letters: bytes  # a bit for each code point
    vocabulary: np.ndarray  # n-gram codes that the landmarks hold, in order
    weights: np.ndarray  # by n-gram and language
    bias: np.ndarray


def letter_bits() -> bytes:
    return np.packbits(np.fromiter((chr(c).isalpha() for c in range(CODE_POINTS)), bool, CODE_POINTS)).tobytes()


def letter_table(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=CODE_POINTS).astype(bool)


def gram_codes(text: str, letters: np.ndarray) -> np.ndarray:
    """The distinct n-grams of 1 to 3 characters, in order; empty if the text has no letter."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    known = letters[cp]
    if not known.any():
        return np.zeros(0, np.int64)
    code = c = np.where(known, cp, OTHER).astype(np.int64)
    found = [c]
    for n in range(1, MAX_N):
        code = code[:-1] << BITS | c[n:]
        found.append(code)
    x = np.sort(np.concatenate(found))
    return x[np.append(True, x[1:] != x[:-1])]


def places(codes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Where the codes stand in the vocabulary, without those that it lacks."""
    at = np.minimum(np.searchsorted(vocabulary, codes), len(vocabulary) - 1)
    return at[vocabulary[at] == codes]


def train(sample: list[tuple[str | Held, str]], find: Finder | None = None) -> Model | None:
    """From (text, language) pairs, in a fixed order."""
    bits = letter_bits()
    letters = letter_table(bits)
    sample = [(t, y) for t, y in sample if isinstance(t, Held) or any(map(str.isalpha, t))]
    if not sample:
        return None
    languages = sorted({y for _, y in sample})
    by_class: dict[str, list[int]] = {y: [] for y in languages}
    for i, (_, y) in enumerate(sample):
        by_class[y].append(i)
    queues, marks = [iter(v) for v in by_class.values()], []
    while queues and len(marks) < max(LANDMARKS, len(languages)):
        for q in list(queues):
            i = next(q, None)
            if i is None:
                queues.remove(q)
            elif len(marks) < max(LANDMARKS, len(languages)):
                marks.append(i)
    long = {sample[i][0].key for i in marks if isinstance(sample[i][0], Held)}
    whole = find(sorted(long), None) if long else {}
    own = [whole[t.key] if isinstance(t, Held) else gram_codes(t, letters) for t in (sample[i][0] for i in marks)]
    vocabulary = np.unique(np.concatenate(own))
    land = np.zeros((len(vocabulary), len(marks)), np.float32)
    for j, codes in enumerate(own):
        land[np.searchsorted(vocabulary, codes), j] = 1 / np.sqrt(len(codes))
    keys = sorted({t.key for t, _ in sample if isinstance(t, Held)})
    among = find(keys, vocabulary) if keys else {}
    k = np.zeros((len(sample), len(marks)))
    for i, (t, _) in enumerate(sample):  # one text's n-grams at a time
        if isinstance(t, Held):
            at, n = among[t.key]
        else:
            codes = gram_codes(t, letters)
            at, n = places(codes, vocabulary), len(codes)
        k[i] = land[at].sum(0, dtype=np.float64) / np.sqrt(n)
    values, vectors = np.linalg.eigh(k[marks])
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.column_stack((k @ root, np.ones(len(sample))))
    y = np.where(np.array([y for _, y in sample])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    balance = np.array([1 / len(by_class[y]) for _, y in sample])[:, None] * len(sample) / len(languages)
    gram = phi.T @ (phi * balance) + RIDGE * len(sample) * np.diag(np.append(np.ones(phi.shape[1] - 1), 1e-6))
    w = np.linalg.solve(gram, phi.T @ (y * balance))
    return Model(languages, bits, vocabulary, (land @ (root @ w[:-1]).astype(np.float32)).astype(np.float32), w[-1].astype(np.float32))


def scorer(model: Model | None):
    """A function of texts: (languages, scores)."""
    if model is None:
        return lambda texts: ([UND] * len(texts), [0.0] * len(texts))
    letters = letter_table(model.letters)
    size = max(1, min(BATCH, CELLS // len(model.vocabulary)))
    x = np.zeros((size, len(model.vocabulary)), np.float32)

    def score(texts: Sequence[str | None] | pa.Array) -> tuple[list[str], list[float]]:
        names, values = [], []
        for start in range(0, len(texts), size):
            part = texts[start : start + size]
            norm, filled = np.ones(len(part), np.float32), []
            for i, t in enumerate(part):  # of an array, one text at a time becomes a Python object
                codes = gram_codes((t.as_py() if isinstance(t, pa.Scalar) else t) or "", letters)
                filled.append(places(codes, model.vocabulary))
                x[i, filled[-1]] = 1
                norm[i] = np.sqrt(len(codes))
            some = norm > 0
            s = x[: len(part)] @ model.weights / np.where(some, norm, 1)[:, None] + model.bias
            for i, at in enumerate(filled):
                x[i, at] = 0
            best = s.argmax(1)
            top = np.clip((s[np.arange(len(part)), best] + 1) / 2, 0, 1)
            names += [model.languages[b] if ok else UND for b, ok in zip(best, some, strict=True)]
            values += [float(v) if ok else 0.0 for v, ok in zip(top, some, strict=True)]
        return names, values

    return score


def _labelled(docs: DataFrame, train_chars: int) -> DataFrame:
    """Rows that can be learned from."""
    rows = docs.filter("lang is not null and text is not null").filter(F.col("text").rlike(r"\p{L}"))
    return rows.select("lang", "text", spread(F.col("doc_id"), "language").alias("__at"), (F.length("text") > train_chars).alias("__long"))


def training_sample(docs: DataFrame, per_class: int = PER_CLASS, train_chars: int = TRAIN_CHARS) -> list[tuple[str | Held, str]]:
    """At most ``per_class`` (text, lang) of each language, by the smallest hashes of their ids; of longer texts, where short ones lack, ``Held`` ones."""
    labelled = _labelled(docs, train_chars)
    counts = {(r["lang"], r["__long"]): r["count"] for r in labelled.groupBy("lang", "__long").count().collect()}
    if not counts:
        return []
    languages = {y for y, _ in counts}
    quota = max(1, min(per_class, SAMPLE_ROWS // len(languages)))
    want = {(y, False): min(quota, counts.get((y, False), 0)) for y in languages}
    want |= {(y, True): min(quota - want[y, False], counts.get((y, True), 0)) for y in languages}
    # more than are wanted, as hashes are spread by chance
    shares = [(y, long, min(1.0, (1.5 * n + 30) / counts[y, long])) for (y, long), n in want.items() if n]
    limits = docs.sparkSession.createDataFrame(shares, "lang string, __long boolean, __share double")
    taken = labelled.join(F.broadcast(limits), ["lang", "__long"]).filter(F.col("__at") < F.col("__share"))
    out: dict[tuple[str, bool], list] = {}
    for r in taken.filter("not __long").select("lang", "__at", "text").collect():
        out.setdefault((r["lang"], False), []).append((r["__at"], r["text"]))

    if any(n for (_, long), n in want.items() if long):
        for r in taken.filter("__long").select("lang", "__at", F.xxhash64("text").alias("key")).collect():
            out.setdefault((r["lang"], True), []).append((r["__at"], Held(r["key"])))
    chosen = {k: sorted(v, key=lambda x: (x[0], x[1].key if k[1] else x[1]))[: want[k]] for k, v in out.items()}
    return [(t, y) for y in sorted(languages) for _, t in sorted(chosen.get((y, False), []) + chosen.get((y, True), []), key=lambda x: x[0])]


def long_grams(docs: DataFrame, keys: list[int], vocabulary: np.ndarray | None, train_chars: int = TRAIN_CHARS) -> dict:
    """What ``Finder`` gives, made on executors."""
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(k,) for k in sorted(set(keys))], "key long")
    rows = _labelled(docs, train_chars).filter("__long").select(F.xxhash64("text").alias("key"), "text").join(F.broadcast(wanted), "key").select("key", "text").dropDuplicates(["key"])
    held = spark.sparkContext.broadcast((letter_bits(), vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = held.value
        letters = letter_table(bits)
        for b in batches:
            own = [gram_codes(t.as_py(), letters) for t in b.column(1)]
            out = [(x if known is None else places(x, known)).astype("<i8").tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array([len(x) for x in own], pa.int64())], names=["key", "found", "n"])

    got = rows.mapInArrow(run, "key long, found binary, n long").collect()
    found = {r["key"]: (np.frombuffer(bytes(r["found"]), "<i8"), r["n"]) for r in got}
    return found if vocabulary is not None else {k: x for k, (x, _) in found.items()}


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    df = docs.drop("lang_pred", "score")
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(held.value)
        for b in batches:
            got, values = score(b.column(names.index(text_col)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string()), pa.array(values, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = type(df.schema)(list(df.schema)).add("lang_pred", "string").add("score", "double")
    return df.mapInArrow(run, schema)


def fit(docs: DataFrame, train_chars: int = TRAIN_CHARS) -> Model | None:
    """Learn from the rows of ``docs`` (doc_id, text, lang) that aren't held out."""
    own = docs.filter(crc_mod(F.col("doc_id"), 4) != 2)
    return train(training_sample(own, train_chars=train_chars), lambda keys, vocabulary: long_grams(own, keys, vocabulary, train_chars))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
