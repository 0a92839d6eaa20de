"""Toxicity by a weighted finite-state grammar that scores matched clauses.

An Aho-Corasick automaton finds the lexicon's insults and threats; only clauses that hold one are read further.
A clause's words become classes (insult, threat, target, negator, reporting word, quote mark, other), and five
transducers are composed over them: *insult* and *threat* (which mark a match), *reported speech* (what follows a reporting
word, or stands in quotes), *negation* (the next few words after a negator) and *target* (the next few words after a person, in
either direction).  The marks that the composed transducer gives a match are its kind, and each kind has a weight.  A document's score is the logistic of the weighted, log-damped
surprise of its matches.

Lexicon: short word lists of four languages, and entries learned from labelled rows.  Words and word beginnings that
are far more frequent in toxic documents are taken greedily, each for the documents that no entry before it
explains, so that what merely surrounds insults isn't learned.  These are insults.  Of the toxic documents that none of them
explains, words near a target are taken in the same way, against words near a target in other documents: these are threats, words
that tell something only when they are aimed at someone.  An entry keeps its rate in clean texts: matches count by
how much more there are than a clean text of that length has by chance.  Weights are a logistic regression that
shrinks towards the grammar's own weights, so that kinds without evidence keep them.  Training takes a bounded sample:
at most ``TOXIC_ROWS`` and ``OTHER_ROWS`` of the labelled rows that have a text of at most ``TRAIN_CHARS`` characters, by a hash of the id.

Scale: the lexicon is bounded; scoring is one narrow pass over whole texts.

Edge cases: a null or empty text has no match and gets the score of one; a document with several labels is
toxic if any says so; null labels are ignored.  Without labelled rows the word lists and the grammar's weights stand.  Repeated rows get
equal scores.  An empty table gives no rows.  Further columns pass through; very long texts are read whole, and only the clauses that
hold a match become words.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm.common import crc_mod, cut, spread, table

INSULTS = """idiot idiots moron morons imbecile scum scumbag loser losers pathetic worthless disgusting stupid vermin
crétin débile ordure salaud abruti minable idiote dummkopf arschloch abschaum versager trottel idiota imbécil
basura estúpido estúpida gilipollas""".split()
THREATS = """kill hurt destroy strangle tuer détruire étrangler umbringen vernichten erwürgen matar destruir estrangular""".split()
TARGETS = """you your they them he she him her his people everyone tu toi vous ils elles lui eux du dich ihr euch sie er
tú ti ustedes ellos ellas él ella usted""".split()
NEGATORS = """not no never isn't aren't wasn't don't doesn't nobody neither nor pas jamais aucun nicht kein keine niemals nunca ningún jamás""".split()
REPORTERS = """said says say told called calls claimed reported quoted wrote dit disait appelle sagte sagt nannte nennt dijo dice llamó llama""".split()
TOXIC_ROWS, OTHER_ROWS, TRAIN_CHARS = 2000, 6000, 20_000
MIN_DOCS, MIN_ODDS, PREFIXES = 4, 10.0, range(3, 9)
#: Least shares of toxic ones among the texts that hold an entry, for two rounds of choosing.
LEAST_SHARES = (0.9, 0.2)
#: Clean words and chance matches that listed words are taken to have had before any are seen.
LISTED_WORDS, LISTED_MATCHES = 50_000, 0.5
THRESHOLD = 0.7

#: Classes of words that the transducers read.
OTHER, TARGET, NEG, REPORT, QUOTE, INSULT, THREAT = CLASSES = range(7)
WORD = re.compile(r"[\w']+|[.!?;:\n|]|[\"“”«»]")
PARTS, CLAUSES = re.compile(r"\w+"), re.compile(r"[.!?;:\n|]")
TARGET_WORDS = frozenset(TARGETS)
CLAUSE_END = frozenset(".!?;:\n|")
QUOTES = frozenset("\"“”«»")
#: Kinds of matches and the grammar's own weights for them.
KINDS = ("insult", "insult_target", "insult_negated", "insult_reported", "threat", "threat_target", "threat_negated", "threat_reported")
INTERCEPT, WEIGHTS = -4.0, (2.4, 2.8, 0.2, 0.4, 0.3, 2.4, 0.1, 0.2)
REACH_NEG, REACH_TARGET = 2, 4


class Transducer:
    """A deterministic transducer over word classes: ``step(state, class) -> (state, mark)``."""

    def __init__(self, start: int, arcs: dict[tuple[int, int], tuple[int, int]]):
        self.start, self.arcs = start, arcs

    @classmethod
    def after(cls, trigger: int, reach: int, bit: int) -> Transducer:
        """Marks the ``reach`` words that follow a trigger."""
        return cls(0, {(s, c): (reach, 0) if c == trigger else (max(0, s - 1), bit if s else 0) for s in range(reach + 1) for c in CLASSES})

    @classmethod
    def at(cls, match: int, bit: int) -> Transducer:
        """Marks the words of a class."""
        return cls(0, {(0, c): (0, bit if c == match else 0) for c in CLASSES})

    @classmethod
    def reported(cls, bit: int) -> Transducer:
        """Marks the rest of a clause after a reporting word, and what stands between quote marks.  States: open, told, quoted, both."""
        arcs = {}
        for s in range(4):
            for c in CLASSES:
                to = s | 1 if c == REPORT else s ^ 2 if c == QUOTE else s
                arcs[s, c] = (to, bit if s else 0)
        return cls(0, arcs)

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same classes; marks are joined.  Only states that can be reached are built."""
        names, arcs, todo = {(self.start, other.start): 0}, {}, [(self.start, other.start)]
        while todo:
            pair = todo.pop()
            for c in CLASSES:
                (a, x), (b, y) = self.arcs[pair[0], c], other.arcs[pair[1], c]
                if (a, b) not in names:
                    names[a, b] = len(names)
                    todo.append((a, b))
                arcs[names[pair], c] = (names[a, b], x | y)
        return Transducer(0, arcs)

    def run(self, classes: list[int]) -> list[int]:
        state, out = self.start, []
        for c in classes:
            state, mark = self.arcs[state, c]
            out.append(mark)
        return out


REPORTED, NEGATED, TARGETED, INSULTING, THREATENING = 1, 2, 4, 8, 16
MATCH = Transducer.at(INSULT, INSULTING).compose(Transducer.at(THREAT, THREATENING))
FORWARD = MATCH.compose(Transducer.reported(REPORTED)).compose(Transducer.after(NEG, REACH_NEG, NEGATED)).compose(Transducer.after(TARGET, REACH_TARGET, TARGETED))
BACKWARD = Transducer.after(TARGET, REACH_TARGET, TARGETED)


def kind_of(mark: int) -> int | None:
    """The kind of a match by its marks; None if it is none."""
    if not mark & (INSULTING | THREATENING):
        return None
    return (4 if mark & THREATENING else 0) + (3 if mark & REPORTED else 2 if mark & NEGATED else 1 if mark & TARGETED else 0)


@dataclass
class Grammar:
    """entries: (text, whole word only, threat, matches that a clean text has by chance, a word)."""

    entries: list[tuple[str, bool, bool, float]]
    weights: tuple[float, ...] = WEIGHTS
    intercept: float = INTERCEPT


def surprise(found: float, expected: float) -> float:
    """Poisson deviance of more matches than a clean text of this length has by chance, else 0."""
    return found * math.log(found / expected) - found + expected if found > expected else 0.0


class Scorer:
    def __init__(self, grammar: Grammar):
        import ahocorasick

        self.grammar = grammar
        self.classes = {w: c for c, ws in ((TARGET, TARGETS), (NEG, NEGATORS), (REPORT, REPORTERS)) for w in ws}
        self.automaton = ahocorasick.Automaton()
        for i, (text, *_) in enumerate(grammar.entries):
            self.automaton.add_word(text, i)
        if grammar.entries:
            self.automaton.make_automaton()

    def matches(self, low: str) -> dict[int, int]:
        """Start of each matched word and its entry, the rarest in clean texts."""
        found: dict[int, int] = {}
        if not self.grammar.entries:
            return found
        for end, i in self.automaton.iter(low):
            text, whole, _, rate = self.grammar.entries[i]
            at = end - len(text) + 1
            if at and (low[at - 1].isalnum() or low[at - 1] == "_"):
                continue
            if whole and end + 1 < len(low) and (low[end + 1].isalnum() or low[end + 1] == "_"):
                continue
            if at not in found or rate < self.grammar.entries[found[at]][3]:
                found[at] = i
        return found

    def features(self, text: str | None) -> np.ndarray:
        """Log-damped surprise of each kind of match, over the entries."""
        out = np.zeros(len(KINDS))
        low = (text or "").lower()
        found = self.matches(low)
        if not found:
            return out
        counts: dict[tuple[int, int], int] = defaultdict(int)
        for start, end in self.clauses(low, sorted(found)):
            tokens = list(WORD.finditer(low, start, end))
            entry = [found.get(m.start()) for m in tokens]
            classes = [(THREAT if self.grammar.entries[i][2] else INSULT) if i is not None else QUOTE if m[0] in QUOTES else self.classes.get(m[0], OTHER) for m, i in zip(tokens, entry, strict=True)]
            back = BACKWARD.run(classes[::-1])[::-1]
            for i, mark, other in zip(entry, FORWARD.run(classes), back, strict=True):
                if (kind := kind_of(mark | other)) is not None:
                    counts[i, kind] += 1
        n = max(1, len(low.split()))
        for (i, kind), k in counts.items():
            out[kind] += surprise(k, self.grammar.entries[i][3] * n)
        return np.log2(1 + out)

    @staticmethod
    def clauses(low: str, places: list[int]) -> Iterator[tuple[int, int]]:
        """The clauses that hold the places, once each."""
        done = -1
        for at in places:
            if at < done:
                continue
            start, end = at, at
            while start > 0 and low[start - 1] not in CLAUSE_END:
                start -= 1
            while end < len(low) and low[end] not in CLAUSE_END:
                end += 1
            done = end
            yield start, end

    def score(self, text: str | None) -> float:
        z = self.grammar.intercept + float(self.features(text) @ np.array(self.grammar.weights))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def aimed(low: str) -> list[str]:
    """The words of a lower-cased text that stand within reach of a target, in either direction and in its clause."""
    out = []
    for clause in CLAUSES.split(low):
        found = PARTS.findall(clause)
        places = [i for i, w in enumerate(found) if w in TARGET_WORDS]
        near = {j for i in places for j in range(max(0, i - REACH_TARGET), min(len(found), i + REACH_TARGET + 1))}
        out += [found[j] for j in sorted(near) if found[j] not in TARGET_WORDS]
    return out


def learn_entries(toxic: list[str], other: list[str], words_of: Callable[[str], list[str]], beginnings: bool = True) -> tuple[list[tuple[str, bool, float]], set[int]]:
    """Words and beginnings of words that tell toxic texts, found greedily: (text, whole word only, rate in clean texts); and the
    toxic texts that hold one.

    A rate counts the words of those clean texts only that hold a word of the same first three letters: texts of
    the entry's own language, for the most part.
    """

    def features(word: str) -> list[str]:
        return [word + " ", *(word[:n] for n in PREFIXES if beginnings and n <= len(word))]

    # one text's words at a time: all of them together would take many times the texts' size
    bags = lambda texts: (_counted(words_of(t.lower())) for t in texts)
    held: dict[str, int] = defaultdict(int)
    for bag, _ in bags(toxic):
        for f in {f for w in bag for f in features(w)}:
            held[f] += 1
    holds: dict[str, set[int]] = {f: set() for f, n in held.items() if n >= MIN_DOCS}
    del held
    for i, (bag, _) in enumerate(bags(toxic)):
        for w in bag:
            for f in features(w):
                if f in holds:
                    holds[f].add(i)
    docs, often, words_with = [defaultdict(int), defaultdict(int)], [defaultdict(int), defaultdict(int)], [defaultdict(int), defaultdict(int)]
    for y, texts in enumerate((other, toxic)):
        for bag, n in bags(texts):
            inside: dict[str, int] = defaultdict(int)
            for w, k in bag.items():
                for f in features(w):
                    if f in holds:
                        inside[f] += k
            for f, k in inside.items():
                docs[y][f] += 1
                often[y][f] += k
            for head in {w[:3] for w in bag}:
                words_with[y][head] += n
    rate = lambda f, y: (often[y][f] + 0.5) / (words_with[y][f[:3].strip()] + 1000)
    share = lambda f: docs[1][f] / (docs[1][f] + docs[0][f])
    telling = {f: v for f, v in holds.items() if rate(f, 1) >= MIN_ODDS * rate(f, 0)}
    chosen: dict[str, None] = {}
    for least in LEAST_SHARES:
        open_ = {f: set(v) for f, v in telling.items() if share(f) >= least}
        while open_:
            best = max(open_, key=lambda f: (len(open_[f]), -docs[0][f], len(f), f))
            covered = open_.pop(best)
            chosen[best] = None
            for f in list(open_):
                open_[f] -= covered
                if len(open_[f]) < MIN_DOCS:
                    del open_[f]
    return [(f.rstrip(), f.endswith(" "), rate(f, 0)) for f in chosen], set().union(*(holds[f] for f in chosen))


def _counted(found: list[str]) -> tuple[dict[str, int], int]:
    bag: dict[str, int] = defaultdict(int)
    for w in found:
        bag[w] += 1
    return bag, len(found)


def fit_weights(scorer: Scorer, texts: list[str], labels: list[int]) -> Grammar:
    """Logistic regression that shrinks towards the grammar's own weights."""
    x = np.column_stack([np.ones(len(texts)), np.array([scorer.features(t) for t in texts]).reshape(len(texts), len(KINDS))])
    y, prior = np.array(labels, float), np.array([INTERCEPT, *WEIGHTS])
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    w[1:] = np.maximum(w[1:], 0)
    return Grammar(scorer.grammar.entries, tuple(w[1:].tolist()), float(w[0]))


def train(rows: list[tuple[str, int]]) -> Grammar:
    """From (text, label) pairs in a fixed order; equal texts count once."""
    rows = list(dict.fromkeys(rows))
    toxic, other = [t for t, y in rows if y], [t for t, y in rows if not y]
    learned, threats = [], []
    if toxic and other:
        learned, told = learn_entries(toxic, other, PARTS.findall)
        if len(rest := [t for i, t in enumerate(toxic) if i not in told]) >= MIN_DOCS:
            threats = [w for w, _, _ in learn_entries(rest, other, aimed, beginnings=False)[0]]
    listed = {w: (w, True, threat) for threat, ws in ((True, threats), (False, INSULTS), (True, THREATS)) for w in ws}
    seen = [{w: 0 for w in listed}, {w: 0 for w in listed}]
    total = [1, 1]
    for t, y in rows:
        bag, n = _counted(PARTS.findall(t.lower()))
        total[y] += n
        for w in bag.keys() & listed.keys():
            seen[y][w] += bag[w]
    # a listed insult that clean texts hold about as often as toxic ones tells nothing
    useful = lambda w: not seen[0][w] or seen[0][w] * total[1] <= 0.3 * seen[1][w] * total[0]
    kept = [(w, whole, threat, (seen[0][w] + LISTED_MATCHES) / (total[0] + LISTED_WORDS)) for w, whole, threat in listed.values() if threat or useful(w)]
    grammar = Grammar(kept + [(w, whole, False, rate) for w, whole, rate in learned if w not in listed])
    return fit_weights(Scorer(grammar), [t for t, _ in rows], [y for _, y in rows]) if rows else grammar


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> list[tuple[str, int]]:
    """A bounded sample of (text, label), by the smallest hashes of the ids among the rows that qualify."""
    own = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & (crc_mod(F.col(id_col), 3) != 1)).groupBy(id_col).agg(F.max("toxic").alias("__y"))
    fit_ = docs.select(id_col, "text").filter(F.length("text") <= TRAIN_CHARS)
    # ids and labels alone are shuffled, and written once for the two reads that follow
    able = cut(fit_.select(id_col).join(own, id_col).groupBy(id_col, "__y").count())
    counts = {r["__y"]: r["n"] for r in able.groupBy("__y").agg(F.sum("count").alias("n")).collect()}
    share = F.lit(0.0)
    for y, most in ((0, OTHER_ROWS), (1, TOXIC_ROWS)):
        share = F.when(F.col("__y") == y, min(1.0, 1.2 * most / max(1, counts.get(y, 0)))).otherwise(share)
    # about 1.2 * (OTHER_ROWS + TOXIC_ROWS) rows at most, whatever the input
    taken = able.withColumn("__at", spread(F.col(id_col), "toxicity")).filter(F.col("__at") < share)
    found = fit_.join(F.broadcast(taken), id_col)
    rows = sorted((r["__y"], r["__at"], r["text"]) for r in found.select("__y", "__at", "text").collect())
    return [(t, 0) for y, _, t in rows if y == 0][:OTHER_ROWS] + [(t, 1) for y, _, t in rows if y == 1][:TOXIC_ROWS]


def score_toxicity(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """``docs`` with toxicity, from 0 to 1 (a column of this name is replaced)."""
    held = docs.sparkSession.sparkContext.broadcast(grammar)
    df = docs.drop("toxicity")
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            values = [scorer.score(t.as_py()) for t in b.column(names.index(text_col))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.float64())], names=[*names, "toxicity"])

    return df.mapInArrow(run, type(df.schema)(list(df.schema)).add("toxicity", "double"))


def fit(docs: DataFrame, labels: DataFrame) -> Grammar:
    return train(training_rows(docs, labels))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
