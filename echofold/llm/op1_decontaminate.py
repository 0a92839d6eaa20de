"""Benchmark decontamination with a generalised suffix automaton of the benchmark's items.

The automaton takes the words of every item.  A document's words are streamed through it; at each word
it knows the longest run of words, ending there, that stands in some item.  Runs of ``window`` words or more are
hit, as are whole items that are shorter than the window.  Spans that the runs cover are reported with their
places in the text, and can be cut out; a document whose hit words reach a share of its words is contaminated.

Scale: items are dealt to blocks of at most ``BLOCK_BYTES`` of text, and each block is broadcast for a
narrow pass over the documents; a usual benchmark is one block.  A block's automaton takes about 100 bytes a byte of
items (measured: 102 MB for 1 MB), 400 MB at most, and each worker builds it once, for all its tasks.  Words are parted by the byte and looked up in one
vocabulary first; the automaton sees only runs of word pairs that the items hold.

Edge cases: a null or empty text has no words and is never contaminated; items without words hit nothing; an
item of fewer words than the window counts as one window of that length.  Items with one id count as one; a null item id
counts as the empty text.  Repeated documents are judged one by one.  An empty benchmark hits nothing.  Other
columns of the documents pass through, whatever their names; columns of the results' names are replaced.  Very long texts are
streamed like others, each held whole.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofold.llm.common import WORD_TABLE, cut, table, words

WINDOW = 13
#: Contaminated from this share of hit words: 1 in 20.
SHARE = 20
BLOCK_BYTES = 4 << 20
PAIR_BITS = 22


class SuffixAutomaton:
    """A generalised suffix automaton of sequences of numbers."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _new(self, length: int, nexts: dict[int, int], link: int) -> int:
        self.next.append(nexts)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for the strings of q that end with p's and c."""
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def add(self, sequence: Sequence[int]) -> None:
        state = 0
        for c in sequence:
            state = self.extend(state, c)

    def walk(self, sequence: Sequence[int]) -> Iterator[tuple[int, int]]:
        """For each element the state and length of the longest string of the automaton that ends there."""
        state, n = 0, 0
        nexts, link, length = self.next, self.link, self.length
        for c in sequence:
            to = nexts[state].get(c)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nexts[state].get(c)
            if to is not None:
                state, n = to, n + 1
            yield state, n


class ItemIndex:
    """The items of one block: finds which windows of them stand in a document."""

    def __init__(self, items: Sequence[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.automaton = SuffixAutomaton()
        sequences = []
        for _, text in items:
            sequences.append([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)])
            self.automaton.add(sequences[-1])
        self.shortest = min([window, *(len(s) for s in sequences if s)])
        pairs = np.array([a * len(self.vocabulary) + b for s in sequences for a, b in zip(s, s[1:], strict=False)], np.uint64)
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        self.pairs[self._slot(pairs)] = True
        self.items_at: dict[int, set[int]] = {}
        self.whole_at: dict[int, list[tuple[int, int]]] = {}
        self._window_state: dict[int, int] = {}
        for i, s in enumerate(sequences):
            state = 0
            for state, n in self.automaton.walk(s):
                if n >= window:
                    self.items_at.setdefault(self._at_window(state), set()).add(i)
            if 0 < len(s) < window:
                self.whole_at.setdefault(state, []).append((len(s), i))
        self._chains: dict[int, list[tuple[int, int]]] = {}

    @staticmethod
    def _slot(pairs: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)

    def _at_window(self, state: int) -> int:
        """The state of the last ``window`` words of a longer match."""
        found = self._window_state.get(state)
        if found is None:
            found = state
            while self.automaton.length[self.automaton.link[found]] >= self.window:
                found = self.automaton.link[found]
            self._window_state[state] = found
        return found

    def _short(self, state: int) -> list[tuple[int, int]]:
        """(length, item) of the short items that end a match in this state."""
        found = self._chains.get(state)
        if found is None:
            found, at = [], state
            while at > 0:
                found += self.whole_at.get(at, ())
                at = self.automaton.link[at]
            self._chains[state] = found
        return found

    def match(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans [a, b) that are hit, merged and in order, and the items whose windows occur."""
        n = len(tokens)
        if n < self.shortest or not self.vocabulary:
            return [], set()
        ids = np.fromiter(map(self.vocabulary.get, tokens, repeat(-1)), np.int64, n)
        known = ids >= 0
        if self.shortest > 1:
            linked = known[:-1] & known[1:]
            at = np.flatnonzero(linked)
            if len(at) < self.shortest - 1:
                return [], set()
            linked[at] = self.pairs[self._slot((ids[at] * len(self.vocabulary) + ids[at + 1]).astype(np.uint64))]
            need, tail = self.shortest - 1, 1
        else:
            linked, need, tail = known, 1, 0
        edge = np.flatnonzero(np.diff(np.concatenate(([0], linked.view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a < need:
                continue
            for i, (state, length) in enumerate(self.automaton.walk(ids[a : b + tail].tolist()), a):
                if length >= self.window:
                    spans.append((i - length + 1, i + 1))
                    items |= self.items_at.get(self._at_window(state), set())
                if self.whole_at and length:
                    for m, item in self._short(state):
                        if m <= length:
                            spans.append((i - m + 1, i + 1))
                            items.add(item)
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def char_spans(text: bytes, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Places in code points of word spans."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(WORD_TABLE))]
    chars = lambda a, b: len(text[a:b].decode("utf-8", "replace"))
    out, done, n = [], 0, 0
    for a, b in spans:
        start, end = at[a][0], at[b - 1][1]
        n += chars(done, start)
        size = chars(start, end)
        out.append({"start": n, "end": n + size})
        n, done = n + size, end
    return out


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
WORD_SPANS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
RESULT = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("item_ids", T.ArrayType(T.StringType())), ("spans", T.ArrayType(SPAN))]
#: What passes between blocks, under names that the documents don't have.
BETWEEN = [("__words", WORD_SPANS), ("__items", T.ArrayType(T.StringType()))]
#: The index that a worker holds, by its block: built once for all tasks of a worker.
_HELD: dict[tuple[str, int], ItemIndex] = {}


def _index(block: str, items: Sequence[tuple[str, bytes]], window: int) -> ItemIndex:
    if (block, window) not in _HELD:
        _HELD.clear()
        _HELD[block, window] = ItemIndex(items, window)
    return _HELD[block, window]


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The items' (id, text), in blocks of at most ``limit`` bytes of text (a longer item is its own block)."""
    held, size = [], 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("binary").alias("t")).filter("t is not null").toLocalIterator():
        if held and size + len(r["t"]) > limit:
            yield held
            held, size = [], 0
        held.append((r["i"], bytes(r["t"])))
        size += len(r["t"])
    yield held


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids (sorted) and spans (in code points) of its column text."""
    df = docs.drop(*(n for n, _ in RESULT))
    plain = list(df.schema)
    todo, again = blocks(benchmark, limit), False
    block = next(todo)
    tail = "_" * max((len(c) for c in df.columns), default=0)
    between = [(n + tail, kind) for n, kind in BETWEEN]
    while block is not None:
        held, block = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block)), next(todo, None)
        added = [T.StructField(n, kind) for n, kind in (RESULT if block is None else between)]
        df = (cut(df) if again else df).mapInArrow(_matcher(held, window, again, block is None, [n for n, _ in between]), T.StructType([*plain, *added]))
        again = True
    return df


def _matcher(held, window: int, again: bool, last: bool, between: list[str]):
    """Adds a block's hits to those of the blocks before it; the last block's pass gives the result's columns."""
    pair, place = (pa.list_(pa.struct([(n, pa.int64()) for n in names])) for names in (("a", "b"), ("start", "end")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(*held.value, window)
        for b in batches:
            get = lambda name: b.column(b.schema.get_field_index(name))  # noqa: B023, E731
            old = zip(*(get(n).to_pylist() for n in between), strict=True) if again else repeat(((), ()))
            sizes, hits, items, places = [], [], [], []
            for text, (had, had_items) in zip(get("text").cast(pa.binary()), old, strict=False):
                raw = text.as_py() or b""
                tokens = words(raw)
                hit, found = index.match(tokens)
                if had:
                    hit = merged([*hit, *((x["a"], x["b"]) for x in had)])
                sizes.append(len(tokens))
                hits.append(hit)
                items.append(sorted({index.ids[i] for i in found} | set(had_items)))
                places.append(char_spans(raw, hit) if hit and last else [])
            names = pa.array(items, pa.list_(pa.string()))
            if last:
                out = [pa.array(sizes, pa.int64()), pa.array([sum(y - x for x, y in v) for v in hits], pa.int64()), names, pa.array(places, place)]
            else:
                out = [pa.array([[{"a": x, "b": y} for x, y in v] for v in hits], pair), names]
            keep = [n for n in b.schema.names if n not in between]
            yield pa.RecordBatch.from_arrays([*map(get, keep), *out], names=[*keep, *([n for n, _ in RESULT] if last else between)])

    return run


def contaminated():
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents, and without the hit spans of the others (columns as before).

    Where spans were cut, ``n_chars`` (if there) is the new length.
    """
    found = find_spans(docs, benchmark, window).filter(~contaminated())
    cut_text = F.concat(
        F.aggregate(
            "spans",
            F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("p")),
            lambda acc, s: F.struct(F.concat(acc["t"], F.substring(F.col("text"), acc["p"].cast("int") + 1, (s["start"] - acc["p"]).cast("int"))).alias("t"), s["end"].alias("p")),
            lambda acc: F.concat(acc["t"], F.expr("substring(text, cast(element_at(spans, -1).end as int) + 1)")),
        )
    )
    touched = F.size("spans") > 0
    out = found.withColumn("__new", F.when(touched, cut_text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(touched, F.length("__new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col("__new")).select(docs.columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of each document's hits."""
    found = find_spans(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def items_digest(ids: Sequence[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM bw WHERE len(w) > 0)),
dn AS (SELECT doc_id, w, n FROM dw, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
dwin AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dn)),
hits AS (SELECT d.doc_id, d.p, d.n, i.item_id FROM dwin d JOIN iw i ON d.n = i.n AND d.win = i.win),
cover AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)
"""
