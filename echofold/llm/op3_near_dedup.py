"""Near duplicates by bottom-k MinHash sketches, exact in their links.

A document's set is its distinct word shingles, each one 64-bit hash; its sketch is the ``K`` smallest hashes, of this one
hash function.  Documents with equal sets are one class, and one of them stands for it.

*Inverted lists* of retained values yield candidate pairs.  Of two sets with similarity s or more, each of the
smallest values of their union is common with probability s, so lists of the ``r`` first values miss a pair with
probability (1 - s)^r: r is chosen for ``MISS``.  Values in more than ``LIST_ROWS`` sketches are *frequent*; their lists would yield
pairs by the square.  A document uses its first infrequent values instead, more of them the larger its
frequent share is, as a link may spend its differences on infrequent shingles only.  *Union-sketch estimation* then drops
pairs whose estimate is lower than ``MISS`` allows for, and the *exact* Jaccard similarity of full sets decides.

Documents with too few infrequent values (families of thousands of near copies) are compared within their first
frequent lists, which are merged where their smallest id, the pivot, is the same: first with the pivot, which connects most
of a family; then those without a link to it with the whole family, in blocks of bounded size, each pair of blocks in a
task of its own, which compares full sets by matrix products and gives out links only.  No list is cut, and no pair is
dropped unless a bound says it can't link; the work grows as a family's size times its members without a link to the pivot.

Connected components: large-star and small-star steps until nothing changes.  Components, links and sketches
stay in DataFrames; each round is written to the shared folder.

Edge cases: null and empty texts have empty sets, link with nothing and stay.  A text with fewer words than a shingle is one
shingle.  Equal sets link.  Rows that repeat an id are judged each by its own text; equal rows stay or go together.  Rows without
an id link with nothing and stay.  Ties can't arise: the smallest id stands for a component.  Empty tables give no rows.
``near_duplicates`` reads no other columns than doc_id and text; ``deduplicate`` passes them on, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm.common import binomial_floor, cut, mix64, table

WORDS, SIMILARITY = 5, 0.8
K, LIST_ROWS, MISS = 64, 64, 1e-9
#: Documents of a block of a family, and elements that its matrices hold at a time.
BLOCK, VOCABULARY = 512, 4096
BROADCAST_IDS = 1_000_000
#: Keys with more than one in ``HOT`` rows are joined where their rows are; a family's members meet its pivot in parts of this size.
HOT, FAMILY_PART = 1000, 1024
FOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of UTF-8 text, A to Z lower-cased, words parted by ASCII white space."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        if len(words) < n:
            s = np.array([len(words)], np.uint64)
            for x in h:
                s = mix64(s * FOLD + x)
        else:
            s = h[: len(h) - n + 1].copy()
            for j in range(1, n):
                s = s * FOLD + h[j : len(h) - n + 1 + j]
            s = mix64(s)
    return np.unique(s.view(np.int64))


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the whole set; null if empty), sketch (its K smallest hashes, in order)."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("__raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, digest, sketch = [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py() or b"", n)
                size.append(len(s))
                digest.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                sketch.append(s[:K])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "sketch"])

    return df.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketch array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """id, elements (the whole set) of the documents in ``ids``."""
    few = ids.count() <= BROADCAST_IDS
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("__raw")).join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [shingle_set(t.as_py() or b"", n) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["id", "elements"])

    return own.mapInArrow(run, "id long, elements array<long>")


def _keys_needed(share: Column, similarity: float) -> Column:
    """How many infrequent values miss a linked pair with probability ``MISS``, if they are ``share`` of a set."""
    return F.when(share > 1 - similarity + 1e-9, F.ceil(math.log(MISS) / F.log(F.lit(1 - similarity + 1e-12) / share))).otherwise(F.lit(1 << 30)).cast("int")


def _like_sizes(a: Column, b: Column, similarity: float) -> Column:
    return (F.least(a, b) >= similarity * F.greatest(a, b) - 1e-6) if similarity else F.lit(True)


def candidates(reps: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) that pass the estimate, and (key, id) lists of the documents with too few infrequent values.

    ``reps``: id, n, sketch.
    """
    postings = reps.select("id", F.explode("sketch").alias("key"))
    frequent = postings.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > LIST_ROWS)
    # only infrequent values are carried on: a family's members would each carry nearly all of their values otherwise
    marks = without_keys(postings, frequent).groupBy("id").agg(F.collect_list("key").alias("rare"))
    keyed = reps.join(marks, "id", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<long>")))
    keyed = keyed.withColumn("often", F.array_except("sketch", "rare")).withColumn("rare", F.array_intersect("sketch", "rare"))
    keyed = keyed.withColumn("need", _keys_needed(F.size("rare") / F.size("sketch"), similarity))
    keyed = cut(keyed.select("id", "n", "rare", "often", "need"))

    keys = keyed.select("id", "n", F.explode(F.slice("rare", 1, F.greatest(F.col("need"), F.lit(1)))).alias("v"))
    left, right = keys.select("v", F.col("id").alias("a"), F.col("n").alias("na")), keys.select("v", F.col("id").alias("b"), F.col("n").alias("nb"))
    met = left.join(right, "v").filter((F.col("a") < F.col("b")) & _like_sizes(F.col("na"), F.col("nb"), similarity))
    overlaps = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap"))

    sketch = reps.select("id", "sketch")
    both = overlaps.join(sketch.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(sketch.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    both = both.withColumn("u", union).withColumn("common", F.size(F.array_intersect(F.array_intersect("u", "sa"), F.col("sb"))))
    enough = F.when(F.size("u") < K, F.col("common") >= similarity * F.size("u") - 1e-6).otherwise(F.col("common") >= binomial_floor(K, similarity, MISS))
    pairs = cut(both.filter(enough).select("a", "b"))

    first = math.ceil(math.log(MISS) / math.log(1 - similarity))
    crowded = keyed.filter((F.size("often") > 0) & (F.size("rare") < F.col("need")))
    return pairs, cut(crowded.select(F.explode(F.slice("often", 1, first)).alias("key"), "id"))


def parted(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hot and the other ones of ``keys`` (key, c: its number of rows, others): hot ones have more than one in ``HOT`` of all
    rows, so that they are fewer than ``HOT`` and can be broadcast."""
    keys = cut(keys)
    total = keys.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    return keys.filter(F.col("c") * HOT > total).drop("c"), keys.filter(F.col("c") * HOT <= total).drop("c")


def without_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` whose key isn't among ``keys`` (key, c).  Rows of hot keys go where they are; the others shuffle."""
    hot, cold = parted(keys)
    return rows.join(F.broadcast(hot), "key", "left_anti").join(cold, "key", "left_anti")


def by_key(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` joined with ``keys`` (key, c: its number of rows, others) by key.  Rows of hot keys stay where they are; the others shuffle."""
    hot, cold = parted(keys)
    rest = rows.join(F.broadcast(hot.select("key")), "key", "left_anti")
    return rows.join(F.broadcast(hot), "key").unionByName(rest.join(cold, "key"))


def families(lists: DataFrame) -> DataFrame:
    """(key, id) lists merged by their smallest ids, which become the keys: the lists of one family hold much the same documents."""
    pivots = lists.groupBy("key").agg(F.min("id").alias("p"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    return by_key(lists, pivots).select(F.col("p").alias("key"), "id").distinct()


def pivot_links(lists: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of the members of families with the smallest id, whose set has a copy for each part of a large family."""
    parts = lists.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    parts = parts.select("key", "c", F.ceil(F.col("c") / FAMILY_PART).cast("int").alias("parts"))
    pairs = by_key(lists, parts).filter("id <> key").select(F.col("key").alias("a"), F.col("id").alias("b"), F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    copies = parts.select(F.col("key").alias("id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    firsts = copies.join(sets, "id").select(F.col("id").alias("a"), "part", F.col("elements").alias("ea"))
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("eb")), "b").join(firsts, ["a", "part"])
    return alike(both, similarity)


def compare_block(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets, by products of incidence matrices, some thousand elements at a time."""
    flat = [np.concatenate(v) for v in (x, y)]
    owner = [np.repeat(np.arange(len(v)), [len(e) for e in v]) for v in (x, y)]
    common = np.intersect1d(*flat)
    out = np.zeros((len(x), len(y)), np.float32)
    place = [np.searchsorted(common, f) for f in flat]
    for k in range(2):
        there = (place[k] < len(common)) & (common[np.minimum(place[k], max(0, len(common) - 1))] == flat[k]) if len(common) else np.zeros(len(flat[k]), bool)
        place[k], owner[k] = place[k][there], owner[k][there]
        order = np.argsort(place[k], kind="stable")
        place[k], owner[k] = place[k][order], owner[k][order]
    for start in range(0, len(common), VOCABULARY):
        parts = []
        for k, v in enumerate((x, y)):
            lo, hi = np.searchsorted(place[k], (start, start + VOCABULARY))
            m = np.zeros((len(v), min(VOCABULARY, len(common) - start)), np.float32)
            m[owner[k][lo:hi], place[k][lo:hi] - start] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def family_links(lists: DataFrame, sets: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between members of families that the pivot doesn't connect, one for each document and other end at least.

    ``own`` are the links with pivots: documents that have one needn't be compared with each other.  The
    others are compared with the whole family in blocks of ``BLOCK`` documents, each pair of blocks in a task of
    its own; only links leave it.
    """
    linked = own.select(F.col("a").alias("key"), F.col("b").alias("id"), F.lit(True).alias("linked"))
    marked = lists.join(linked, ["key", "id"], "left")
    # c: what a document is connected to already
    marked = cut(marked.select("key", "id", F.when(F.col("linked") | (F.col("id") == F.col("key")), F.col("key")).otherwise(F.col("id")).alias("c")))
    most = marked.groupBy("key").agg(F.count_if(F.col("c") != F.col("key")).alias("open"), F.count(F.lit(1)).alias("all")).filter("open > 0")
    most = most.select("key", F.col("key").alias("major"), F.ceil(F.col("open") / BLOCK).cast("int").alias("nx"), F.ceil(F.col("all") / BLOCK).cast("int").alias("ny"), F.col("all").alias("c"))
    rows = by_key(marked, most)
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    xs = rows.filter("c <> major").select("key", own("nx").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("j"), F.lit(True).alias("x"), "id", "c")
    ys = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("i"), own("ny").alias("j"), F.lit(False).alias("x"), "id", "c")
    blocks = xs.unionAll(ys).join(sets, "id")

    def links(pdf):
        import pandas as pd

        x, y = pdf[pdf["x"]], pdf[~pdf["x"]]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        common = compare_block(list(x["elements"]), list(y["elements"]))
        nx, ny = (np.array([len(e) for e in v["elements"]]) for v in (x, y))
        linked = 100 * common >= round(100 * similarity) * (nx[:, None] + ny[None, :] - common)
        at, to = np.nonzero(linked & (x["c"].to_numpy()[:, None] != y["c"].to_numpy()[None, :]))
        out = pd.DataFrame({"a": x["id"].to_numpy()[at], "b": y["id"].to_numpy()[to], "c": y["c"].to_numpy()[to]})
        return out.drop_duplicates(["a", "c"])[["a", "b"]]

    return blocks.groupBy("key", "i", "j").applyInPandas(links, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose full sets have the similarity."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("ea")), "a").join(sets.select(F.col("id").alias("b"), F.col("elements").alias("eb")), "b")
    return alike(both, similarity)


def alike(both: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of ``both`` whose sets ``ea`` and ``eb`` have the similarity."""
    common = F.size(F.array_intersect("ea", "eb"))
    both = both.select("a", "b", common.alias("c"), (F.size("ea") + F.size("eb")).alias("total"))
    return both.filter(100 * F.col("c") >= round(100 * similarity) * (F.col("total") - F.col("c"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) of the nodes of (a, b) edges, by alternating large-star and small-star steps."""
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    state = mark(edges)
    while state[0]:
        ways = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        edges = cut(small.filter("u <> v").distinct())
        new = mark(edges)
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, n: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    all_ = cut(sketches(docs, n))
    classes = all_.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch")).alias("r"))
    classes = cut(classes.select("digest", "r.*"))
    reps = classes.drop("digest")
    pairs, lists = candidates(reps, similarity)
    ids = cut(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).unionAll(lists.select("id")).distinct())
    sets = cut(full_sets(docs, ids, n).dropDuplicates(["id", "elements"]))
    edges = verified(pairs, sets, similarity)
    lists = cut(families(lists))
    if lists.limit(1).count():
        own = cut(pivot_links(lists, sets, similarity))
        edges = edges.unionAll(own).unionAll(family_links(lists, sets, own, similarity))
    found = components(edges)
    of_class = classes.select("digest", "id").join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    out = all_.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, n: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each component."""
    dropped = cut(near_duplicates(docs, n, similarity).filter("not kept").select(F.col("doc_id").alias("__id")).distinct())
    few = dropped.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if few else dropped, docs["doc_id"].cast("long") == dropped["__id"], "left_anti")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of four-word shingles, as the contract says."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), n=4)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + least(4, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM ways
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN ways e ON e.a = r.other),
comp AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.c, w.doc_id) AS component_id, coalesce(comp.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""
