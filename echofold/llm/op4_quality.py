"""Quality by an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

Counts of ``ORDER``-grams are taken over all trusted documents of the training fold.  Lower orders count distinct
left neighbours.  Discounts come from the counts of counts of each order; context totals, discounts and
the probabilities of the shorter n-gram meet in joins that are sharded by n-gram and context, order by order.  A
document's perplexity sums the model's log-probabilities over its characters; a document is kept if its
perplexity is at most a quantile, of its own language, of the perplexities of the trusted documents that were held
out of training (fold 0 of 5, by crc32 of the id).

Words or lines that are repeated over and over are easy to predict, so that perplexity doesn't tell them.  A document's
variety is the log of the number of its distinct n-grams over the log of the number of all of them, which hardly depends
on its length; a document is kept only if its variety is at least a low quantile, of its own language, of those of all trusted documents
(nothing is learned for it, so that none need be held out).

N-grams are exact: a character is its code point, after lower-casing, with all digits one and runs of white space one.  Five of
them take two numbers (``hi`` the first two, ``lo`` the other three).  Workers look n-grams up by a 64-bit hash of these.

Scale: counts are combined in each task, then by Spark.  The model has a row for each distinct n-gram, which
levels off with the text, but isn't bounded.  It is written to the shared folder, where workers read it, so that nothing of
its size passes through the driver.  Beyond ``MODEL_ROWS`` rows it is dealt to shards by the last two characters of the
context: what one position needs shares them, but for the n-grams of one and two characters, which every shard has.
Documents take a pass for each shard, which adds its share to their sums.  Trusted ids are broadcast
up to ``BROADCAST_IDS``, and joined by shuffle beyond.

Edge cases: null and empty texts have no characters, a null perplexity, and are not kept.  A null language is a language of its own.
A language without held-out trusted documents takes the quantile over all languages; without any trusted
document nothing can be judged: perplexity is null and kept is true for every text that isn't empty.  Several labels of
one document: all must say 1.  Repeated rows are judged one by one.  Very long texts are judged whole.  Further columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm.common import crc_mod, cut, mix64, shared_dir, table
from echofold.llm.warc import open_fs

ORDER, BITS = 5, 21
QUANTILE, LEAST_QUANTILE = 0.99, 0.005
FOLDS = 5
MODEL_ROWS, BROADCAST_IDS, HELD_CODES = 6_000_000, 1_000_000, 4_000_000
CHAR, PAIR = (1 << BITS) - 1, (1 << 2 * BITS) - 1
#: Stands before a text; no character of a text, as white space is one space.
PAD = 10
#: A prime that spreads pairs of characters over shards.
SPREAD = 1_000_003
P1 = np.uint64(0x9E3779B97F4A7C15)


def characters(text: str) -> np.ndarray:
    """Lower-cased code points: digits are 0, runs of white space one space."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    cp[(cp >= 48) & (cp <= 57)] = 48
    cp[(cp <= 32) | (cp == 0xA0)] = 32
    if len(cp) > 1:
        cp = cp[np.append(True, (cp[1:] != 32) | (cp[:-1] != 32))]
    return cp


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hi and lo of the n-gram that ends at each character, and where each text's n-grams end."""
    pad = np.full(ORDER - 1, PAD, np.int64)
    parts, at, ends, total = [], [], [], 0
    for t in texts:
        c = characters(t) if t else pad[:0]
        if len(c):
            at.append(np.arange(len(c)) + (total + len(pad) * (len(at) + 1)))
            parts += [pad, c]
        total += len(c)
        ends.append(total)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.array(ends, np.int64)
    x, i = np.concatenate(parts), np.concatenate(at)
    two = x[:-1] << BITS | x[1:]  # starts at each place
    return two[i - 4], x[i - 2] << 2 * BITS | two[i - 1], np.array(ends, np.int64)


def keys_of(hi: np.ndarray | None, lo: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams; hi is None for three characters and fewer."""
    with np.errstate(over="ignore"):
        low = lo.astype(np.uint64)
        return mix64(low if hi is None else hi.astype(np.uint64) * P1 ^ low)


def count_grams(docs: DataFrame) -> DataFrame:
    """(hi, lo, n) of the n-grams of every text of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = [np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))]
        held = nothing  # keys, hi, lo, counts

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in held[1:]], names=["hi", "lo", "n"])

        for b in batches:
            texts = b.column(0).to_pylist()
            for i in range(0, len(texts), 500):
                hi, lo, _ = grams(texts[i : i + 500])
                keys, first, many = np.unique(keys_of(hi, lo), return_index=True, return_counts=True)
                new = [np.concatenate(x) for x in zip(held, (keys, hi[first], lo[first], many), strict=True)]
                keys, first, back = np.unique(new[0], return_index=True, return_inverse=True)
                held = [keys, new[1][first], new[2][first], np.bincount(back, new[3], len(keys)).astype(np.int64)]
                if len(keys) > HELD_CODES:
                    yield send()
                    held = nothing
        yield send()

    return docs.select("text").mapInArrow(run, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the counts of counts 1 to 4; common values where they can't be told."""
    n1, n2, n3, n4 = (counts.get(i, 0) for i in range(1, 5))
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


def shorter(size: int) -> tuple[Column, Column]:
    """hi and lo of an n-gram's last ``size`` characters, of one character more."""
    hi = F.col("hi").bitwiseAND(F.lit((1 << BITS * (size - 3)) - 1)) if size > 3 else F.lit(0).cast("long")
    return hi, F.col("lo") if size >= 3 else F.col("lo").bitwiseAND(F.lit((1 << BITS * size) - 1))


def before_last() -> tuple[Column, Column]:
    """hi and lo of an n-gram's context."""
    return F.shiftright("hi", BITS), F.shiftright("lo", BITS).bitwiseOR(F.shiftleft(F.col("hi").bitwiseAND(F.lit(CHAR)), 2 * BITS))


def model_table(top: DataFrame) -> tuple[DataFrame, float]:
    """(kind, size, hi, lo, value) from (hi, lo, n) of the longest n-grams, and the log-probability of an unknown character.

    Kind ``p`` has the log-probability of an n-gram's last character after the others; kind ``b`` the log of the weight that a
    context leaves to the shorter n-gram.
    """
    by_order = {ORDER: cut(top.withColumnRenamed("n", "a"))}
    for size in range(ORDER - 1, 0, -1):
        hi, lo = shorter(size)
        by_order[size] = cut(by_order[size + 1].groupBy(hi.alias("hi"), lo.alias("lo")).agg(F.count(F.lit(1)).alias("a")))
    types = by_order[1].count()
    parts, below, unknown = [], None, 0.0
    for size in range(1, ORDER + 1):
        grams_ = by_order[size]
        d = discounts({r["a"]: r["count"] for r in grams_.filter("a <= 4").groupBy("a").count().collect()})
        less = F.when(F.col("a") == 1, d[0]).when(F.col("a") == 2, d[1]).otherwise(d[2])
        ch, cl = before_last() if size > 1 else (F.lit(0).cast("long"), F.lit(0).cast("long"))
        of_context = grams_.groupBy(ch.alias("ch"), cl.alias("cl")).agg(F.sum("a").alias("total"), F.sum(less).alias("left"))
        own = grams_.withColumns({"ch": ch, "cl": cl}).join(of_context, ["ch", "cl"])
        if size == 1:
            left = of_context.select(F.max(F.col("left") / F.col("total"))).first()[0] or 1.0
            prob = own.select("hi", "lo", ((F.col("a") - less) / F.col("total") + left / (types + 1)).alias("p"))
            unknown = float(np.log(left / (types + 1)))
        else:
            sh, sl = shorter(size - 1)
            prob = own.withColumns({"sh": sh, "sl": sl}).join(below.select(F.col("hi").alias("sh"), F.col("lo").alias("sl"), F.col("p").alias("q")), ["sh", "sl"])
            prob = prob.select("hi", "lo", ((F.col("a") - less) / F.col("total") + F.col("left") / F.col("total") * F.col("q")).alias("p"))
            parts.append(of_context.select(F.lit("b").alias("kind"), F.lit(size - 1).alias("size"), F.col("ch").alias("hi"), F.col("cl").alias("lo"), F.log(F.col("left") / F.col("total")).alias("value")))
        below = cut(prob)
        parts.append(below.select(F.lit("p").alias("kind"), F.lit(size).alias("size"), "hi", "lo", F.log("p").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return cut(out), unknown


class Lookup:
    """Values by 64-bit hash: an open hash table of arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys, self.values, self.full = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.float32), np.zeros(1 << self.bits, bool)
        open_, at = np.arange(len(keys)), self._slot(keys)
        while len(open_):
            slot, first = np.unique(at[open_], return_index=True)
            free = ~self.full[slot]
            won = open_[first[free]]
            self.keys[at[won]], self.values[at[won]], self.full[at[won]] = keys[won], values[won], True
            lost = np.ones(len(keys), bool)
            lost[won] = False
            open_ = open_[lost[open_]]
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether each key is there."""
        at = self._slot(keys)
        full = self.full[at]
        found = full & (self.keys[at] == keys)
        value = self.values[at]
        open_ = np.flatnonzero(full & ~found)
        where = at[open_]
        while len(open_):
            where = (where + 1) & (len(self.keys) - 1)
            full = self.full[where]
            hit = full & (self.keys[where] == keys[open_])
            value[open_[hit]] = self.values[where[hit]]
            found[open_[hit]] = True
            more = full & ~hit
            open_, where = open_[more], where[more]
        return value, found


class Model:
    """One shard's probabilities and weights by size."""

    def __init__(self, arrays: dict[tuple[str, int], tuple[np.ndarray, np.ndarray, np.ndarray]], unknown: float, shard: int = 0, shards: int = 1):
        self.tables = {(kind, size): Lookup(keys_of(hi if size > 3 else None, lo), values) for (kind, size), (hi, lo, values) in arrays.items()}
        self.unknown, self.shard, self.shards = unknown, shard, shards

    def log_probs(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Of each n-gram's last character; 0 for what another shard judges."""
        out = np.zeros(len(lo))
        open_ = np.arange(len(lo)) if self.shards == 1 else np.flatnonzero((lo >> BITS & PAIR) % SPREAD % self.shards == self.shard)
        h, l = hi[open_], lo[open_]
        for size in range(ORDER, 0, -1):
            h = h & ((1 << BITS * (size - 3)) - 1) if size > 3 else None
            l = l if size >= 3 else l & ((1 << BITS * size) - 1)
            if ("p", size) in self.tables:
                value, found = self.tables["p", size].get(keys_of(h, l))
                out[open_[found]] += value[found]
                open_, h, l = open_[~found], None if h is None else h[~found], l[~found]
            if size > 1 and ("b", size - 1) in self.tables and len(open_):
                ch, cl = None if size <= 4 else h >> BITS, l >> BITS if h is None else l >> BITS | (h & CHAR) << 2 * BITS
                value, found = self.tables["b", size - 1].get(keys_of(ch, cl))
                out[open_[found]] += value[found]
        out[open_] += self.unknown
        return out


#: The shard that a worker holds, by its place: it is read once for all tasks of a worker.
_HELD: dict[tuple[str, int], Model] = {}


def _model(at: str, unknown: float, shard: int, shards: int) -> Model:
    if (at, shard) not in _HELD:
        import pyarrow.parquet as pq

        _HELD.clear()
        fs, root = open_fs(at)
        arrays = {}
        for kind, size in [("p", x) for x in range(1, ORDER + 1)] + [("b", x) for x in range(1, ORDER)]:
            own = [f"{root}/shard={k}/kind={kind}/size={size}" for k in (-1, shard)]
            files = [x.path for d in own if fs.get_file_info(d).type == pafs.FileType.Directory for x in fs.get_file_info(pafs.FileSelector(d)) if x.path.endswith(".parquet")]
            if files:
                t = pa.concat_tables([pq.read_table(f, filesystem=fs, partitioning=None) for f in sorted(files)])
                arrays[kind, size] = tuple(t[c].to_numpy() for c in ("hi", "lo", "value"))
        _HELD[at, shard] = Model(arrays, unknown, shard, shards)
    return _HELD[at, shard]


def perplexity_sums(docs: DataFrame, model: DataFrame, unknown: float, limit: int = MODEL_ROWS) -> DataFrame:
    """``docs`` with n_tokens, n_distinct (n-grams) and log_prob (of the whole text) instead of text."""
    everywhere = ((F.col("kind") == "p") & (F.col("size") <= 2)) | ((F.col("kind") == "b") & (F.col("size") == 1))
    counted = model.agg(F.count(F.lit(1)).alias("all"), F.count_if(everywhere).alias("low")).first()
    shards = 1 if counted["all"] <= limit else math.ceil((counted["all"] - counted["low"]) / max(limit - counted["low"], limit // 4, 1))
    pair = F.when(F.col("kind") == "p", F.shiftright("lo", BITS)).otherwise(F.col("lo")).bitwiseAND(F.lit(PAIR))
    at = f"{shared_dir(docs.sparkSession)}/quality-{uuid.uuid4().hex}"
    dealt = model.withColumns({"value": F.col("value").cast("float"), "shard": F.when(everywhere, -1).otherwise(pair % SPREAD % shards).cast("int")})
    dealt.write.partitionBy("shard", "kind", "size").parquet(at)
    df = docs.withColumns({"n_tokens": F.lit(0).cast("long"), "n_distinct": F.lit(0).cast("long"), "log_prob": F.lit(0.0)})
    for shard in range(shards):
        if shard:
            df = cut(df)
        df = df.mapInArrow(_adder(at, unknown, shard, shards), df.schema)
    return df.drop("text")


def _adder(at: str, unknown: float, shard: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(at, unknown, shard, shards)
        for b in batches:
            names = b.schema.names
            texts, before = b.column(names.index("text")).to_pylist(), np.array(b.column(names.index("log_prob")))
            n, total, distinct = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for i in range(0, len(texts), 200):
                hi, lo, ends = grams(texts[i : i + 200])
                sums = np.concatenate(([0.0], np.cumsum(model.log_probs(hi, lo))))
                starts = np.concatenate(([0], ends[:-1]))
                n[i : i + 200], total[i : i + 200] = ends - starts, sums[ends] - sums[starts]
                if not shard:
                    keys = keys_of(hi, lo)
                    distinct[i : i + 200] = [len(np.unique(keys[x:y])) for x, y in zip(starts, ends, strict=True)]
            new = {"n_tokens": pa.array(n), "log_prob": pa.array(before + total)} | ({} if shard else {"n_distinct": pa.array(distinct)})
            yield pa.RecordBatch.from_arrays([new.get(x, b.column(k)) for k, x in enumerate(names)], names=names)

    return run


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with a boolean column __trusted: all labels of the document have quality 1."""
    trusted = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id", F.lit(True).alias("__trusted"))
    few = trusted.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(trusted) if few else trusted, "doc_id", "left").withColumn("__trusted", F.coalesce("__trusted", F.lit(False)))


def judge_quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, least_quantile: float = LEAST_QUANTILE) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, threshold, variety, least_variety, kept for each row of ``docs`` (doc_id, text, lang)."""
    marked = with_trust(docs.select("doc_id", "text", "lang"), labels).withColumn("__held", crc_mod(F.col("doc_id"), FOLDS) == 0)
    model, unknown = model_table(count_grams(marked.filter("__trusted and not __held")))
    known = model.limit(1).count() > 0
    sums = cut(perplexity_sums(marked, model, unknown))
    scored = sums.withColumn("perplexity", F.when((F.col("n_tokens") > 0) & F.lit(known), F.exp(-F.col("log_prob") / F.col("n_tokens"))))
    variety = F.log(F.greatest("n_distinct", F.lit(2))) / F.log(F.greatest("n_tokens", F.lit(3)))
    scored = scored.withColumn("variety", F.when(F.col("n_tokens") > 0, variety))
    calibration = scored.filter("__trusted and __held and perplexity is not null")
    trusted = scored.filter("__trusted and variety is not null")
    at, least = F.expr(f"percentile_approx(perplexity, {quantile}, 10000)"), F.expr(f"percentile_approx(variety, {least_quantile}, 10000)")
    overall, overall_least = calibration.agg(at).first()[0], trusted.agg(least).first()[0]
    limits = calibration.groupBy(F.col("lang").alias("__lang")).agg(at.alias("__limit"))
    leasts = trusted.groupBy(F.col("lang").alias("__lang")).agg(least.alias("__least"))
    joined = scored
    for found in (limits, leasts):
        joined = joined.join(found, F.col("lang").eqNullSafe(F.col("__lang")), "left").drop("__lang")
    threshold, least_variety = F.coalesce("__limit", F.lit(overall).cast("double")), F.coalesce("__least", F.lit(overall_least).cast("double"))
    ok = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)) & F.coalesce(F.col("variety") >= F.col("least_variety"), F.lit(True))
    judged = joined.withColumns({"threshold": threshold, "least_variety": least_variety})
    return judged.select("doc_id", "lang", "n_tokens", "perplexity", "threshold", "variety", "least_variety", ((F.col("n_tokens") > 0) & ok).alias("kept"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels", "doc_id", "quality"))
