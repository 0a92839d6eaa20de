"""Packing: length buckets with the least padding, and batches of a token budget inside each bucket.

Documents are cut into pieces of at most ``max_len`` tokens.  The histogram of piece lengths over all
documents (at most ``max_len`` rows, whatever the input) goes to a dynamic programme that chooses ``n_buckets``
boundaries with the least total padding.  A piece goes to the smallest boundary that holds it; a batch
takes as many pieces of one bucket as its boundary times their number stays within ``token_budget``.

Tokens are those of a vocabulary whose path is a parameter; without one they are parted by white space.

Scale: lengths are found in one narrow pass, in which a worker counts each word's tokens once; after it only (id, piece, length) moves.  A bucket may hold a
third of all pieces, so pieces are numbered in shards by a hash: a count for each (bucket, shard), their
running sum (at most ``MAX_SHARDS`` times ``n_buckets`` rows, which bounds the broadcast), and a number inside
each shard.  Batches run over shard borders, so a bucket has one batch at most that isn't full.

Edge cases: null, empty and wordless texts have no tokens: they get one row with bucket_len 0 and null
batch.  Very long texts give many pieces, spread over shards.  Repeated rows are packed each; rows of equal id are told
apart by a row number.  Fewer lengths than buckets give as many buckets.  An empty table gives no rows.  Further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echofold.llm.common import cut, table
from echofold.session import open_fs

MAX_LEN, N_BUCKETS, TOKEN_BUDGET = 2048, 8, 32768
SHARD_ROWS, MAX_SHARDS = 2000, 8192


#: A rank file of a public vocabulary, and the pattern that parts text before its merges.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose counts a worker keeps at most, of each of two generations: about 15 MB in all.
KEPT_WORDS = 50_000
#: The longest word that is kept, and about how many characters of a text are parted at a time.
KEPT_CHARS, PART_CHARS = 64, 1 << 16
#: A space between two characters that are not white space: a token may begin there, but none spans it.
CUT_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: A space that is not such a one.
ODD_SPACE = re.compile(r"^ |\s | \s| $")


class TokenCounter(dict):
    """Counts of a vocabulary's tokens, kept by word.

    Where a space stands between two other characters than white space, no token spans it: the text's count is the sum of those of its pieces
    between such spaces, each with the space before it.
    """

    def __init__(self, ranks: bytes):
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        self.before: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        n = self.before.pop(word, None)
        if n is None:
            n = len(self.encoding.encode_ordinary(f" {word}"))
        if len(word) > KEPT_CHARS:
            return n
        if len(self) >= KEPT_WORDS:  # words that come again are taken over from the generation before
            self.before = dict(self)
            self.clear()
        self[word] = n
        return n

    def count(self, text: str) -> int:
        total, start, end = 0, 0, -1
        while end < len(text):
            place = CUT_SPACE.search(text, start + PART_CHARS)
            end = place.start() if place else len(text)
            part = text[start:end]
            pieces = CUT_SPACE.split(part) if ODD_SPACE.search(part) else part.split(" ")
            if not start:  # no space comes before the first piece
                total += len(self.encoding.encode_ordinary(pieces.pop(0)))
            total += sum(map(self.__getitem__, pieces))
            start = end + 1
        return total


#: A worker's counter, by the digest of its vocabulary: words are counted once for all its tasks.
_HELD: dict[str, TokenCounter] = {}


def _counter(ranks: bytes) -> TokenCounter:
    key = hashlib.sha256(ranks).hexdigest()
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = TokenCounter(ranks)
    return _HELD[key]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """id, n_tokens of each row.  With the path of a ``.tiktoken`` file, which the driver reads, tokens are that vocabulary's; else they are parted by white space."""
    df = docs.select(id_col, F.col(text_col).cast("binary").alias("__raw"))
    held = None
    if vocabulary:
        fs, at = open_fs(vocabulary)
        with fs.open_input_file(at) as f:
            held = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary's size: about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held is not None:
            counter = _counter(held.value)
            count = lambda t: counter.count(t.decode("utf-8", "replace"))
        else:
            count = lambda t: len(t.split())
        for b in batches:
            n = [count(t.as_py() or b"") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[id_col, "n_tokens"])

    return df.mapInArrow(run, df.select(id_col).schema.add("n_tokens", "long"))


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """At most ``n_buckets`` boundaries, each one of the (sorted, distinct) lengths, that minimise the padding of all pieces."""
    n = len(lengths)
    if not n:
        return []
    size, c = lengths.astype(object if counts.sum() > 1 << 50 else np.int64), counts.astype(object if counts.sum() > 1 << 50 else np.int64)
    many = np.concatenate(([0], np.cumsum(c)))
    total = np.concatenate(([0], np.cumsum(c * size)))
    # cost[j]: the least padding of the first j lengths with the buckets allowed so far
    cost = np.array([0, *(size[j - 1] * many[j] - total[j] for j in range(1, n + 1))], dtype=size.dtype)
    back = []
    for _ in range(1, min(n_buckets, n)):
        new, at = cost.copy(), np.zeros(n + 1, int)
        for j in range(1, n + 1):
            i = np.arange(j)
            options = cost[:j] + size[j - 1] * (many[j] - many[i]) - (total[j] - total[i])
            at[j] = int(np.argmin(options))
            new[j] = options[at[j]]
        back.append(at)
        cost = new
    out, j = [], n
    for at in reversed(back):
        out.append(int(lengths[j - 1]))
        j = at[j]
        if j == 0:
            break
    if j:
        out.append(int(lengths[j - 1]))
    return sorted(out)


def padding(lengths: np.ndarray, counts: np.ndarray, boundaries: list[int]) -> int:
    up = np.array(boundaries)[np.searchsorted(boundaries, lengths)]
    return int(((up - lengths) * counts).sum())


def pack(counts: DataFrame, id_col: str = "doc_id", max_len: int = MAX_LEN, n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """id, piece, start_token, n_tokens, bucket_len, batch, slot for each piece of ``counts`` (id, n_tokens).

    ``batch`` numbers the batches of a bucket from 0, ``slot`` the places in a batch.
    """
    held = cut(counts.withColumn("__row", F.monotonically_increasing_id()))
    last = F.greatest(F.ceil(F.col("n_tokens") / max_len) - 1, F.lit(0)).cast("int")
    pieces = held.select(id_col, "__row", F.col("n_tokens").alias("__all"), F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        id_col, "__row", "piece",
        (F.col("piece").cast("long") * max_len).alias("start_token"),
        F.least(F.lit(max_len).cast("long"), F.col("__all") - F.col("piece").cast("long") * max_len).alias("n_tokens"),
    )
    histogram = pieces.filter("n_tokens > 0").groupBy("n_tokens").count().collect()  # max_len rows at most
    found = sorted((r["n_tokens"], r["count"]) for r in histogram)
    lengths, many = np.array([x for x, _ in found], np.int64), np.array([x for _, x in found], np.int64)
    boundaries = best_boundaries(lengths, many, n_buckets)
    bucket = F.lit(0).cast("long")
    for b in reversed(boundaries):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(bucket)
    shards = min(MAX_SHARDS, max(1, math.ceil(int(many.sum()) / SHARD_ROWS)))
    placed = pieces.withColumns({"bucket_len": F.when(F.col("n_tokens") > 0, bucket).otherwise(F.lit(0).cast("long")), "__shard": F.pmod(F.xxhash64("__row", "piece"), F.lit(shards)).cast("int")})
    sums = placed.groupBy("bucket_len", "__shard").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("bucket_len").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("bucket_len", "__shard", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("bucket_len", "__shard").orderBy("__row", "piece"))
    numbered = placed.withColumn("__i", inside).join(F.broadcast(offsets), ["bucket_len", "__shard"])
    place = F.col("__before") + F.col("__i") - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("long")
    full = F.col("bucket_len") > 0
    return numbered.select(
        id_col, "piece", "start_token", "n_tokens", "bucket_len",
        F.when(full, F.floor(place / room)).cast("long").alias("batch"), F.when(full, F.pmod(place, room)).cast("int").alias("slot"),
    )


def pack_documents(docs: DataFrame, vocabulary: str | None = None, **options) -> DataFrame:
    return pack(token_counts(docs, vocabulary=vocabulary), **options)


def op2_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """Every document's pieces, in tokens of a public vocabulary."""
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary=vocabulary)
