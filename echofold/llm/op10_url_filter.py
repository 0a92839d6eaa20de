"""URL filters: host and path rules, then a Bloom filter cascade for the hosts that no rule judges.

A cascade holds a set of listed keys against a *complete* universe of keys.  Level 1 encodes the
listed keys; level 2 encodes those unlisted keys of the universe that level 1 takes by mistake;
level 3 encodes the listed keys that level 2 takes by mistake; and so on until a level takes none
by mistake.  A key of the universe is looked up level by level: the first level that does not hold
it decides.  The answer is exact, and no join of pages with the list is needed.

Scale: keys are dealt to shards of about ``SHARD_KEYS`` keys by a hash, and each shard builds its own
cascade in one task of bounded size.  Shards are then broadcast in groups of at most
``BROADCAST_BYTES``; a larger cascade takes several passes over the URL column, and each pass
judges the keys of its own shards only.

Edge cases: a null URL, or one without ``://``, has an empty host and an empty path, matches no rule
and is looked up as the empty key.  Repeated pages are judged one by one.  Null listed keys are
ignored.  Empty tables give empty results.  Further columns of pages are not read.  Very long URLs are judged whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm.common import ascii_lower, cut, mix64, table

#: (verdict, host, path) of the query's rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
SHARD_KEYS = 1 << 19
BROADCAST_BYTES = 64 << 20
#: False positives of a level: 1 in 2 from level 2 on, as each level only has to halve what is left.
FIRST_RATE, NEXT_RATE = 0.02, 0.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL: both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _hashes(keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each key, the second odd."""
    import xxhash

    h = np.fromiter((xxhash.xxh3_64_intdigest(k.encode()) for k in keys), np.uint64, len(keys))
    return h, mix64(h) | np.uint64(1)


class Level:
    """One Bloom filter: bits, number of probes and salt."""

    def __init__(self, k: int, m: int, salt: int, bits: bytes):
        self.k, self.m, self.salt, self.bits = k, m, salt, np.frombuffer(bits, np.uint8)

    @staticmethod
    def slots(h: np.ndarray, g: np.ndarray, k: int, m: int, salt: int) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            a = mix64(h + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            for i in range(k):
                yield (a + np.uint64(i) * g) % np.uint64(m)

    @classmethod
    def build(cls, h: np.ndarray, g: np.ndarray, rate: float, salt: int) -> Level:
        m = max(64, math.ceil(-len(h) * math.log(rate) / math.log(2) ** 2))
        k = max(1, round(-math.log2(rate)))
        bits = np.zeros(m, bool)
        for s in cls.slots(h, g, k, m, salt):
            bits[s] = True
        return cls(k, m, salt, np.packbits(bits).tobytes())

    def holds(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for s in self.slots(h, g, self.k, self.m, self.salt):
            found &= (self.bits[s >> np.uint64(3)] >> (7 - (s & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
        return found


def build_cascade(listed: np.ndarray, other: np.ndarray) -> list[Level]:
    """Levels that part the hashes ``listed`` from the hashes ``other`` exactly."""
    levels: list[Level] = []
    encode, against = np.unique(listed), np.unique(other)
    while len(encode):
        level = Level.build(encode, mix64(encode) | np.uint64(1), NEXT_RATE if levels else FIRST_RATE, len(levels) + 1)
        levels.append(level)
        encode, against = against[level.holds(against, mix64(against) | np.uint64(1))] if len(against) else against, encode
    return levels


def look_up(levels: Sequence[Level], h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Whether each hash of the universe is listed."""
    answer = np.full(len(h), len(levels) % 2 == 1)
    open_ = np.arange(len(h))
    for i, level in enumerate(levels):
        held = level.holds(h[open_], g[open_])
        answer[open_[~held]] = i % 2 == 1
        open_ = open_[held]
    return answer


def cascade_table(universe: DataFrame, listed: DataFrame, n_shards: int) -> DataFrame:
    """(shard, level, k, m, salt, bits) of the cascade.  ``universe`` and ``listed`` have a column key.

    Listed keys outside the universe are never asked for and are left out.
    """
    shard = F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int")
    marked = (
        universe.select("key", F.lit(0).alias("listed"), F.lit(1).alias("used"))
        .unionByName(listed.filter("key is not null").select("key", F.lit(1).alias("listed"), F.lit(0).alias("used")))
        .groupBy("key")
        .agg(F.max("listed").alias("listed"), F.max("used").alias("used"))
        .filter("used = 1")
        .select(shard.alias("shard"), "key", "listed")
    )

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h, _ = _hashes(pdf["key"].tolist())
        on = pdf["listed"].to_numpy() == 1
        if len(np.intersect1d(h[on], h[~on])):
            raise ValueError("a listed and an unlisted key share their 64-bit hash; change the hash's seed")
        shard_no = int(pdf["shard"].iloc[0])
        return pd.DataFrame(
            [(shard_no, i, x.k, x.m, x.salt, x.bits.tobytes()) for i, x in enumerate(build_cascade(h[on], h[~on]))],
            columns=["shard", "level", "k", "m", "salt", "bits"],
        )

    return marked.groupBy("shard").applyInPandas(build, "shard int, level int, k int, m long, salt int, bits binary")


def listed_by_cascade(df: DataFrame, key: str, listed: DataFrame, shard_keys: int = SHARD_KEYS, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a boolean column ``listed``: whether its ``key`` is among ``listed``'s, exactly.

    The universe is every distinct key of ``df``, so no key is asked for that the cascade was not built over.
    """
    spark = df.sparkSession
    universe = df.select(F.col(key).alias("key")).distinct()
    n_shards = max(1, math.ceil(universe.count() / shard_keys))
    built = cut(cascade_table(universe, listed, n_shards))
    sizes = {r["shard"]: r["n"] for r in built.groupBy("shard").agg(F.sum(F.length("bits")).alias("n")).collect()}
    groups, room = [[]], limit
    for s in range(n_shards):
        if groups[-1] and sizes.get(s, 0) > room:
            groups.append([])
            room = limit
        groups[-1].append(s)
        room -= sizes.get(s, 0)
    shard = F.pmod(F.xxhash64(key), F.lit(n_shards)).cast("int")
    tagged = df.withColumn("__shard", shard)
    schema = df.schema.add("listed", "boolean")
    parts = []
    for group in groups:
        lo, hi = group[0], group[-1]
        levels: dict[int, list[tuple]] = {}
        for r in built.filter(F.col("shard").between(lo, hi)).orderBy("shard", "level").collect():
            levels.setdefault(r["shard"], []).append((r["k"], r["m"], r["salt"], bytes(r["bits"])))
        held = spark.sparkContext.broadcast(levels)

        def judge(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            filters = {s: [Level(*x) for x in v] for s, v in held.value.items()}
            for b in batches:
                keys, shards = b.column(b.schema.get_field_index(key)).to_pylist(), np.array(b.column(b.schema.get_field_index("__shard")))
                h, g = _hashes(keys)
                out = np.zeros(len(keys), bool)
                for s in np.unique(shards):
                    at = np.flatnonzero(shards == s)
                    out[at] = look_up(filters.get(int(s), []), h[at], g[at])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out)], names=[*b.schema.names[:-1], "listed"])

        own = tagged if len(groups) == 1 else tagged.filter(F.col("__shard").between(lo, hi))
        parts.append(own.mapInArrow(judge, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, listed, verdict.  A rule's verdict wins; else a listed host is blocked."""
    host, path = url_parts(F.col(url_col))
    parts = pages.select(id_col, host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = listed_by_cascade(parts, "host", listed).withColumns({"rule": rule, "verdict": verdict})
    return judged.withColumn("verdict", F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged.  The list stands in for an outside one: hosts whose MD5 starts with 0 to 3."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    host = url_parts(F.col("url"))[0]
    listed = pages.select(host.alias("key")).distinct().filter((F.substring(F.md5(F.col("key").cast("binary")), 1, 1) < "4") & (F.col("key") != ""))
    return filter_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


ORACLE = r"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN ''
         ELSE translate(regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN ''
         ELSE regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM pages),
ruled AS (
  SELECT *,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
    host <> '' AND substr(md5(host), 1, 1) < '4' AS listed
  FROM parts)
SELECT page_id, host, path, rule, listed,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
       WHEN rule IS NOT NULL THEN 'block'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
