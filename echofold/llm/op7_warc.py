"""WARC archives of web pages: deduplicated by payload when written, read back by the data source of ``warc``.

Scale: digests and lengths are found in the scan; only (digest, largest id) is shuffled to find which
payloads recur, combined before the shuffle.  That table is broadcast up to ``BROADCAST_RECURRING`` rows of about 100 bytes, so that no
payload is moved; beyond, pages meet it by digest, where Spark splits hot digests (its skew join).  Archives are read in pieces of about
64 MB.

Edge cases: a null html is an empty payload; payloads under ``MIN_REVISIT`` bytes are responses each, so
copies of them stand side by side; a null URL leaves out the header.  Rows with equal ids and
payloads give as many records (each a response only if it has the largest id).  An empty table gives
no archive and no rows.  Line breaks in a URL become spaces in its header.  Pages without an id have records without a number.  Further
columns of pages are not read.  A payload is held whole in memory, one at a time.

Spark refuses Python sources with pushed filters unless ``spark.sql.python.filterPushdown.enabled`` is on: ``read_archives`` turns
it on for the session, where it concerns such sources only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm.common import cut, shared_dir, table
from echofold.llm.warc import WarcDataSource

MIN_REVISIT = 1000
BROADCAST_RECURRING = 500_000


def archive_records(pages: DataFrame, min_revisit: int = MIN_REVISIT, limit: int = BROADCAST_RECURRING) -> DataFrame:
    """page_id, url, html to the columns that the archive writer takes."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    own = pages.select("page_id", "url", body.alias("payload")).select(
        "*", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes")
    )
    slim = pages.select("page_id", body.alias("payload")).filter(F.octet_length("payload") >= min_revisit)
    recurs = slim.groupBy(F.sha1("payload").alias("payload_digest")).agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    recurs = cut(recurs.select("payload_digest", "response"))
    joined = own.join(F.broadcast(recurs) if recurs.count() <= limit else recurs, "payload_digest", "left")
    revisit = (F.col("payload_bytes") >= min_revisit) & F.col("response").isNotNull() & (~F.col("page_id").eqNullSafe(F.col("response")))
    return joined.select(
        F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("response").cast("string"), F.lit(">"))).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
    )


def write_archives(records: DataFrame, path: str) -> None:
    records.sparkSession.dataSource.register(WarcDataSource)
    records.write.format("echofold_warc").mode("append").option("path", path).save()


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of an archive file or folder.  Filters on type, id, URI and digest are pushed into the reader."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("echofold_warc").option("payload", str(payload).lower()).load(path)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of every page in the shared folder, read back; payloads of responses are held against their digests."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(archive_records(table(spark, sf_dir, "pages", "page_id", "url", "html")), path)
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")
    responses = read_archives(spark, path).filter(F.col("record_type") == "response")
    whole = F.sha1("payload") == F.col("payload_digest")
    checked = responses.withColumn("payload_digest", F.when(whole, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload does not have its digest"))))
    revisits = read_archives(spark, path, payload=False).filter(F.col("record_type") == "revisit")
    out = lambda df: df.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
    return out(checked).unionAll(out(revisits))


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (
  SELECT payload_digest, max(page_id) AS response FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN r.response IS NULL OR r.response = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN r.response <> p.page_id THEN r.response END AS refers_to
FROM p LEFT JOIN r ON p.payload_bytes >= 1000 AND r.payload_digest = p.payload_digest
"""
