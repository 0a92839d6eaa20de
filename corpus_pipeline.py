"""The corpus pipeline: language ID, toxicity, near-duplicate removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which ``run`` writes as Parquet in the shared
folder and reads again as the next stage's documents.  A stage judges all that the one before it kept, and its
decisions take effect; all but the last return the columns of documents.

Edge cases: as the operators' own.  Documents without a letter go with language ID; a null id passes every stage.  Labels and
benchmark are read from ``sf_dir`` whatever documents are left.  Extra columns of documents pass through.  Very long texts are judged whole
by every stage.  Where the session has Spark's own number of rows for a batch to Python, it gets
a smaller one, which changes no result.  The stages' files stay in the shared folder, as the result is read from the last ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm import op1_decontaminate, op2_packing, op3_near_dedup, op6_language, op9_toxicity
from echofold.llm.common import shared_dir, table
from echofold.session import ship

#: A document stays if its best language's score is at least this: below, every language says no.
LANGUAGE_SCORE = 0.5
#: Rows of the batches that go to Python workers, where the session has Spark's own number: five operators share an executor's memory.
BATCH_ROWS, SPARK_ROWS = 2000, 10000


def _small_batches(spark: SparkSession) -> None:
    if int(spark.conf.get(key := "spark.sql.execution.arrow.maxRecordsPerBatch")) == SPARK_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def _carried(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` under names that no operator's own columns can clash with, but for those that operators read."""
    _small_batches(docs.sparkSession)
    reads = {"doc_id", "text", "n_chars"}
    return docs.select(*(F.col(f"`{c}`").alias(c if c in reads else f"__doc_{c}") for c in docs.columns)), docs.columns


def _back(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col(f"`{c}`" if c in {"doc_id", "text", "n_chars"} else f"`__doc_{c}`").alias(c) for c in columns))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language was told; the model is learned from the labelled rows that aren't held out."""
    own, columns = _carried(docs)
    model = op6_language.fit(docs.select("doc_id", "text", "lang"))
    found = op6_language.identify(own, model)
    return _back(found.filter((F.col("lang_pred") != op6_language.UND) & (F.col("score") >= LANGUAGE_SCORE)), columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learned from labels that aren't held out, doesn't call toxic."""
    grammar = op9_toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
    own, columns = _carried(docs)
    return _back(op9_toxicity.score_toxicity(own, grammar).filter(F.col("toxicity") < op9_toxicity.THRESHOLD), columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8, which is the rule where no contract names other sizes."""
    own, columns = _carried(docs)
    return _back(op3_near_dedup.deduplicate(own), columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated, without the benchmark spans that they hold."""
    own, columns = _carried(docs)
    return _back(op1_decontaminate.decontaminate(own, table(spark, sf_dir, "benchmark", "item_id", "text")), columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in batches, in tokens of a public vocabulary."""
    _small_batches(spark)
    return op2_packing.pack_documents(docs.select("doc_id", "text"), vocabulary=op2_packing.VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    ship(spark)
    docs, at = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(out := f"{at}/{k}-{name}")
        docs = spark.read.parquet(out)
    return docs


#: Language ID and toxicity are learned models, which SQL can't express.
ORACLE_SQL = None
