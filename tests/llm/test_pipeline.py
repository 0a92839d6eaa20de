import corpus_pipeline as P
from pyspark.sql import functions as F

from echofold.llm import op6_language, op9_toxicity


def test_stages(spark, tmp_path):
    at = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet").withColumn("score", F.lit("kept as it is"))
    labels = spark.read.parquet(f"{at}/labels.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, at).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert out.columns == columns and 0 < out.count() <= before
            gone = docs.join(out, "doc_id", "left_anti")
            if name == "toxicity":
                marks = gone.join(labels, "doc_id").select("toxic").collect()
                assert marks and sum(r["toxic"] for r in marks) >= 0.95 * len(marks)
            if name == "language_id":
                assert gone.count() <= 0.01 * before
        docs, before = out, out.count()
    assert set(docs.columns) == {"doc_id", "piece", "start_token", "n_tokens", "bucket_len", "batch", "slot"}


def test_stages_on_odd_documents(spark):
    at = "/root/testdata/sf0.001"
    empty = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "The and of.", "en", "s", 11), (1, "The and of.", "en", "s", 11), (2, "12", None, "s", 2)], empty.schema)
    for name, stage in P.STAGES:
        assert stage(spark, empty, at).count() == 0, name
        assert stage(spark, odd, at).count() <= 5, name


def test_run_equals_its_stages(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and P.ORACLE_SQL is None
    assert op6_language.UND == "und" and op9_toxicity.THRESHOLD == 0.7
