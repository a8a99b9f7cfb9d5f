import corpus_pipeline
from claimweave.llm.registry import ORACLES, QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_work_on_what_is_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        assert after.select("doc_id").distinct().join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        before = after
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "shard", "slot"} <= set(out.columns)
    assert out.agg(F.countDistinct("shard", "slot")).first()[0] == out.count() > 0


def test_registered_queries():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(ORACLES) <= set(QUERIES)
