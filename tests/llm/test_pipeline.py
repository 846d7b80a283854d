from __future__ import annotations

import corpus_pipeline
from glyco.llm import packing
from tests.llm.fixtures import documents, empty


def folder(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(5, 1, 0), (8, 1, 0), (13, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_run_equals_its_stages(spark, tmp_path):
    at = folder(spark, tmp_path, documents(spark))
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs.columns, stage(spark, docs, at)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before
        docs.write.parquet(f"{tmp_path}/own-{number}")
        docs = spark.read.parquet(f"{tmp_path}/own-{number}")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, docs.collect())) == sorted(map(key, corpus_pipeline.run(spark, at).collect()))


def test_each_stage_takes_messy_rows(spark, tmp_path):
    at = folder(spark, tmp_path, documents(spark))
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, at).count() <= 2 * docs.count(), name
    assert packing.pack(docs).count() >= docs.count()


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, empty(spark))).count() == 0
