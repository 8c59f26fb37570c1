"""Registered training-data queries: SQL where there is some, and the pipeline."""

import pytest
from oracle import compare, connect

import corpus_pipeline
from shelfscan.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, name):
    assert compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF) is None


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        docs = after
    packed = corpus_pipeline.run(spark, SF)
    assert packed.filter("piece = 0").count() == docs.count()


def test_pipeline_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").limit(0)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
