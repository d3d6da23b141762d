"""The stages on a small table, each against what its operator says of the stage's own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from equispark.llm import decontamination, neardup, pii
from equispark.llm.staging import staged

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, SMALL), name)
        assert docs.columns == columns and 0 < docs.count() <= before.count()
        if name == "near_duplicates":
            kept = {r.doc_id for r in neardup.near_duplicates(before).filter("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == kept
        if name == "decontamination":
            found = decontamination.contamination(before, spark.read.parquet(f"{SMALL}/benchmark.parquet"))
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in found.filter("NOT contaminated").collect()}
        if name == "personal_data":
            assert docs.count() == before.count()
            assert not any(pii.base_spans(r.text) for r in docs.collect())
            assert docs.filter(F.length("text") != F.col("n_chars")).count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_a_column_of_any_name_stays(spark, documents):
    docs = documents.withColumn("_found", F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SMALL), name)
        assert docs.columns == [*documents.columns, "_found"] and {r._found for r in docs.collect()} == {"mine"}


def test_empty_documents_pass_all_stages(spark, documents):
    docs = documents.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SMALL), name)
    assert docs.count() == 0


def test_odd_rows_pass_all_stages(spark, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SMALL), name)
    assert {r.doc_id for r in docs.collect()} <= {1, 2, 3, 6, 8, 9, None}
