"""The pipeline's stages against what each operator says, on the smallest tables."""

import os

import pytest
from llm_helpers import rows, without_spaces
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_stages(spark):
    import corpus_pipeline as pipeline
    from demandkit.llm import decontam, simhash, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    before = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = pipeline.pin(stage(spark, before, SF), "test-stage")
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        assert set(rows(after, *docs.columns)) <= set(rows(before, *docs.columns))
        ids = {r.doc_id for r in after.collect()}
        if name == "toxicity":
            scores = toxicity.score(before, toxicity.fit(before, labels))
            assert ids == {r.doc_id for r in scores.filter("predicted = 0").collect()}
        elif name == "exact_dedup":
            texts = [without_spaces(r.text) for r in after.collect()]
            assert sorted(set(texts)) == sorted(texts) and set(texts) == {without_spaces(r.text) for r in before.collect()}
        elif name == "simhash_near_dedup":
            assert ids == {r.component_id for r in simhash.near_duplicates(before).collect()}
        else:
            assert ids == {r.doc_id for r in decontam.contamination(before, bench).filter("not contaminated").collect()}
        before = after
    pieces = pipeline.STAGES[-1][1](spark, before, SF)
    whole = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert whole.count() == before.count() and whole.filter("n != m").count() == 0
    result = pipeline.run(spark, SF)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert rows(result.groupBy("doc_id").agg(F.sum("length")), "*") == rows(pieces.groupBy("doc_id").agg(F.sum("length")), "*")
    assert set(columns) <= set(result.columns)


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs):
    import corpus_pipeline as pipeline

    for docs in (odd_docs, no_docs):
        for _, stage in pipeline.STAGES[:-1]:
            docs = pipeline.pin(stage(spark, docs, SF), "test-odd")
            assert docs.columns == odd_docs.columns
        pieces = pipeline.STAGES[-1][1](spark, docs, SF)
        assert pieces.filter("start = 0").count() == docs.count()
    assert no_docs.count() == 0
