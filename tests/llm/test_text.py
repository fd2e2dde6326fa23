import os

import pyarrow as pa
from pyspark.sql import functions as F

from demandkit.llm import text, toxicity


def test_release_pins(spark, monkeypatch):
    monkeypatch.setattr(text, "_PINNED", [])
    kept = text.pin(spark.range(10), "test")
    path = text._PINNED[0].removeprefix("file:")
    assert kept.count() == 10 and os.path.isdir(path)
    assert text.release_pins(spark) == 1 and not os.path.exists(path) and text.release_pins(spark) == 0


def test_perhaps_in_loses_none(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("row_key"), "id")
    for share in (0, 3, 5_000):
        keys = rows.filter(F.col("id") < share).select("row_key")
        got = text.perhaps_in(rows, keys)
        assert got.columns == rows.columns
        found = {r.id for r in got.collect()}
        assert set(range(share)) <= found and len(found) <= share + 0.15 * 20_000
    assert text.perhaps_in(rows.limit(0), rows).count() == 0


def test_few_texts_reach_python_at_once(spark):
    docs = spark.range(20_000, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    before = spark.conf.get(text.BATCH_ROWS)
    try:
        for given, most in (("10000", 1024), ("0", 1024), ("100", 100)):
            spark.conf.set(text.BATCH_ROWS, given)
            toxicity.term_counts(docs, ["a"])
            sizes = docs.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long")
            got = [r.n for r in sizes.collect()]
            assert sum(got) == 20_000 and max(got) == most
    finally:
        spark.conf.set(text.BATCH_ROWS, before)
