"""Registered queries against their SQL, and what the registry promises."""

import os

import pytest
from compare_oracle import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_one_query_for_each_operator():
    from __spark_entry__ import queries

    numbers = sorted(int(n[2:].split("_")[0]) for n in queries() if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in queries()


def test_sql_queries(spark):
    from demandkit.llm.oracle import SQL

    result = compare(spark, SF, sorted(SQL))
    assert all(v == "OK" for v in result.values()), result


def test_every_document_once(spark):
    from __spark_entry__ import queries

    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_toxicity", "op2_sharding", "op5_quality", "op6_token_count", "op7_simhash", "op11_minhash", "op12_merkle", "op13_fill_middle"):
        got = queries()[name](spark, SF)
        assert got.count() == n == got.select("doc_id").distinct().count(), name
