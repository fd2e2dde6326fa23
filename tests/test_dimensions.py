from datetime import datetime

from pyspark.sql import functions as F

from demandkit.sources import testdata


def _tables(spark, folder, parts):
    spark.range(parts).select(F.col("id").alias("p_partkey"), F.lit("t").alias("p_type")).write.parquet(f"{folder}/part.parquet")
    small = {
        "supplier": ([(1, 1)], "s_suppkey long, s_nationkey long"),
        "nation": ([(1, "N", 1)], "n_nationkey long, n_name string, n_regionkey long"),
        "region": ([(1, "R")], "r_regionkey long, r_name string"),
        "lineitem": (
            [(1, k, 1, 1, 2.0, 10.0, datetime(2024, 1, 1)) for k in (0, parts - 1, parts - 1, parts, None)],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp",
        ),
    }
    for name, (rows, schema) in small.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_only_small_dimensions_are_broadcast(spark, tmp_out):
    for parts in (10, testdata.BROADCAST_ROWS + 1):
        _tables(spark, f"{tmp_out}/{parts}", parts)
        out = testdata.sales(spark, f"{tmp_out}/{parts}")
        assert [(r.center, r.item, r.pay_weight) for r in out.collect()] == [("R", "t", 2.0)] * 3
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin [l_partkey" in plan) == (parts == 10)
        assert ("SortMergeJoin [l_partkey" in plan) == (parts > 10)
        assert "BroadcastHashJoin [l_suppkey" in plan
