"""Distributed consecutive row index (0..n-1 in a given order).

``row_number()`` over an unpartitioned window funnels every row through
one task.  Instead: range-partition on the order columns, sort inside each
partition, pin the layout with a reliable checkpoint (so partition ids and
positions survive recomputation), then add per-partition offsets computed
from a table that has one row per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandkit.session import default_parallelism, ensure_checkpoint_dir

_POSITION_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits


def dense_index(df: DataFrame, order_cols, index_col: str = "idx", num_partitions: int | None = None) -> DataFrame:
    """Append ``index_col`` (BIGINT) numbering rows 0..n-1 by ``order_cols``.

    Eager: runs the range sample, the shuffle and the checkpoint write.
    Ties in ``order_cols`` get distinct but arbitrary (stable) indexes.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    order_cols = list(order_cols)
    n = num_partitions or default_parallelism(spark)
    pinned = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols).checkpoint(eager=True)
    part = F.spark_partition_id()
    located = pinned.select(
        "*",
        part.alias("_part"),
        (F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), _POSITION_BITS)).alias("_pos"),
    )
    sizes = located.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: an unpartitioned window here is bounded by n.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        located.join(F.broadcast(offsets), "_part")
        .withColumn(index_col, (F.col("_offset") + F.col("_pos")).cast("long"))
        .drop("_part", "_pos", "_offset")
    )
