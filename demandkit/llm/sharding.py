"""Consistent-hash ring with virtual nodes and bounded loads.

The ring has 2^16 cells.  Every shard owns the arcs that end at its virtual
nodes, and a row's cell comes from a hash of its key.  Shards have exact
capacities (counts at most one apart).  Going once around the ring, each arc
fills its owner and what does not fit continues clockwise to the next shard
with room.  Only arc counts enter that walk (a table whose size depends on the
parameters, never on the rows), and rows find their place by rank: a window per
ring cell plus prefix counts.  Nothing else of a row is shuffled than its key
columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARDS = 24
VIRTUAL_NODES = 128
CELL_BITS = 16


def ring(spark: SparkSession, shards: int, virtual_nodes: int, cell_bits: int = CELL_BITS) -> DataFrame:
    """(arc, cell, walk): the virtual nodes in ring order; ``walk`` lists all shards as met clockwise from there.

    Two virtual nodes in one cell are one, of the smaller hash.
    """
    spot = F.xxhash64(F.lit("virtual node"), "shard", "replica")
    nodes = (
        spark.range(shards * virtual_nodes, numPartitions=1)
        .select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("replica"))
        .select("shard", spot.alias("spot"), F.shiftrightunsigned(spot, 64 - cell_bits).cast("int").alias("cell"))
        .groupBy("cell")
        .agg(F.min_by("shard", "spot").alias("shard"))
    )
    order = W.orderBy("cell")
    arcs = nodes.withColumn("arc", F.row_number().over(order) - 1).withColumn("n_arcs", F.count("*").over(W.partitionBy()))
    # Clockwise distance to each shard's next virtual node, wrapping around once.
    back = W.orderBy(F.col("arc").desc()).rowsBetween(W.unboundedPreceding, 0)
    met = []
    for s in range(shards):
        at = F.when(F.col("shard") == s, F.col("arc"))
        ahead = F.coalesce(F.last(at, ignorenulls=True).over(back), F.min(at).over(W.partitionBy()) + F.col("n_arcs"))
        met.append(F.struct(ahead.alias("at"), F.lit(s).alias("shard")))
    walk = F.transform(F.filter(F.array_sort(F.array(*met)), lambda x: x["at"].isNotNull()), lambda x: x["shard"])
    return arcs.select("arc", "cell", walk.alias("walk"))


def _cells(spark: SparkSession, arcs: DataFrame, cell_bits: int) -> DataFrame:
    """(cell, arc, clock) of every cell; ``clock`` orders the cells of an arc clockwise."""
    n = 1 << cell_bits
    ends = arcs.select("arc", F.col("cell").alias("end")).withColumn(
        "start", F.lag("end").over(W.orderBy("end"))
    )
    last = F.max("end").over(W.partitionBy())
    spans = ends.select("arc", "end", F.coalesce("start", last - n).alias("start"))
    return spans.select("arc", F.explode(F.sequence(F.col("start") + 1, F.col("end"))).alias("clock")).select(
        F.pmod(F.col("clock"), F.lit(n)).alias("cell"), "arc", "clock"
    )


# One pass around the ring.  acc.load: rows in each shard; acc.out: what each arc put where.
_WALK = """
aggregate(
  arcs,
  named_struct('load', array_repeat(0L, {shards}), 'out', cast(array() as array<struct<arc:int,lo:bigint,hi:bigint,shard:int,slot:bigint>>)),
  (acc, x) -> aggregate(
    x.walk,
    named_struct('load', acc.load, 'out', acc.out, 'done', 0L),
    (s, t) -> if(
      s.done < x.n and element_at(s.load, t + 1) < room(t),
      named_struct(
        'load', transform(s.load, (v, i) -> if(i = t, v + least(x.n - s.done, room(t) - v), v)),
        'out', concat(s.out, array(named_struct(
          'arc', x.arc, 'lo', s.done, 'hi', s.done + least(x.n - s.done, room(t) - element_at(s.load, t + 1)),
          'shard', t, 'slot', element_at(s.load, t + 1)))),
        'done', s.done + least(x.n - s.done, room(t) - element_at(s.load, t + 1))),
      s),
    s -> named_struct('load', s.load, 'out', s.out)),
  acc -> acc.out)
"""


def place(rows: DataFrame, key: str, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, cell_bits: int = CELL_BITS) -> DataFrame:
    """``rows`` with shard (0-based) and slot (gapless from 0 in its shard); counts differ by at most one.

    ``key`` decides a row's place on the ring; pass narrow rows, since they are
    shuffled whole.  Rows with equal keys are ordered by all other columns, so
    only rows that are alike in every column are interchangeable.  A NULL key
    is spread by the other columns.  An empty table gives an empty result.
    Other columns may have any name; one called shard or slot is replaced.
    """
    spark = rows.sparkSession
    # Names of our own meanwhile, so that none of the input's can clash.
    names = {f"c{i}": c for i, c in enumerate(rows.columns)}
    key = f"c{rows.columns.index(key)}"
    rows = rows.toDF(*names)
    others = [c for c in names if c != key]
    spot = F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(*[F.col(c) for c in others] or [F.lit(0)]))
    placed = rows.withColumn("_spot", spot).withColumn("_cell", F.shiftrightunsigned("_spot", 64 - cell_bits).cast("int"))
    counts = placed.groupBy("_cell").agg(F.count("*").alias("n"))
    arcs = ring(spark, shards, virtual_nodes, cell_bits)
    cells = _cells(spark, arcs, cell_bits).join(counts, F.col("cell") == F.col("_cell"), "left")
    cells = cells.select("cell", "arc", "clock", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    before = F.sum("n").over(W.partitionBy("arc").orderBy("clock")) - F.col("n")
    offsets = cells.select(F.col("cell").alias("_cell"), F.col("arc").alias("_arc"), before.alias("_before"))
    totals = cells.groupBy("arc").agg(F.sum("n").alias("n"))
    loads = arcs.join(totals, "arc").agg(
        F.array_sort(F.collect_list(F.struct("arc", "n", "walk"))).alias("arcs"), F.sum("n").alias("total")
    )
    room = f"(total div {shards} + if({{0}} < total % {shards}, 1L, 0L))"
    walk = _WALK.format(shards=shards).replace("room(t)", room.format("t"))
    pieces = loads.select(F.explode(F.expr(walk)).alias("p")).select(*[F.col(f"p.{c}").alias(f"_{c}") for c in ("lo", "hi", "shard", "slot")], F.col("p.arc").alias("_on"))
    # Both tables are bounded by the ring: 2^cell_bits cells, and a piece per arc and per shard that it fills.
    rank = F.row_number().over(W.partitionBy("_cell").orderBy("_spot", key, *others)) - 1
    ranked = placed.withColumn("_n", rank).join(F.broadcast(offsets), "_cell").withColumn("_rank", F.col("_before") + F.col("_n"))
    here = (F.col("_arc") == F.col("_on")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    return ranked.join(F.broadcast(pieces), here).select(
        *[F.col(c).alias(name) for c, name in names.items() if name not in ("shard", "slot")],
        F.col("_shard").alias("shard"),
        (F.col("_slot") + F.col("_rank") - F.col("_lo")).alias("slot"),
    )
