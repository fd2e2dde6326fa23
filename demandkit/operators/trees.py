"""Tree ensembles as node tables and as column expressions.

A node table has one row per node: (tree, weight, node, feature, threshold,
left, right, value, gain, n_rows); a leaf has no feature.  It can be read from a
fitted ensemble, stored as Parquet, and compiled into nested CASE columns, so
that a forecast is a plain projection: only the features that the trees ask for
are read, and no vectors are assembled.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandkit.session import ensure_checkpoint_dir

NODES = (
    "tree int, weight double, node int, feature string, threshold double, left int, right int, "
    "value double, gain double, n_rows long"
)
# Nodes of one compiled ensemble.  They are part of the plan; a larger ensemble is scored by its own model.
MAX_NODES = 20_000


def ensemble_nodes(model: PipelineModel) -> DataFrame:
    """The node table of a fitted pipeline (assembler, boosted trees), read from the model's own files."""
    assembler, trees = model.stages[0], model.stages[-1]
    spark = SparkSession.getActiveSession()
    path = f"{ensure_checkpoint_dir(spark)}/trees-{uuid.uuid4().hex}"
    trees.write().save(path)
    names = F.array(*[F.lit(n) for n in assembler.getInputCols()])
    weights = F.array(*[F.lit(float(w)) for w in trees.treeWeights])
    data = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    inner = F.col("split.featureIndex") >= 0
    return data.select(
        F.col("treeID").cast("int").alias("tree"),
        F.get(weights, F.col("treeID")).alias("weight"),
        F.col("id").cast("int").alias("node"),
        F.when(inner, F.get(names, F.col("split.featureIndex"))).alias("feature"),
        F.when(inner, F.get(F.col("split.leftCategoriesOrThreshold"), F.lit(0))).alias("threshold"),
        F.when(inner, F.col("leftChild")).cast("int").alias("left"),
        F.when(inner, F.col("rightChild")).cast("int").alias("right"),
        F.col("prediction").alias("value"),
        F.col("gain"),
        F.col("rawCount").cast("long").alias("n_rows"),
    )


def compile_nodes(nodes: DataFrame, max_nodes: int = MAX_NODES) -> Column:
    """The ensemble's prediction as one column: the weighted sum of a nested CASE per tree.

    A row goes left where the feature is at most the threshold; a NULL feature
    goes right, like a NaN.  An ensemble above ``max_nodes`` nodes raises."""
    rows = nodes.limit(max_nodes + 1).collect()
    if len(rows) > max_nodes:
        raise ValueError(f"more than {max_nodes} nodes: score with the model itself")
    trees: dict[int, dict[int, object]] = {}
    for r in rows:
        trees.setdefault(r["tree"], {})[r["node"]] = r

    def branch(own: dict, node: int) -> Column:
        r = own[node]
        if r["feature"] is None:
            return F.lit(float(r["value"]))
        goes_left = F.col(f"`{r['feature']}`") <= F.lit(float(r["threshold"]))
        return F.when(goes_left, branch(own, r["left"])).otherwise(branch(own, r["right"]))

    total = F.lit(0.0)
    for tree in sorted(trees):
        own = trees[tree]
        children = {c for r in own.values() for c in (r["left"], r["right"]) if r["feature"] is not None}
        (root,) = set(own) - children
        total = total + F.lit(float(own[root]["weight"])) * branch(own, root)
    return total


@dataclass(frozen=True)
class NodeTableModel:
    """A model with ``transform`` whose prediction is a compiled node table."""

    prediction: Column
    column: str = "prediction"

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.column, self.prediction)


def as_model(nodes: DataFrame) -> NodeTableModel:
    return NodeTableModel(compile_nodes(nodes))


def node_importance(nodes: DataFrame, top: int | None = 10) -> DataFrame:
    """R4 + T4: (feature, importance): gains weighted by rows, over all trees, to a sum of 1."""
    gains = nodes.filter("feature is not null").groupBy("feature").agg(F.sum(F.col("gain") * F.col("n_rows")).alias("g"))
    # One row per feature, so one window over all of them is small.
    out = gains.select("feature", F.try_divide(F.col("g"), F.sum("g").over(Window.partitionBy(F.lit(1)))).alias("importance"))
    out = out.orderBy(F.desc("importance"), F.asc("feature"))
    return out.limit(top) if top else out


def save_nodes(nodes: DataFrame, path: str) -> None:
    """The node table as Parquet."""
    nodes.coalesce(1).write.mode("overwrite").parquet(path)


def load_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODES).parquet(path)
