"""Accuracy metrics and model selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metric_columns(actual: str = "actual", predicted: str = "predicted") -> list:
    """mae, mse, rmse and mape (%) as aggregate expressions.

    MAPE only over rows with a positive actual; NULL when there are none.
    """
    y, p = F.col(actual), F.col(predicted)
    err = y - p
    mse = F.avg(err * err)
    return [
        F.avg(F.abs(err)).alias("mae"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        (F.avg(F.when(y > 0, F.abs(err / y))) * 100).alias("mape"),
    ]


def accuracy(df: DataFrame, actual: str = "actual", predicted: str = "predicted", by=None) -> DataFrame:
    """Pooled metrics, optionally per group (e.g. per model)."""
    cols = metric_columns(actual, predicted)
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def best_model(metrics: DataFrame, metric: str = "rmse", name: str = "model") -> DataFrame:
    """The row with the smallest ``metric`` (ties by name)."""
    return metrics.orderBy(F.asc_nulls_last(metric), F.asc(name)).limit(1)


def best_run(runs: DataFrame, experiment: str | None = None, metric: str = "rmse", metrics=("rmse", "mae", "mape")) -> DataFrame:
    """Best run per experiment by ``metric`` ascending, with the URI of its
    model; missing metric values read as 0.  With ``experiment`` only that experiment is kept.
    An experiment without runs yields no row."""
    if experiment is not None:
        runs = runs.filter(F.col("experiment") == F.lit(experiment))
    w = Window.partitionBy("experiment").orderBy(F.asc_nulls_last(metric), F.asc("run_id"))
    best = runs.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")
    best = best.withColumn("model_uri", F.format_string("runs:/%s/model", F.col("run_id")))
    return best.fillna(0, subset=[m for m in metrics if m in runs.columns])


def best_run_params(runs: DataFrame, keys: list[str], metric: str = "rmse") -> DataFrame:
    """A18 over runs as ``sources.results.read_runs`` returns them: (experiment, run_id, model_uri, metric, one column per key).

    Runs hold metrics and params as maps.  A key that the best run lacks is
    NULL, a missing metric sorts last and reads as 0, and an experiment without
    runs has no row."""
    flat = runs.select("experiment", "run_id", "params", F.try_element_at("metrics", F.lit(metric)).alias(metric))
    best = best_run(flat, metric=metric, metrics=(metric,))
    return best.select("experiment", "run_id", "model_uri", metric, *[F.try_element_at("params", F.lit(k)).alias(k) for k in keys])
