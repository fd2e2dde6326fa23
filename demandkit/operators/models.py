"""Gradient-boosted demand models on Spark ML.

Both reference model families are expressed as ``GBTRegressor`` shapes in
a ``Pipeline([VectorAssembler, GBTRegressor])``: executors own the fit,
the feature list lives in the assembler stage, and long boosting runs cut
lineage through the session's checkpoint directory.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandkit.operators.clean import drop_null_target, fill_features
from demandkit.operators.forecast import future_frame, last_n_rows, model_forecast
from demandkit.operators.metrics import accuracy, best_model
from demandkit.operators.split import expanding_folds, split_by_date, split_rows_tail
from demandkit.session import ensure_checkpoint_dir
from demandkit.spec import FeatureConfig, PanelSpec, feature_columns, validate_model


@dataclass(frozen=True)
class BoostingParams:
    max_iter: int = 100
    step_size: float = 0.1
    max_depth: int = 6
    min_instances_per_node: int = 1
    subsampling_rate: float = 1.0
    max_bins: int = 32
    seed: int = 42
    checkpoint_interval: int = 10
    # Early stopping: the last share of the training days judges each round; boosting ends when a round improves the
    # error there by less than the tolerance (relative).  0 boosts all rounds on all training rows.
    validation_share: float = 0.0
    validation_tol: float = 0.01


# The two model shapes.  "xgboost": 100 rounds, lr 0.1,
# depth 6.  "lightgbm": 100 rounds, lr 0.1, leaf-wise trees capped at 31
# leaves with >= 20 rows per leaf, approximated by depth 5 / 20 rows.
MODEL_PARAMS = {
    "xgboost": BoostingParams(max_iter=100, step_size=0.1, max_depth=6),
    "lightgbm": BoostingParams(max_iter=100, step_size=0.1, max_depth=5, min_instances_per_node=20),
}


VALIDATION = "_validation"


def build_estimator(features: list[str], label: str, params: BoostingParams) -> Pipeline:
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    gbt = GBTRegressor(
        featuresCol="features",
        labelCol=label,
        predictionCol="prediction",
        maxIter=params.max_iter,
        stepSize=params.step_size,
        maxDepth=params.max_depth,
        minInstancesPerNode=params.min_instances_per_node,
        subsamplingRate=params.subsampling_rate,
        maxBins=params.max_bins,
        seed=params.seed,
        maxMemoryInMB=1024,  # a tree level in one pass over the rows
        checkpointInterval=params.checkpoint_interval,
    )
    if params.validation_share > 0:
        gbt = gbt.setValidationIndicatorCol(VALIDATION).setParams(validationTol=params.validation_tol)
    return Pipeline(stages=[assembler, gbt])


def prepare(df: DataFrame, spec: PanelSpec = PanelSpec()) -> tuple[DataFrame, list[str]]:
    """P8 + P9 + P7: drop NULL targets, pick features, NULL features -> 0."""
    features = feature_columns(df.columns, spec)
    out = fill_features(drop_null_target(df, spec), spec)
    return out.withColumn(spec.target, F.col(f"`{spec.target}`").cast("double")), features


def split(df: DataFrame, spec: PanelSpec, test_size: float = 0.2, how: str = "date") -> tuple[DataFrame, DataFrame]:
    """``how='date'`` (last days are test) or ``'rows'`` (last rows in
    (center, item, date) order are test - the original, series-wise split)."""
    if how == "date":
        labelled = split_by_date(df, spec, test_size)
    elif how == "rows":
        labelled = split_rows_tail(df, spec, test_size).drop("row_index")
    else:
        raise ValueError(f"unknown split {how!r}")
    train = labelled.filter(F.col("split") == "train").drop("split")
    test = labelled.filter(F.col("split") == "test").drop("split")
    return train, test


# Rows per training partition.  Each boosting round runs one job per tree
# level over every partition, so on small inputs extra partitions are pure
# scheduling overhead; large inputs still get one partition per ~500k rows.
ROWS_PER_TRAIN_PARTITION = 500_000


def training_layout(train: DataFrame) -> DataFrame:
    """Coalesce (no shuffle) to max(cores, rows / ROWS_PER_TRAIN_PARTITION)
    partitions when the input has more than that."""
    spark = train.sparkSession
    rows = train.count()
    target = max(spark.sparkContext.defaultParallelism, math.ceil(rows / ROWS_PER_TRAIN_PARTITION))
    return train.coalesce(target) if train.rdd.getNumPartitions() > target else train


def mark_validation(train: DataFrame, spec: PanelSpec, share: float) -> DataFrame:
    """``train`` with a boolean column: whether the row's day is among the last ``share`` of the days."""
    marked = split_by_date(train, spec, share)
    return marked.withColumn(VALIDATION, F.col("split") == "test").drop("split")


def rounds_kept(model: PipelineModel) -> int:
    """Boosting rounds of a fitted model: fewer than ``max_iter`` if it stopped early."""
    return model.stages[-1].getNumTrees


def fit(train: DataFrame, features: list[str], spec: PanelSpec, params: BoostingParams) -> PipelineModel:
    """Fit one boosted-tree pipeline."""
    return fit_all(train, features, spec, {"model": params})["model"]


def fit_all(train: DataFrame, features: list[str], spec: PanelSpec, params: dict[str, BoostingParams]) -> dict[str, PipelineModel]:
    """Fit every model shape concurrently (one driver thread each).

    A boosting round is a chain of small jobs, so fits submitted from
    separate threads overlap their scheduling latency and share the
    executors; the models are the same as fitted one after another.  All fits
    read one persisted copy of the rows, released when the last one is done."""
    ensure_checkpoint_dir(train.sparkSession)
    cached = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        laid_out = training_layout(cached)
        with ThreadPoolExecutor(max_workers=max(1, len(params))) as pool:
            estimators = {name: build_estimator(features, spec.target, p) for name, p in params.items()}
            shares = {p.validation_share for p in params.values() if p.validation_share > 0}
            rows = {share: mark_validation(laid_out, spec, share) for share in shares} | {0.0: laid_out}
            futures = {name: pool.submit(e.fit, rows[max(0.0, params[name].validation_share)]) for name, e in estimators.items()}
            return {name: f.result() for name, f in futures.items()}
    finally:
        cached.unpersist()


def predictions(model: PipelineModel, df: DataFrame, spec: PanelSpec) -> DataFrame:
    scored = model.transform(df)
    return scored.select(
        F.col(f"`{spec.center}`").alias("center"),
        F.col(f"`{spec.item}`").alias("item"),
        F.col(f"`{spec.date}`").alias("date"),
        F.col(f"`{spec.target}`").alias("actual"),
        F.col("prediction").alias("predicted"),
    )


def evaluate(model: PipelineModel, test: DataFrame, spec: PanelSpec, name: str) -> DataFrame:
    """A13 on the test rows: one row (model, mae, mse, rmse, mape)."""
    return accuracy(predictions(model, test, spec)).select(F.lit(name).alias("model"), "*")


def feature_importance(model: PipelineModel, top: int | None = 10) -> DataFrame:
    """R4 + T4: (feature, importance) from the fitted trees, largest first.

    One row per feature column - model metadata, not data."""
    assembler, gbt = model.stages[0], model.stages[-1]
    names = assembler.getInputCols()
    weights = gbt.featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    rows = [(n, float(w)) for n, w in zip(names, weights)]
    out = spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), F.asc("feature"))
    return out.limit(top) if top else out


def backtest(
    model: PipelineModel, df: DataFrame, spec: PanelSpec = PanelSpec(), n: int = 30, min_rows: int = 30
) -> DataFrame:
    """Score the last ``n`` rows of each series that has more than
    ``min_rows`` rows; pooled metrics over all of them (F6, W6, A13)."""
    # The window limit keeps at most max(n, min_rows + 1) rows of a series in
    # each map task, so neither the shuffle nor the count sees whole series.
    enough = last_n_rows(df, spec, max(n, min_rows + 1))
    series = Window.partitionBy(f"`{spec.center}`", f"`{spec.item}`")
    newest = series.orderBy(F.col(f"`{spec.date}`").desc())
    ranked = enough.withColumn("_n", F.count(F.lit(1)).over(series)).withColumn("_rn", F.row_number().over(newest))
    tail = ranked.filter((F.col("_n") > min_rows) & (F.col("_rn") <= n)).drop("_n", "_rn")
    return accuracy(predictions(model, tail, spec))


def df_of_rows(small: DataFrame) -> DataFrame:
    """A table of a few rows (one per model), evaluated now and kept as values."""
    return small.sparkSession.createDataFrame(small.collect(), small.schema)


@dataclass
class TrainingResult:
    models: dict[str, PipelineModel]
    metrics: DataFrame
    best: str
    features: list[str]
    rounds: dict[str, int]


def cross_validate(
    features_df: DataFrame,
    spec: PanelSpec = PanelSpec(),
    n_splits: int = 3,
    params: dict[str, BoostingParams] | None = None,
    gap: int = 0,
) -> DataFrame:
    """(model, fold, mae, mse, rmse, mape): every model fitted on each expanding window and judged on the days after it.

    The folds come from one pass (``expanding_folds``); the fits of a fold run
    together, and the metrics of all folds and models are one aggregate."""
    params = params or MODEL_PARAMS
    data, features = prepare(features_df, spec)
    folds = expanding_folds(data, spec, n_splits, gap).persist(StorageLevel.MEMORY_AND_DISK)
    scored = None
    for k in range(1, n_splits + 1):
        own = folds.filter(F.col("fold") == k)
        fitted = fit_all(own.filter("role = 'train'").drop("fold", "role"), features, spec, params)
        for name, model in fitted.items():
            rows = predictions(model, own.filter("role = 'test'"), spec).select(F.lit(name).alias("model"), F.lit(k).alias("fold"), "actual", "predicted")
            scored = rows if scored is None else scored.unionByName(rows)
    out = df_of_rows(accuracy(scored, by=["model", "fold"]))
    folds.unpersist()
    return out


def train_models(
    features_df: DataFrame,
    spec: PanelSpec = PanelSpec(),
    test_size: float = 0.2,
    split_how: str = "date",
    params: dict[str, BoostingParams] | None = None,
) -> TrainingResult:
    """Prepare -> split -> fit every model -> evaluate -> best (min RMSE)."""
    params = params or MODEL_PARAMS
    data, features = prepare(features_df, spec)
    train, test = split(data, spec, test_size, split_how)
    models = fit_all(train, features, spec, params)
    test = test.persist(StorageLevel.MEMORY_AND_DISK)
    parts = [evaluate(models[name], test, spec, name) for name in params]
    metrics = parts[0]
    for p in parts[1:]:
        metrics = metrics.unionByName(p)
    # One row per model: kept as a local table, so nothing stays cached.
    metrics = df_of_rows(metrics)
    test.unpersist()
    best = best_model(metrics).first()["model"]
    return TrainingResult(models, metrics, best, features, {name: rounds_kept(model) for name, model in models.items()})


def forecast(
    model: PipelineModel,
    history: DataFrame,
    horizon: int | str = 30,
    spec: PanelSpec = PanelSpec(),
    cfg: FeatureConfig = FeatureConfig(),
    series: DataFrame | None = None,
) -> DataFrame:
    """R5 + R6: model forecast for every series (or those in ``series``, each
    with its own horizon if ``horizon`` names a column there)."""
    fut = future_frame(history, horizon, spec, cfg, series=series)
    return model_forecast(model, fut, spec)


def save_models(result: TrainingResult, path: str) -> None:
    """One PipelineModel directory per model; metrics as JSON next to them."""
    for name, model in result.models.items():
        model.write().overwrite().save(f"{path.rstrip('/')}/{name}")


def load_model(path: str, name: str, available=tuple(MODEL_PARAMS)) -> PipelineModel:
    validate_model(name, available)
    return PipelineModel.load(f"{path.rstrip('/')}/{name}")


def params_record(params: dict[str, BoostingParams] | None = None) -> dict:
    return {k: asdict(v) for k, v in (params or MODEL_PARAMS).items()}
