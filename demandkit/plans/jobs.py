"""End-to-end jobs (B1-B4) composed from the operators.

Each job reads from and writes to paths (local, HDFS, S3...), so a run can
be resumed from its last written table, and intermediate tables double as
lineage cuts on a cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandkit.operators import clean, dense, drift, features, inventory, models, reports
from demandkit.sources import files, results
from demandkit.spec import FeatureConfig, PanelSpec


@dataclass
class FeatureJobResult:
    features: DataFrame
    summary: DataFrame
    top_items: DataFrame
    top_centers: DataFrame


def build_features(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    spec: PanelSpec = PanelSpec(),
    cfg: FeatureConfig = FeatureConfig(),
    input_format: str = "csv",
    partition_by: list[str] | None = None,
    observed_pairs_only: bool = False,
) -> FeatureJobResult:
    """B1: raw sales -> clean -> daily aggregate -> dense panel -> features
    -> Parquet (overwrite) -> summary, top-5 items and centers."""
    raw = files.read_sales_csv(spark, input_path) if input_format == "csv" else files.read_parquet(spark, input_path)
    cleaned = clean.clean_sales(raw, spec) if input_format == "csv" else raw
    clean.check_required(cleaned, spec)
    missing = [m for m in spec.measure_names if m not in cleaned.columns]
    if missing:
        raise KeyError(f"Missing measure columns: {missing}")
    daily = dense.daily_aggregate(cleaned, spec).persist(StorageLevel.MEMORY_AND_DISK)
    panel = dense.dense_panel(daily, spec, observed_only=observed_pairs_only)
    table = features.build_features(panel, spec, cfg)
    files.write_parquet(table, output_path, partition_by=partition_by, sort_within=[spec.center, spec.item, spec.date])
    daily.unpersist()
    written = files.read_parquet(spark, output_path)
    return FeatureJobResult(
        features=written,
        summary=reports.summary(written, spec),
        top_items=reports.top_k(written, spec.item, 5, spec),
        top_centers=reports.top_k(written, spec.center, 5, spec),
    )


def train(
    spark: SparkSession,
    features_path: str,
    models_path: str,
    results_path: str,
    spec: PanelSpec = PanelSpec(),
    test_size: float = 0.2,
    split_how: str = "date",
    params=None,
) -> models.TrainingResult:
    """B2: feature table -> fitted models, metrics, best model, JSON record."""
    table = files.read_parquet(spark, features_path)
    result = models.train_models(table, spec, test_size, split_how, params)
    models.save_models(result, models_path)
    results.write_record(results.training_record(result.metrics, result.best, result.features), results_path)
    return result


@dataclass
class ForecastJobResult:
    forecast: DataFrame
    recommendations: DataFrame | None
    backtest: DataFrame
    importances: DataFrame | None


def forecast_job(
    spark: SparkSession,
    features_path: str,
    models_path: str,
    model_name: str = "xgboost",
    horizon: int = 30,
    stock: DataFrame | None = None,
    spec: PanelSpec = PanelSpec(),
    cfg: FeatureConfig = FeatureConfig(),
    series: DataFrame | None = None,
) -> ForecastJobResult:
    """Model forecast for every series (or those in ``series``), back-test
    metrics, top feature importances (None for a model without trees), and (with
    a stock table) inventory recommendations.  A stocked pair is forecast as far as its own lead time
    and one week; the returned forecast ends at ``horizon``."""
    history = files.read_parquet(spark, features_path)
    model = models.load_model(models_path, model_name)
    fc = models.forecast(model, history, horizon, spec, cfg, series)
    recs = None
    if stock is not None:
        own = inventory.series_horizons(stock, horizon).select(
            F.col("center").alias(spec.center), F.col("item").alias(spec.item), "horizon"
        )
        recs = inventory.inventory_recommendations(models.forecast(model, history, "horizon", spec, cfg, own), stock)
    importances = models.feature_importance(model) if hasattr(model.stages[-1], "featureImportances") else None
    return ForecastJobResult(fc, recs, models.backtest(model, history, spec), importances)


def drift_job(
    spark: SparkSession, reference_path: str, current_path: str, threshold: float = 0.05, method: str = "auto"
) -> tuple[DataFrame, DataFrame]:
    """Drift report of two Parquet tables and its high-severity alerts."""
    ref = files.read_parquet(spark, reference_path)
    cur = files.read_parquet(spark, current_path)
    report = drift.drift_report(ref, cur, threshold, method=method)
    return report, drift.drift_alerts(report)


__all__ = ["build_features", "drift_job", "forecast_job", "train"]
