"""Training-results record (S5): written as JSON lines, read back with a
fixed schema; a missing record reads as an empty DataFrame."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS_SCHEMA = (
    "training_date string, model string, mae double, rmse double, mse double, mape double, "
    "is_best boolean, feature_columns array<string>"
)

# A history of runs.  Metrics and parameters are maps, so runs with other ones need no other schema; a file written
# before a column was added reads as NULL there.
RUNS_SCHEMA = "experiment string, run_id string, started string, metrics map<string,double>, params map<string,string>"


def append_runs(runs: DataFrame, path: str) -> None:
    """Add runs (any columns of ``RUNS_SCHEMA``) to the JSON history at ``path``; earlier files stay as they are."""
    runs.coalesce(1).write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs of the history; none if there is no history yet."""
    try:
        return spark.read.schema(RUNS_SCHEMA).json(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return spark.createDataFrame([], RUNS_SCHEMA)
        raise


def training_record(metrics: DataFrame, best: str, features: list[str], when: str | None = None) -> DataFrame:
    """One row per model: date, metrics, best flag, feature list."""
    stamp = when or datetime.now(timezone.utc).isoformat()
    return metrics.select(
        F.lit(stamp).alias("training_date"),
        "model",
        "mae",
        "rmse",
        "mse",
        "mape",
        (F.col("model") == F.lit(best)).alias("is_best"),
        F.array(*[F.lit(f) for f in features]).alias("feature_columns"),
    )


def write_record(record: DataFrame, path: str) -> None:
    record.coalesce(1).write.mode("overwrite").json(path)


def read_record(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(RESULTS_SCHEMA).json(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return spark.createDataFrame([], RESULTS_SCHEMA)
        raise
