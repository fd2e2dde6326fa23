"""Distribution drift between a reference and a current table.

KS statistic, distributed and exact:

1. unpivot the numeric columns to (column_name, value), tag the side;
2. ``groupBy(column_name, value)`` -> per-side counts (partial aggregation
   collapses hot values, ties handled), pinned with a reliable checkpoint;
3. range-partition the distinct values on (column, value) into
   ceil(rows / ``rows_per_task``) partitions and pin that layout, so a task
   never grows with a column;
4. per-(partition, column) totals -> exclusive prefix offsets (a table with one
   row per partition and column, broadcast);
5. running sums in a window over (partition, column) + offsets give both
   empirical CDFs at every distinct value; D = max |F_ref - F_cur|.

Means and standard deviations come from the same counts, so a report reads each
table once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StructType

from demandkit.functions.stats import ks_pvalue, sample_kurtosis, sample_skewness, severity
from demandkit.session import ensure_checkpoint_dir

NAME = "column_name"
# Distinct values per task of the KS window: about 50 MB of rows.
ROWS_PER_TASK = 1_000_000
REPORT = f"{NAME} string, ks_statistic double, p_value double, drift_detected boolean, mean_shift double, severity string"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType)]


def shared_numeric_columns(reference: DataFrame, current: DataFrame) -> list[str]:
    """Reference numeric columns that the current table also has (numeric)."""
    cur = set(numeric_columns(current))
    return [c for c in numeric_columns(reference) if c in cur]


def _c(name: str):
    return F.col(f"`{name}`")


def _long(df: DataFrame, columns) -> DataFrame:
    """(column_name, value DOUBLE) without NULL / NaN values."""
    if not columns:
        return df.sparkSession.createDataFrame([], f"{NAME} string, value double")
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias(NAME), _c(c).cast("double").alias("value")) for c in columns])
    ).alias("_kv")
    out = df.select(pairs).select(f"_kv.{NAME}", "_kv.value")
    return out.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def column_moments(df: DataFrame, columns=None, by: str | None = None) -> DataFrame:
    """Count, mean, sample std, skew (G1), excess kurtosis (G2) per
    numeric column - one aggregation pass (per ``by`` group), then unpivoted."""
    columns = list(columns) if columns is not None else [c for c in numeric_columns(df) if c != by]
    if not columns:
        moments = f"{NAME} string, count long, mean double, std double, skew double, kurtosis double"
        side = [df.schema[by]] if by else []
        return df.sparkSession.createDataFrame([], StructType(side + StructType.fromDDL(moments).fields))
    aggs = []
    for i, c in enumerate(columns):
        x = F.nanvl(_c(c).cast("double"), F.lit(None).cast("double"))
        aggs += [
            F.count(x).alias(f"n{i}"),
            F.avg(x).alias(f"m{i}"),
            F.stddev_samp(x).alias(f"s{i}"),
            sample_skewness(x).alias(f"k{i}"),
            sample_kurtosis(x).alias(f"u{i}"),
        ]
    wide = df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias(NAME),
                    F.col(f"n{i}").alias("count"),
                    F.col(f"m{i}").alias("mean"),
                    F.col(f"s{i}").alias("std"),
                    F.col(f"k{i}").alias("skew"),
                    F.col(f"u{i}").alias("kurtosis"),
                )
                for i, c in enumerate(columns)
            ]
        )
    ).alias("_m")
    return wide.select(*([by] if by else []), rows).select(*([by] if by else []), "_m.*")


def value_counts(reference: DataFrame, current: DataFrame, columns) -> DataFrame:
    """(column_name, value, c_ref, c_cur) for every distinct value of either side."""
    both = _long(reference, columns).withColumn("_cur", F.lit(0)).unionByName(
        _long(current, columns).withColumn("_cur", F.lit(1))
    )
    return both.groupBy(NAME, "value").agg(F.sum(1 - F.col("_cur")).alias("c_ref"), F.sum("_cur").alias("c_cur"))


def pinned_counts(counts: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``counts`` laid out by (column, value), written to the checkpoint folder (eager).

    The layout is on disk, so partition ids and positions survive a lost
    executor, and nothing stays cached.  Counts that fit one task's share are
    one partition; more are range-partitioned first."""
    ensure_checkpoint_dir(counts.sparkSession)
    pinned = counts.checkpoint(eager=True)
    parts = max(1, math.ceil(pinned.count() / rows_per_task))
    if parts == 1:
        return pinned.coalesce(1)
    return pinned.repartitionByRange(parts, NAME, "value").checkpoint(eager=True)


def ks_statistic(reference: DataFrame, current: DataFrame, columns=None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """K1: (column_name, n_ref, n_cur, ks_statistic) for each shared numeric column."""
    columns = list(columns) if columns is not None else shared_numeric_columns(reference, current)
    return ks_from_counts(pinned_counts(value_counts(reference, current, columns), rows_per_task), columns)


def ks_from_counts(pinned: DataFrame, columns) -> DataFrame:
    """K1 from per-(column_name, value) side counts ``c_ref`` / ``c_cur`` as ``pinned_counts`` lays them out."""
    spark = pinned.sparkSession
    placed = pinned.withColumn("_part", F.spark_partition_id())
    totals = placed.groupBy("_part", NAME).agg(F.sum("c_ref").alias("b_ref"), F.sum("c_cur").alias("b_cur"))
    # One row per partition and column; range partitions follow each other in value order.
    before = Window.partitionBy(NAME).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(NAME)
    offsets = totals.select(
        NAME,
        "_part",
        F.coalesce(F.sum("b_ref").over(before), F.lit(0)).alias("o_ref"),
        F.coalesce(F.sum("b_cur").over(before), F.lit(0)).alias("o_cur"),
        F.sum("b_ref").over(everything).alias("n_ref"),
        F.sum("b_cur").over(everything).alias("n_cur"),
    )
    running = Window.partitionBy("_part", NAME).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    cdfs = placed.join(F.broadcast(offsets), [NAME, "_part"]).select(
        NAME,
        "n_ref",
        "n_cur",
        F.abs(
            F.try_divide(F.col("o_ref") + F.sum("c_ref").over(running), F.col("n_ref"))
            - F.try_divide(F.col("o_cur") + F.sum("c_cur").over(running), F.col("n_cur"))
        ).alias("_gap"),
    )
    d = cdfs.groupBy(NAME).agg(
        F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"), F.max("_gap").alias("ks_statistic")
    )
    present = spark.createDataFrame([(c,) for c in columns], f"{NAME} string")
    return present.join(d, NAME, "left").select(
        NAME,
        F.coalesce(F.col("n_ref"), F.lit(0)).cast("long").alias("n_ref"),
        F.coalesce(F.col("n_cur"), F.lit(0)).cast("long").alias("n_cur"),
        "ks_statistic",
    )


def ks_test(
    reference: DataFrame, current: DataFrame, columns=None, rows_per_task: int = ROWS_PER_TASK, method: str = "auto"
) -> DataFrame:
    """K1 + K2: KS statistic and its two-sided p-value (both NULL where a side has no values).

    ``method`` is auto (exact for small samples), exact or asymptotic."""
    ks = ks_statistic(reference, current, columns, rows_per_task)
    return ks.withColumn("p_value", ks_pvalue("ks_statistic", "n_ref", "n_cur", method))


def _moments_from_counts(pinned: DataFrame) -> DataFrame:
    """(column_name, ref_mean, ref_std, cur_mean): deviations from the mean, so large offsets cost no digits."""
    n_ref, n_cur = F.sum("c_ref").cast("double"), F.sum("c_cur").cast("double")
    means = pinned.groupBy(NAME).agg(
        F.try_divide(F.sum(F.col("c_ref") * F.col("value")), n_ref).alias("ref_mean"),
        F.try_divide(F.sum(F.col("c_cur") * F.col("value")), n_cur).alias("cur_mean"),
    )
    gap = F.col("value") - F.col("ref_mean")
    # One row per column: broadcast is safe.
    spread = pinned.join(F.broadcast(means), NAME).groupBy(NAME).agg(
        F.sqrt(F.try_divide(F.sum(F.col("c_ref") * gap * gap), n_ref - 1)).alias("ref_std")
    )
    return means.join(F.broadcast(spread), NAME)


def _report(pinned: DataFrame, columns, stats: DataFrame, threshold: float, method: str) -> DataFrame:
    ks = ks_from_counts(pinned, columns).withColumn("p_value", ks_pvalue("ks_statistic", "n_ref", "n_cur", method))
    # One row per column on both sides: broadcast is safe.
    return ks.join(F.broadcast(stats), NAME, "left").select(
        NAME,
        "ks_statistic",
        "p_value",
        (F.col("p_value") < F.lit(threshold)).alias("drift_detected"),
        F.try_divide(F.abs(F.col("ref_mean") - F.col("cur_mean")), F.col("ref_std")).alias("mean_shift"),
        severity("p_value").alias("severity"),
    )


def drift_report(
    reference: DataFrame,
    current: DataFrame,
    threshold: float = 0.05,
    columns=None,
    rows_per_task: int = ROWS_PER_TASK,
    method: str = "auto",
) -> DataFrame:
    """K4: per shared numeric column: KS statistic, p-value, drift flag
    (p < threshold), mean shift |mu_ref - mu_cur| / sd_ref, severity.

    A column without values on a side keeps its row with NULL everywhere (there
    is nothing to compare); no shared numeric column gives an empty report."""
    columns = list(columns) if columns is not None else shared_numeric_columns(reference, current)
    if not columns:
        return reference.sparkSession.createDataFrame([], REPORT)
    pinned = pinned_counts(value_counts(reference, current, columns), rows_per_task)
    return _report(pinned, columns, _moments_from_counts(pinned), threshold, method)


@dataclass(frozen=True)
class ReferenceProfile:
    """What a drift check needs from the reference table, computed once:
    per-(column_name, value) counts (``c_cur`` = 0) and per-column mean /
    sample std.  Both are pinned with a reliable checkpoint, so repeated
    checks (e.g. one per stream micro-batch) neither rescan the reference
    nor rebuild its lineage."""

    columns: tuple[str, ...]
    counts: DataFrame
    stats: DataFrame


def reference_profile(reference: DataFrame, columns=None) -> ReferenceProfile:
    """Build the ``ReferenceProfile`` of ``reference`` (eager: two jobs)."""
    ensure_checkpoint_dir(reference.sparkSession)
    columns = tuple(columns) if columns is not None else tuple(numeric_columns(reference))
    counts = (
        _long(reference, columns)
        .groupBy(NAME, "value")
        .agg(F.count(F.lit(1)).alias("c_ref"))
        .withColumn("c_cur", F.lit(0).cast("long"))
        .checkpoint(eager=True)
    )
    stats = (
        column_moments(reference, columns)
        .select(NAME, F.col("mean").alias("ref_mean"), F.col("std").alias("ref_std"))
        .checkpoint(eager=True)
    )
    return ReferenceProfile(columns, counts, stats)


def drift_report_from_profile(
    profile: ReferenceProfile,
    current: DataFrame,
    threshold: float = 0.05,
    rows_per_task: int = ROWS_PER_TASK,
    method: str = "auto",
) -> DataFrame:
    """K4 against a precomputed reference profile; same output as
    ``drift_report(reference, current)``.  Only ``current`` is scanned, and
    nothing stays cached."""
    cur_numeric = set(numeric_columns(current))
    columns = [c for c in profile.columns if c in cur_numeric]
    if not columns:
        return current.sparkSession.createDataFrame([], REPORT)
    cur_counts = (
        _long(current, columns)
        .groupBy(NAME, "value")
        .agg(F.count(F.lit(1)).alias("c_cur"))
        .select(NAME, "value", F.lit(0).cast("long").alias("c_ref"), "c_cur")
    )
    counts = profile.counts.filter(F.col(NAME).isin(columns)).unionByName(cur_counts).groupBy(NAME, "value").agg(
        F.sum("c_ref").alias("c_ref"), F.sum("c_cur").alias("c_cur")
    )
    pinned = pinned_counts(counts, rows_per_task)
    mean = F.try_divide(F.sum(F.col("c_cur") * F.col("value")), F.sum("c_cur").cast("double"))
    cur = pinned.groupBy(NAME).agg(mean.alias("cur_mean"))
    return _report(pinned, columns, profile.stats.join(F.broadcast(cur), NAME), threshold, method)


def drift_alerts(report: DataFrame) -> DataFrame:
    """K5: columns whose drift severity is high (a column without values is not: its severity is NULL)."""
    return report.filter(F.col("severity") == "high").select(NAME)
