"""Synthetic demand panel (S6): days x centers x items with a keyword base
level, an annual sine wave, a weekend uplift and optional Gaussian noise.

Generated in parallel: the (center, item) pairs are exploded from literal
arrays, the days are exploded per pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandkit.functions.rules import (
    SAMPLE_CENTERS,
    SAMPLE_END,
    SAMPLE_FLOOR,
    SAMPLE_ITEMS,
    SAMPLE_START,
    WEEKEND_FACTOR,
    annual_wave,
    normal,
    sample_base,
)
from demandkit.spec import PanelSpec


def synthetic_panel(
    spark: SparkSession,
    start: str = SAMPLE_START,
    end: str = SAMPLE_END,
    centers=SAMPLE_CENTERS,
    items=SAMPLE_ITEMS,
    noise_sd: float = 0.0,
    seed: int = 42,
    spec: PanelSpec = PanelSpec(),
) -> DataFrame:
    """``max(floor, int(base x wave x weekend + N(0, noise_sd)))`` per day."""
    one = spark.range(1)
    pairs = one.select(F.explode(F.array(*[F.lit(c) for c in centers])).alias("center")).select(
        "center", F.explode(F.array(*[F.lit(i) for i in items])).alias("item")
    )
    days = F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("INTERVAL 1 DAY"))
    rows = pairs.repartition(max(1, min(len(centers) * len(items), 64))).select(
        "center", "item", F.explode(days).alias("d")
    )
    level = sample_base(F.col("item")) * annual_wave(F.dayofyear("d"))
    level = level * F.when(F.weekday("d") >= 5, F.lit(WEEKEND_FACTOR)).otherwise(F.lit(1.0))
    if noise_sd:
        level = level + normal(F.col("center"), F.col("item"), F.col("d"), F.lit(seed)) * F.lit(noise_sd)
    demand = F.greatest(F.lit(SAMPLE_FLOOR), level.cast("long")).cast("double")
    return rows.select(
        F.col("d").cast("timestamp_ntz").alias(spec.date),
        F.col("center").alias(spec.center),
        F.col("item").alias(spec.item),
        demand.alias(spec.target),
    )
