"""Inventory recommendation from a forecast and a stock table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAFETY_FACTOR = 0.2  # fixed value: safety stock = 20 % of the first week's demand
WEEK = 7


def inventory_recommendations(forecast: DataFrame, stock: DataFrame) -> DataFrame:
    """One row per stock row (center, item, current_stock, lead_time), repeated rows included.

    lead demand = sum of the first ``lead_time`` forecast days, expected
    demand = first 7 days; safety = 0.2 x expected; reorder point = lead +
    safety; order = max(0, reorder - stock); risk = max(0, (lead - stock) /
    lead x 100), 0 when lead demand is 0.  A pair without forecast rows
    gets zeros.  ``forecast`` needs (center, item, step, forecast) with
    step 1-based and without gaps.  ``covered`` is false where the forecast ends
    before the lead time or the first week does: the sums are then of the days
    there are.  No limit on the lead time; NULL or negative counts as 0 days.

    The forecast is folded per (center, item) before any stock row is joined, so
    stock rows never multiply demand.
    """
    key = ["center", "item"]
    days = Window.partitionBy(*key).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    upto = forecast.select(*key, "step", F.sum("forecast").over(days).alias("lead_demand"))
    whole = forecast.groupBy(*key).agg(
        F.max("step").alias("n_days"),
        F.sum(F.when(F.col("step") <= WEEK, F.col("forecast"))).alias("week_demand"),
    )
    lead = F.greatest(F.coalesce("lead_time", F.lit(0)), F.lit(0))
    rows = stock.select(*key, "current_stock", "lead_time").join(whole, key, "left")
    rows = rows.withColumn("step", F.least(lead, F.coalesce("n_days", F.lit(0)))).join(upto, [*key, "step"], "left")
    lead_demand = F.coalesce("lead_demand", F.lit(0.0))
    week_demand = F.coalesce("week_demand", F.lit(0.0))
    sums = rows.select(
        *key,
        "current_stock",
        "lead_time",
        lead_demand.alias("lead_demand"),
        week_demand.alias("week_demand"),
        (F.coalesce("n_days", F.lit(0)) >= F.greatest(lead, F.lit(WEEK))).alias("covered"),
    )
    stock_col = F.col("current_stock").cast("double")
    safety = F.col("week_demand") * SAFETY_FACTOR
    reorder = F.col("lead_demand") + safety
    risk = F.when(
        F.col("lead_demand") > 0,
        F.greatest(F.lit(0.0), (F.col("lead_demand") - stock_col) / F.col("lead_demand") * 100),
    ).otherwise(F.lit(0.0))
    return sums.select(
        "center",
        "item",
        "current_stock",
        "lead_time",
        F.round(F.greatest(F.lit(0.0), reorder - stock_col), 2).alias("recommended_order"),
        F.round(reorder, 2).alias("reorder_point"),
        F.round(safety, 2).alias("safety_stock"),
        F.round(F.col("week_demand"), 2).alias("expected_demand"),
        F.round(risk, 2).alias("stock_out_risk"),
        "covered",
    )


def series_horizons(stock: DataFrame, at_least: int = WEEK) -> DataFrame:
    """(center, item, horizon): the days each stocked pair's own lead time and one week need."""
    lead = F.greatest(F.coalesce(F.max("lead_time"), F.lit(0)), F.lit(0))
    return stock.groupBy("center", "item").agg(F.greatest(lead + WEEK, F.lit(at_least)).cast("int").alias("horizon"))
