"""Forecast operators.

All series are handled in one job: per-series statistics are one window
or aggregate keyed by (center, item); horizons are generated with
``explode(sequence(...))`` per series row, so work is split by series and
no per-series Python loop exists.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandkit.functions.calendar import date_feature_columns, seasonal_feature_columns
from demandkit.functions.rules import (
    CONFIDENCE_RANGE,
    FORECAST_DEFAULT,
    FORECAST_FLOOR,
    FORECAST_RULES,
    PROJECTION_LOWER,
    PROJECTION_SEASONAL_AMPLITUDE,
    PROJECTION_TREND,
    PROJECTION_UPPER,
    RULE_LOWER,
    RULE_UPPER,
    SUMMER_FACTOR,
    SUMMER_MONTHS,
    WEEKEND_FACTOR,
    normal,
    rule_level,
    uniform,
)
from demandkit.operators.reports import monthly_by_series
from demandkit.operators.rules_table import match_rules
from demandkit.spec import FeatureConfig, PanelSpec, validate_horizon

RULE_NUMBERS = ("base", "amplitude", "frequency")

MODEL_LOWER, MODEL_UPPER = 0.8, 1.2  # fixed values: model forecast band


def _c(name: str):
    return F.col(f"`{name}`")


def last_n_rows(df: DataFrame, spec: PanelSpec = PanelSpec(), n: int = 30) -> DataFrame:
    """The last ``n`` rows (by date) of every series.

    ``row_number() <= n`` over (center, item) is planned as a
    WindowGroupLimit, so at most n rows per series leave each map task."""
    w = Window.partitionBy(_c(spec.center), _c(spec.item)).orderBy(_c(spec.date).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def last_window_stats(df: DataFrame, spec: PanelSpec = PanelSpec(), n: int = 30, measures=()) -> DataFrame:
    """A16 (+W7): per series, over its last ``n`` rows: mean, sample std,
    min, max of the target, mean of each measure, last date, row count."""
    tail = last_n_rows(df, spec, n)
    y = _c(spec.target)
    aggs = [
        F.max(_c(spec.date)).alias("last_date"),
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(y).alias("tail_mean"),
        F.stddev_samp(y).alias("tail_std"),
        F.min(y).cast("double").alias("tail_min"),
        F.max(y).cast("double").alias("tail_max"),
    ] + [F.avg(_c(m)).alias(f"tail_{m}") for m in measures]
    return tail.groupBy(_c(spec.center).alias(spec.center), _c(spec.item).alias(spec.item)).agg(*aggs)


def _last_step(horizon: int | str) -> Column:
    """The horizon as a column: a number of days within the request limits, or the name of a column."""
    if isinstance(horizon, str):
        return F.col(f"`{horizon}`").cast("int")
    validate_horizon(days=horizon)
    return F.lit(horizon)


def future_frame(
    history: DataFrame,
    horizon: int | str,
    spec: PanelSpec = PanelSpec(),
    cfg: FeatureConfig = FeatureConfig(),
    n_tail: int = 30,
    series: DataFrame | None = None,
) -> DataFrame:
    """``horizon`` days after each series' last date with the feature
    columns a model trained on the feature table expects.

    Lags and rolling means = mean of the last ``n_tail`` rows, rolling stds
    = their sample std, rolling min / max = their min / max, measures =
    their means; calendar and cyclical terms from the future date; NULL -> 0.
    ``series`` (center, item) restricts the series (inner join).  ``horizon``
    may name a column of ``series``: each series' own number of days, without
    an upper limit (the largest counts if a series is listed twice)."""
    last = _last_step(horizon)
    if isinstance(horizon, str) and series is None:
        raise ValueError("a horizon per series needs the series table that holds it")
    measures = list(spec.measure_names)
    stats = last_window_stats(history, spec, n_tail, measures)
    if series is not None:
        own = [F.max(_c(horizon)).alias(horizon)] if isinstance(horizon, str) else [F.count(F.lit(1)).alias("_listed")]
        listed = series.groupBy(_c(spec.center), _c(spec.item)).agg(*own)
        stats = stats.join(listed, [spec.center, spec.item]).drop("_listed")
    steps = F.explode(F.sequence(F.lit(1), last)).alias("step")
    if isinstance(horizon, str):
        stats = stats.filter(last >= 1)
    fut = stats.select("*", steps).withColumn(spec.date, F.date_add(F.to_date("last_date"), F.col("step")))
    d = _c(spec.date)
    cols = [_c(spec.center), _c(spec.item), d, F.col("step")]
    cols += [F.col(f"tail_{m}").alias(m) for m in measures]
    cols += date_feature_columns(d)
    cols += [F.col("tail_mean").alias(f"lag_{k}") for k in cfg.lags]
    by_stat = {"mean": "tail_mean", "std": "tail_std", "min": "tail_min", "max": "tail_max"}
    cols += [F.col(by_stat[s]).alias(f"rolling_{s}_{w}") for w in cfg.windows for s in cfg.stats]
    if cfg.seasonal:
        cols += seasonal_feature_columns(d)
    out = fut.select(*cols)
    numeric = [f.name for f in out.schema.fields if f.name not in (spec.center, spec.item, spec.date, "step")]
    return out.fillna(0, subset=numeric)


def model_forecast(model, future: DataFrame, spec: PanelSpec = PanelSpec(), prediction_col: str = "prediction") -> DataFrame:
    """Score the future frame; lower = max(0, 0.8 f), upper = 1.2 f."""
    scored = model.transform(future)
    f = F.col(prediction_col).cast("double")
    return scored.select(
        _c(spec.center).alias("center"),
        _c(spec.item).alias("item"),
        _c(spec.date).alias("date"),
        F.col("step"),
        f.alias("forecast"),
        F.greatest(F.lit(0.0), f * MODEL_LOWER).alias("lower_bound"),
        (f * MODEL_UPPER).alias("upper_bound"),
    )


def rule_forecast(
    series: DataFrame,
    horizon: int | str,
    as_of: str | Column | None = None,
    noise_sd: float = 0.0,
    seed: int = 42,
    rules: tuple | DataFrame = FORECAST_RULES,
    default=FORECAST_DEFAULT,
) -> DataFrame:
    """Keyword-rule forecast for each (center, item) row of ``series``.

    Day i (0-based) is ``as_of + 1 + i``; level = base + amp * sin(i * freq)
    by upper-cased item keyword, x1.2 on weekends, x1.3 in March-June,
    + N(0, noise_sd) if requested, floored at 100; bounds 0.85 / 1.15;
    2 decimals.  ``as_of`` is a date literal, a column of ``series``
    (e.g. each series' last date), or NULL -> ``current_date()``.
    A random confidence in [0.70, 0.95] is added only when noise is on.  Noise
    and confidence are drawn from (center, item, step, seed), so a run again or
    another partitioning gives the same forecast.

    ``horizon`` is a number of days or a column of ``series`` with each row's
    own (no upper limit).  ``rules`` are (keyword, base, amplitude, frequency),
    the first keyword found in the upper-cased item wins; ``default`` holds the
    three numbers for other items.  Thousands of rules come as a DataFrame
    (rule_order, keyword, base, amplitude, frequency), which is joined
    (``match_rules``) instead of put into the plan.
    """
    last = _last_step(horizon)
    if isinstance(horizon, str):
        series = series.filter(last >= 1)
    if as_of is None:
        base_date = F.current_date()
    elif isinstance(as_of, str) and as_of in series.columns:
        base_date = F.to_date(F.col(as_of))
    elif isinstance(as_of, str):
        base_date = F.to_date(F.lit(as_of))
    else:
        base_date = F.to_date(as_of)
    steps = F.explode(F.sequence(F.lit(0), last - 1)).alias("step")
    if isinstance(rules, DataFrame):
        named = match_rules(series, rules).select(F.col("item").alias("_rule_item"), "base", "amplitude", "frequency")
        series = series.join(named, F.col("item").eqNullSafe(F.col("_rule_item")), "left")
        numbers = [F.coalesce(F.col(c).cast("double"), F.lit(float(d))).alias(c) for c, d in zip(RULE_NUMBERS, default)]
    else:
        numbers = []
    grid = series.select("center", "item", base_date.alias("_as_of"), *numbers, steps)
    d = F.date_add(F.col("_as_of"), F.col("step") + 1)
    key = [F.col("center"), F.col("item"), F.col("step") + 1, F.lit(seed)]
    if numbers:
        level = F.col("base") + F.col("amplitude") * F.sin(F.col("step").cast("double") * F.col("frequency"))
    else:
        level = rule_level(F.col("item"), F.col("step"), rules, default)
    level = level * F.when(F.weekday(d) >= 5, F.lit(WEEKEND_FACTOR)).otherwise(F.lit(1.0))
    level = level * F.when(F.month(d).between(*SUMMER_MONTHS), F.lit(SUMMER_FACTOR)).otherwise(F.lit(1.0))
    if noise_sd:
        level = level + normal(*key, F.lit("level")) * F.lit(noise_sd)
    value = F.greatest(F.lit(FORECAST_FLOOR), level)
    out = grid.select(
        "center",
        "item",
        d.alias("date"),
        (F.col("step") + 1).alias("step"),
        value.alias("_v"),
    ).select(
        "center",
        "item",
        "date",
        "step",
        F.round("_v", 2).alias("forecast"),
        F.round(F.col("_v") * RULE_LOWER, 2).alias("lower_bound"),
        F.round(F.col("_v") * RULE_UPPER, 2).alias("upper_bound"),
    )
    if noise_sd:
        lo, hi = CONFIDENCE_RANGE
        out = out.withColumn("confidence", F.round(F.lit(lo) + uniform(F.col("center"), F.col("item"), F.col("step"), F.lit(seed), F.lit("confidence")) * (hi - lo), 2))
    return out


def monthly_baseline(monthly: DataFrame, n_months: int = 3) -> DataFrame:
    """Per series, mean of the last ``n_months`` observed months; when
    that is not positive, max(median of all months, 1).  Also last month."""
    w = Window.partitionBy("center", "item").orderBy(F.col("month").desc())
    ranked = monthly.withColumn("_rn", F.row_number().over(w))
    base = ranked.groupBy("center", "item").agg(
        F.avg(F.when(F.col("_rn") <= n_months, F.col("demand"))).alias("_tail"),
        F.avg("demand").alias("_mean"),
        F.median("demand").alias("_median"),
        F.max("month").alias("last_month"),
    )
    tail = F.coalesce(F.col("_tail"), F.col("_mean"))
    baseline = F.when(tail.isNull() | (tail <= 0), F.greatest(F.col("_median"), F.lit(1.0))).otherwise(tail)
    return base.select("center", "item", "last_month", baseline.alias("baseline"))


def monthly_projection(df: DataFrame, spec: PanelSpec = PanelSpec(), months: int = 12) -> DataFrame:
    """Monthly totals -> baseline -> ``months`` future months with
    x(1 + 0.12 sin(2 pi idx / 12)) x(1 + 0.015 idx), floored at 0, bounds
    0.9 / 1.1, 2 decimals, month label ``yyyy-MM``."""
    validate_horizon(months=months)
    base = monthly_baseline(monthly_by_series(df, spec))
    idx = F.explode(F.sequence(F.lit(0), F.lit(months - 1))).alias("idx")
    rows = base.select("center", "item", "last_month", "baseline", idx)
    season = 1 + F.lit(PROJECTION_SEASONAL_AMPLITUDE) * F.sin(F.col("idx") / F.lit(12.0) * F.lit(2 * math.pi))
    trend = 1 + F.lit(PROJECTION_TREND) * F.col("idx")
    value = F.greatest(F.lit(0.0), F.col("baseline") * season * trend)
    return rows.select(
        "center",
        "item",
        F.date_format(F.add_months(F.col("last_month"), F.col("idx") + 1), "yyyy-MM").alias("month"),
        F.round(value, 2).alias("forecast"),
        F.round(value * PROJECTION_LOWER, 2).alias("lower_bound"),
        F.round(value * PROJECTION_UPPER, 2).alias("upper_bound"),
    )
