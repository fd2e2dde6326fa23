"""Calendar, lag, rolling and cyclical features in ONE projection over ONE
window spec (W1-W5, D1-D6, M1): Spark plans a single Window node that
reuses the panel's hash(center, item) partitioning.

``sparse_features`` gives the same numbers for the observed days alone, without
the dense panel: where most series sell on few days, the panel is mostly zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from demandkit.functions.calendar import date_feature_columns, seasonal_feature_columns
from demandkit.spec import FeatureConfig, PanelSpec


def _c(name: str):
    return F.col(f"`{name}`")


def series_window(spec: PanelSpec):
    return Window.partitionBy(_c(spec.center), _c(spec.item)).orderBy(_c(spec.date))


def lag_columns(spec: PanelSpec, cfg: FeatureConfig) -> list[Column]:
    w = series_window(spec)
    return [F.lag(_c(spec.target), k).over(w).alias(f"lag_{k}") for k in cfg.lags]


def rolling_columns(spec: PanelSpec, cfg: FeatureConfig) -> list[Column]:
    """mean/std(sample)/min/max over the last ``w`` rows incl. the current
    one (min_periods=1); ``exclude_current`` ends the frame one row earlier."""
    base = series_window(spec)
    y = _c(spec.target)
    fns = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    out = []
    for w in cfg.windows:
        frame = base.rowsBetween(-w, -1) if cfg.exclude_current else base.rowsBetween(-(w - 1), 0)
        for stat in cfg.stats:
            col = fns[stat](y).over(frame)
            if stat in ("min", "max"):
                col = col.cast("double")
            out.append(col.alias(f"rolling_{stat}_{w}"))
    return out


def add_date_features(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    return df.select("*", *date_feature_columns(_c(spec.date)))


def add_seasonal_features(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    return df.select("*", *seasonal_feature_columns(_c(spec.date)))


def add_lag_features(df: DataFrame, spec: PanelSpec = PanelSpec(), cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    return df.select("*", *lag_columns(spec, cfg))


def add_rolling_features(df: DataFrame, spec: PanelSpec = PanelSpec(), cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    return df.select("*", *rolling_columns(spec, cfg))


def build_features(df: DataFrame, spec: PanelSpec = PanelSpec(), cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Feature table: panel columns, 10 calendar INTs, lags, rolling stats,
    and (if enabled) 6 cyclical terms, in that order."""
    cols = date_feature_columns(_c(spec.date)) + lag_columns(spec, cfg) + rolling_columns(spec, cfg)
    if cfg.seasonal:
        cols += seasonal_feature_columns(_c(spec.date))
    return df.select("*", *cols)


def sparse_series_columns(spec: PanelSpec, cfg: FeatureConfig, start: Column) -> list[Column]:
    """Lag and rolling columns of observed days that count the days between them as zeros.

    Frames reach over day numbers, so one Window node serves them all.  Of a
    window of ``n`` panel days (it never begins before ``start``) the ``m``
    observed ones are aggregated and the other ``n - m`` enter as zeros: by
    count into the mean, as the zeros' share of the squared deviations into the
    deviation, and as one 0 into minimum and maximum.
    """
    day = F.unix_date(_c(spec.date))
    series = Window.partitionBy(_c(spec.center), _c(spec.item)).orderBy(day)
    y = F.coalesce(_c(spec.target).cast("double"), F.lit(0.0))
    age = day - F.unix_date(start)  # days of the panel before this one
    out = []
    for k in cfg.lags:
        then = F.sum(y).over(series.rangeBetween(-k, -k))
        out.append(F.when(age >= k, F.coalesce(then, F.lit(0.0))).alias(f"lag_{k}"))
    for w in cfg.windows:
        frame = series.rangeBetween(-w, -1) if cfg.exclude_current else series.rangeBetween(-(w - 1), 0)
        n = F.least(F.lit(w), age if cfg.exclude_current else age + 1)
        m = F.count(y).over(frame)
        zeros = n - m
        mean = F.coalesce(F.avg(y).over(frame), F.lit(0.0))
        # Squared deviations of the observed values, and of their mean from the zeros' (pairwise update, no cancellation).
        spread = F.coalesce(F.var_pop(y).over(frame), F.lit(0.0)) * m + mean * mean * m * zeros / n
        low, high = F.min(y).over(frame), F.max(y).over(frame)
        columns = {
            "mean": mean * m / n,
            "std": F.when(n > 1, F.sqrt(F.try_divide(spread, n - 1))),
            "min": F.when(zeros > 0, F.least(F.coalesce(low, F.lit(0.0)), F.lit(0.0))).otherwise(low),
            "max": F.when(zeros > 0, F.greatest(F.coalesce(high, F.lit(0.0)), F.lit(0.0))).otherwise(high),
        }
        out += [F.when(n > 0, columns[stat]).alias(f"rolling_{stat}_{w}") for stat in cfg.stats]
    return out


def sparse_features(
    daily: DataFrame, spec: PanelSpec = PanelSpec(), cfg: FeatureConfig = FeatureConfig(), start: str | None = None
) -> DataFrame:
    """The rows of ``build_features(dense_panel(daily))`` whose day was observed, without the panel.

    ``daily`` is the daily aggregate with a DATE column: its work and its one
    shuffle grow with the observed rows, not with days x centers x items.
    ``start`` is the panel's first day (found by a small job unless given).
    Measures of an observed day stay as they are, but that a NULL sum is 0.
    """
    if not isinstance(daily.schema[spec.date].dataType, DateType):
        raise TypeError(f"sparse features need a DATE column, not {daily.schema[spec.date].dataType.simpleString()}")
    first = start if start is not None else daily.agg(F.min(_c(spec.date))).first()[0]
    sums = [name for name, how in spec.measures if how == "sum"]
    fills = {c: F.coalesce(_c(c), F.lit(0.0)) for c in [spec.target, *sums]}
    rows = daily.select(*[_c(k) for k in spec.grain], _c(spec.target), *[_c(m) for m in spec.measure_names]).withColumns(fills)
    cols = date_feature_columns(_c(spec.date)) + sparse_series_columns(spec, cfg, F.lit(str(first) if first else None).cast("date"))
    if cfg.seasonal:
        cols += seasonal_feature_columns(_c(spec.date))
    return rows.select("*", *cols)
