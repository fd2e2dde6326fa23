"""Registered queries over the test tables (``__spark_entry__.queries``).

Each takes ``(spark, sf_dir)`` and returns a lazy DataFrame built from the
library operators.  Doubles are rounded (``rounded``) only here, for the
comparison with the SQL oracle; the operators themselves never round.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandkit.functions.calendar import DATE_FEATURES, SEASONAL_FEATURES
from demandkit.functions.cleaning import missing_to_null
from demandkit.operators import clean, dense, drift, features, forecast, inventory, metrics, models, reports, split
from demandkit.plans.common import rounded
from demandkit.sources import testdata
from demandkit.sources.testdata import SALES_SPEC as SPEC
from demandkit.spec import FeatureConfig

CFG = FeatureConfig()
KEYS = [SPEC.date, SPEC.center, SPEC.item]


def sales(spark: SparkSession, sf_dir: str, roles=("center", "item")) -> DataFrame:
    return testdata.sales(spark, sf_dir, "region", "type", roles)


def wide_feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature table of the larger nation x brand panel (625 series)."""
    daily_wide = dense.daily_aggregate(testdata.sales(spark, sf_dir, "nation", "brand"), SPEC)
    daily_wide = daily_wide.checkpoint(eager=True)
    return features.build_features(dense.dense_panel(daily_wide, SPEC), SPEC, CFG)


def daily(spark: SparkSession, sf_dir: str, pinned: bool = True) -> DataFrame:
    """The daily aggregate; ``pinned`` for queries that read it more than once
    (written to the checkpoint folder, so nothing stays cached afterwards)."""
    out = dense.daily_aggregate(sales(spark, sf_dir), SPEC)
    return out.checkpoint(eager=True) if pinned else out


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.dense_panel(daily(spark, sf_dir), SPEC)


def feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.build_features(panel(spark, sf_dir), SPEC, CFG)


def q_daily_agg(spark, sf_dir):
    return rounded(daily(spark, sf_dir, pinned=False))


def q_dense_panel(spark, sf_dir):
    return rounded(panel(spark, sf_dir))


def q_date_features(spark, sf_dir):
    return features.add_date_features(panel(spark, sf_dir), SPEC).select(*KEYS, *DATE_FEATURES)


def q_seasonal_features(spark, sf_dir):
    return rounded(features.add_seasonal_features(panel(spark, sf_dir), SPEC).select(*KEYS, *SEASONAL_FEATURES))


def q_lag_features(spark, sf_dir):
    out = features.add_lag_features(panel(spark, sf_dir), SPEC, CFG)
    return rounded(out.select(*KEYS, SPEC.target, *[f"lag_{k}" for k in CFG.lags]))


def q_rolling_features(spark, sf_dir):
    out = features.add_rolling_features(panel(spark, sf_dir), SPEC, CFG)
    names = [f"rolling_{s}_{w}" for w in CFG.windows for s in CFG.stats]
    return rounded(out.select(*KEYS, SPEC.target, *names))


def q_feature_table(spark, sf_dir):
    return rounded(feature_frame(spark, sf_dir))


# ---------------------------------------------------------------- cleaning


def q_clean_numeric(spark, sf_dir):
    """P2/P3 on the CSV-shaped (all STRING) sales fact."""
    raw = testdata.raw_sales(spark, sf_dir)
    out = clean.fill_categorical(clean.coerce_numeric(raw))
    return rounded(out.select(
        F.col("DATE").alias("date_text"),
        F.col("CENTER NAME").alias("center"),
        F.col("ITEM").alias("item"),
        F.col("PAY WEIGHT").alias("pay_weight"),
        F.col("AMOUNT").alias("amount"),
        F.col("RATE").alias("rate"),
        F.col("BOX").alias("box"),
    ))


def q_clean_dates(spark, sf_dir):
    """P1 on text timestamps: sales (midnight) and events (time of day);
    rows per parsed day."""
    raw = testdata.raw_sales(spark, sf_dir, roles=()).select(F.col("DATE").alias("DATE"))
    ev = testdata.events(spark, sf_dir).select(F.col("ts").cast("string").alias("DATE"))
    parsed = clean.parse_dates(raw.unionByName(ev), "DATE")
    return parsed.groupBy(F.col("DATE").alias("date")).agg(F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- reports


def q_centers(spark, sf_dir):
    return reports.centers(sales(spark, sf_dir, ("center",)), SPEC)


def q_items_by_center(spark, sf_dir):
    return reports.items_by_center(sales(spark, sf_dir), SPEC)


def q_history_range(spark, sf_dir):
    """F2 + P10 over the feature table: every series, one calendar year."""
    return rounded(clean.history(feature_frame(spark, sf_dir), SPEC, "1996-01-01", "1996-12-31", amount="amount", rate="rate"))


def q_demand_by_center(spark, sf_dir):
    return rounded(reports.demand_by(sales(spark, sf_dir, ("center",)), SPEC.center, SPEC))


def q_top_items(spark, sf_dir):
    return rounded(reports.top_k(sales(spark, sf_dir, ("item",)), SPEC.item, 5, SPEC))


def q_weekday_mean(spark, sf_dir):
    return rounded(reports.weekday_mean(sales(spark, sf_dir, ()), SPEC))


def q_monthly_total(spark, sf_dir):
    return rounded(reports.monthly_total(sales(spark, sf_dir, ()), SPEC))


def q_monthly_by_series(spark, sf_dir):
    return rounded(reports.monthly_by_series(sales(spark, sf_dir), SPEC))


def q_center_item_pivot(spark, sf_dir):
    return rounded(reports.center_item_pivot(sales(spark, sf_dir), SPEC))


def q_summary(spark, sf_dir):
    return rounded(reports.summary(feature_frame(spark, sf_dir), SPEC))


def q_profile(spark, sf_dir):
    """A20 on the CSV-shaped fact (roles found by keyword)."""
    out, _ = reports.profile(testdata.raw_sales(spark, sf_dir))
    return rounded(out.select("total_records", "date_start", "date_end", "n_centers", "n_products", "total_demand"))


def q_last_n_rows(spark, sf_dir):
    return rounded(forecast.last_n_rows(panel(spark, sf_dir), SPEC, 30))


# ---------------------------------------------------------------- metrics

NAIVE = {"lag_1": "lag_1", "lag_7": "lag_7", "rolling_mean_7": "rolling_mean_7"}


def _stack_naive(ft: DataFrame, *keep) -> DataFrame:
    """One row per (feature row, naive model): the models are exploded from
    one pass over the feature frame, so its window runs once (a union of
    three selects would evaluate it three times)."""
    models = F.explode(
        F.array(*[F.struct(F.lit(name).alias("model"), F.coalesce(F.col(col), F.lit(0.0)).alias("predicted")) for name, col in NAIVE.items()])
    ).alias("_m")
    return ft.select(*keep, F.col(SPEC.target).alias("actual"), models).select(*keep, "_m.model", "actual", "_m.predicted")


def naive_predictions(spark, sf_dir):
    """Naive forecasts (a feature as the prediction, NULL -> 0), stacked."""
    return _stack_naive(feature_frame(spark, sf_dir))


def q_naive_metrics(spark, sf_dir):
    return rounded(metrics.accuracy(naive_predictions(spark, sf_dir), by=["model"]))


def q_best_model(spark, sf_dir):
    return rounded(metrics.best_model(metrics.accuracy(naive_predictions(spark, sf_dir), by=["model"])))


# ---------------------------------------------------------------- forecasts


def series_last_dates(spark, sf_dir):
    d = daily(spark, sf_dir, pinned=False)
    return d.groupBy(F.col(SPEC.center).alias("center"), F.col(SPEC.item).alias("item")).agg(
        F.max(SPEC.date).alias("last_date")
    )


def q_rule_forecast(spark, sf_dir):
    return rounded(forecast.rule_forecast(series_last_dates(spark, sf_dir), 30, as_of="last_date"))


def q_forecast_summary(spark, sf_dir):
    return rounded(reports.forecast_summary(forecast.rule_forecast(series_last_dates(spark, sf_dir), 30, as_of="last_date")))


def q_monthly_projection(spark, sf_dir):
    return rounded(forecast.monthly_projection(sales(spark, sf_dir), SPEC, 12))


def q_upload_projection(spark, sf_dir):
    """P5 + P6 + R9: roles found by keyword on the CSV-shaped fact, demand
    text coerced, then the 12-month projection."""
    mapped, spec = clean.map_roles(testdata.raw_sales(spark, sf_dir))
    mapped = clean.coerce_numeric(mapped, [spec.target])
    return rounded(forecast.monthly_projection(mapped, spec, 12))


def stock_table(spark, sf_dir):
    """Stock position per series, derived from the keys (deterministic)."""
    pairs = series_last_dates(spark, sf_dir)
    return pairs.select(
        "center",
        "item",
        (F.length("center") * F.lit(700.0) + F.length("item") * F.lit(50.0)).alias("current_stock"),
        (F.lit(1) + (F.length("center") + F.length("item")) % 7).cast("int").alias("lead_time"),
        "last_date",
    )


def q_inventory(spark, sf_dir):
    stock = stock_table(spark, sf_dir)
    last = stock.select("center", "item", "last_date").join(inventory.series_horizons(stock), ["center", "item"])
    fc = forecast.rule_forecast(last, "horizon", as_of="last_date")
    return rounded(inventory.inventory_recommendations(fc, stock.drop("last_date")))


def q_inventory_repeated_stock(spark, sf_dir):
    """Five stock rows per pair (two of them equal, lead times 0 to 400); no
    forecast for one region and a short one for another."""
    pairs = stock_table(spark, sf_dir).drop("lead_time")
    stock = pairs.select("*", F.explode(F.array(*[F.lit(k) for k in (0, 5, 5, 45, 400)])).alias("lead_time"))
    days = inventory.series_horizons(stock)
    days = days.withColumn("horizon", F.when(F.col("center") == "AFRICA", 60).otherwise(F.col("horizon")))
    last = pairs.filter("center != 'ASIA'").select("center", "item", "last_date").join(days, ["center", "item"])
    fc = forecast.rule_forecast(last, "horizon", as_of="last_date")
    return rounded(inventory.inventory_recommendations(fc, stock.drop("last_date")))


# Rules over words of the test table's items: every branch is hit, SMALL holds two keywords.
WORD_RULES = (("ECON", 1500.0, 300.0, 0.2), ("ARGE", 2000.0, 400.0, 0.15), ("SMALL", 800.0, 200.0, 0.25), ("M", 600.0, 150.0, 0.3))


def q_rule_forecast_keywords(spark, sf_dir):
    series = series_last_dates(spark, sf_dir)
    return rounded(forecast.rule_forecast(series, 30, as_of="last_date", rules=WORD_RULES, default=(900.0, 100.0, 0.5)))


# ---------------------------------------------------------------- splits


def q_split_tail(spark, sf_dir):
    d = daily(spark, sf_dir)
    out = split.split_rows_tail(dense.dense_panel(d, SPEC), SPEC, 0.2, keys=all_pairs(d))
    return out.select(*KEYS, "row_index", "split")


def all_pairs(d: DataFrame) -> DataFrame:
    """The panel's pairs with its first and last date: what a split needs to know of it."""
    ends = d.agg(F.array(F.min(SPEC.date), F.max(SPEC.date)).alias("ends")).first()["ends"]
    return dense.series_pairs(d, SPEC).select("*", F.explode(F.array(*[F.lit(e) for e in ends])).alias(SPEC.date))


def q_split_by_date(spark, sf_dir):
    d = daily(spark, sf_dir)
    return split.split_by_date(dense.dense_panel(d, SPEC), SPEC, 0.2, keys=d).select(*KEYS, "split")


# ---------------------------------------------------------------- drift

DRIFT_CUT = "2024-01-16"


def drift_sides(spark, sf_dir):
    ev = testdata.events(spark, sf_dir)
    ref = ev.filter(F.col("ts") < F.lit(DRIFT_CUT).cast("timestamp_ntz"))
    cur = ev.filter(F.col("ts") >= F.lit(DRIFT_CUT).cast("timestamp_ntz"))
    return ref, cur


def q_column_moments(spark, sf_dir):
    ev = testdata.events(spark, sf_dir)
    is_ref = F.col("ts") < F.lit(DRIFT_CUT).cast("timestamp_ntz")
    sided = ev.withColumn("side", F.when(is_ref, "reference").otherwise("current"))
    return rounded(drift.column_moments(sided, by="side"))


def q_ks_drift(spark, sf_dir):
    ref, cur = drift_sides(spark, sf_dir)
    return rounded(drift.ks_test(ref, cur, method="asymptotic"))


def q_drift_report(spark, sf_dir):
    ref, cur = drift_sides(spark, sf_dir)
    return rounded(drift.drift_report(ref, cur, method="asymptotic"))


def q_drift_alerts(spark, sf_dir):
    ref, cur = drift_sides(spark, sf_dir)
    return drift.drift_alerts(drift.drift_report(ref, cur, method="asymptotic"))


def q_drift_sparse(spark, sf_dir):
    """K4 with a shared column that has no value on the current side."""
    ref, cur = drift_sides(spark, sf_dir)
    ref = ref.select("user_id", "value", F.col("value").alias("extra"))
    cur = cur.select("user_id", "value", F.lit(None).cast("double").alias("extra"))
    return rounded(drift.drift_report(ref, cur, method="asymptotic"))


# ---------------------------------------------------------------- dirty text


def q_clean_dirty_numeric(spark, sf_dir):
    """P2 on text that holds blanks, tokens, separators and NULLs."""
    out = clean.coerce_numeric(testdata.dirty_sales(spark, sf_dir), ["PAY WEIGHT"])
    return rounded(out.groupBy("order_key").agg(F.sum("PAY WEIGHT").alias("pay_weight"), F.count(F.lit(1)).alias("n_rows")))


def q_clean_dirty_dates(spark, sf_dir):
    """P1 on a column of many layouts, month first."""
    parsed = clean.parse_dates(testdata.dirty_sales(spark, sf_dir), "DATE")
    return parsed.groupBy((F.col("order_key") % 13).alias("layout"), F.col("DATE").alias("date")).agg(F.count(F.lit(1)).alias("n_rows"))


def q_date_rejects(spark, sf_dir):
    """The rows that P1 drops, counted by reason and layout."""
    lost = clean.date_rejects(testdata.dirty_sales(spark, sf_dir), "DATE")
    return lost.groupBy((F.col("order_key") % 13).alias("layout"), "reject_reason").agg(F.count(F.lit(1)).alias("n_rows"))


def q_clean_dirty_labels(spark, sf_dir):
    """S1 + P3: missing tokens and NULLs become 'Unknown'."""
    raw = testdata.dirty_sales(spark, sf_dir)
    out = clean.fill_categorical(raw.withColumn("PARTY NAME", missing_to_null("PARTY NAME")))
    return out.groupBy(F.col("PARTY NAME").alias("party")).agg(F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- more reports


def q_history_series(spark, sf_dir):
    """F1 + F2 + P10: one series, one year."""
    ft = feature_frame(spark, sf_dir)
    return rounded(clean.history(ft, SPEC, "1996-01-01", "1996-12-31", "ASIA", "PROMO", amount="amount", rate="rate"))


def q_upload_no_roles(spark, sf_dir):
    """A table without date, center and item columns, in an explicit order."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    raw = testdata.table(spark, sf_dir, "lineitem").select(*order, F.col("l_quantity").alias("qty"))
    mapped, _ = clean.map_roles(raw, as_of="2024-01-01", order_by=[*order, "qty"])
    return rounded(mapped)


def q_date_bounds(spark, sf_dir):
    return dense.date_bounds(sales(spark, sf_dir, ()), SPEC)


def q_key_counts(spark, sf_dir):
    return reports.count_distinct_keys(sales(spark, sf_dir), SPEC)


def q_top_centers(spark, sf_dir):
    return rounded(reports.top_k(sales(spark, sf_dir, ("center",)), SPEC.center, 5, SPEC))


def q_feature_preview(spark, sf_dir):
    """First 200 feature rows in (date, center, item) order.

    A feature looks back only, and every day of the panel has every pair, so
    the first days are enough; the filter goes below the window."""
    d = daily(spark, sf_dir)
    b = d.agg(F.min(SPEC.date).alias("lo"), F.count_distinct(SPEC.center).alias("c"), F.count_distinct(SPEC.item).alias("i")).first()
    grid = dense.dense_panel(d, SPEC)
    if b["lo"] is not None:
        days = -(-200 // (b["c"] * b["i"]))
        grid = grid.filter(F.col(SPEC.date) < F.date_add(F.lit(b["lo"]), days))
    return rounded(reports.preview(features.build_features(grid, SPEC, CFG), KEYS, 200))


def q_best_run(spark, sf_dir):
    """Naive models run per center (experiment = center); best run of
    each experiment by RMSE."""
    preds = naive_predictions_by_center(spark, sf_dir)
    runs = metrics.accuracy(preds, by=["experiment", "model"]).withColumn(
        "run_id", F.concat_ws("/", "experiment", "model")
    )
    return rounded(metrics.best_run(runs).select("experiment", "run_id", "model_uri", "rmse", "mae", "mape"))


def naive_predictions_by_center(spark, sf_dir):
    ft = feature_frame(spark, sf_dir).withColumnRenamed(SPEC.center, "experiment")
    return _stack_naive(ft, "experiment")


def q_role_mapping(spark, sf_dir):
    """P5 + P6 on the CSV-shaped fact: columns found by keyword."""
    mapped, _ = clean.map_roles(testdata.raw_sales(spark, sf_dir))
    return rounded(mapped.withColumn("demand", F.col("demand").try_cast("double")))


def q_profile_values(spark, sf_dir):
    """Distinct center / product values of the profiled table."""
    _, values = reports.profile(testdata.raw_sales(spark, sf_dir))
    return values


def q_future_features(spark, sf_dir):
    """30 future days per series with model-ready features."""
    return rounded(forecast.future_frame(panel(spark, sf_dir), 30, SPEC, CFG))


# ---------------------------------------------------------------- models (rows-only check)

_FITTED: dict = {}


def fitted_model(spark, sf_dir, name: str = "xgboost"):
    """Model fitted on the date-split training rows of the feature table.

    Both model shapes are fitted together (concurrently) on first use and
    kept for the life of the SparkContext, so one training serves all the
    model queries."""
    files = testdata.table(spark, sf_dir, "lineitem").select("_metadata.file_path", "_metadata.file_modification_time").distinct()
    key = (spark.sparkContext.applicationId, sf_dir, *sorted(map(tuple, files.collect())))
    if key not in _FITTED:
        data, feats = models.prepare(feature_frame(spark, sf_dir), SPEC)
        train, _ = models.split(data, SPEC, 0.2, "date")
        _FITTED[key] = models.fit_all(train, feats, SPEC, models.MODEL_PARAMS)
    return _FITTED[key][name]


def q_gbt_forecast(spark, sf_dir):
    """R5 + R6: 30-day model forecast for every series."""
    return rounded(models.forecast(fitted_model(spark, sf_dir), feature_frame(spark, sf_dir), 30, SPEC, CFG))


def q_gbt_importance(spark, sf_dir):
    """R4 + T4: top-10 feature importances."""
    return rounded(models.feature_importance(fitted_model(spark, sf_dir), top=10))


def q_gbt_backtest(spark, sf_dir):
    """Pooled metrics on the last 30 rows of every series."""
    return rounded(models.backtest(fitted_model(spark, sf_dir), feature_frame(spark, sf_dir), SPEC))


def q_gbt_metrics(spark, sf_dir):
    """R3 evaluation + A17: both model shapes on the test days, best flagged."""
    data, _ = models.prepare(feature_frame(spark, sf_dir), SPEC)
    _, test = models.split(data, SPEC, 0.2, "date")
    parts = [models.evaluate(fitted_model(spark, sf_dir, n), test, SPEC, n) for n in models.MODEL_PARAMS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = metrics.best_model(out).select("model", F.lit(True).alias("is_best"))
    flagged = out.join(best, "model", "left").withColumn("is_best", F.coalesce("is_best", F.lit(False)))
    return rounded(flagged)


def q_gbt_invariants(spark, sf_dir):
    """R5 + R6 for the trees: what must hold of any model's forecast, counted per series."""
    fc = models.forecast(fitted_model(spark, sf_dir), feature_frame(spark, sf_dir), 30, SPEC, CFG)
    low = F.abs(F.col("lower_bound") - F.greatest(F.lit(0.0), F.col("forecast") * 0.8)) > 1e-9
    high = F.abs(F.col("upper_bound") - F.col("forecast") * 1.2) > 1e-9
    return fc.groupBy("center", "item").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count_distinct("step").alias("n_steps"),
        F.sum(F.when(low | high | F.col("forecast").isNull(), 1).otherwise(0)).alias("n_bad"),
    )


# A fixed formula in the place of a fitted model, so that every number around it can be checked.
LINEAR = "SELECT *, (0.5D * lag_1 + 0.3D * rolling_mean_7 + 0.2D * rolling_mean_14 + 1.0D) AS prediction FROM __THIS__"


def linear_model() -> PipelineModel:
    return PipelineModel(stages=[SQLTransformer(statement=LINEAR)])


def q_linear_forecast(spark, sf_dir):
    """R5 + R6 with the fixed formula."""
    return rounded(models.forecast(linear_model(), feature_frame(spark, sf_dir), 30, SPEC, CFG))


def q_linear_backtest(spark, sf_dir):
    """R7 + F6 with the fixed formula."""
    return rounded(models.backtest(linear_model(), feature_frame(spark, sf_dir), SPEC))


def q_linear_metrics(spark, sf_dir):
    """R3 evaluation with the fixed formula on the test days."""
    data, _ = models.prepare(feature_frame(spark, sf_dir), SPEC)
    _, test = models.split(data, SPEC, 0.2, "date")
    return rounded(models.evaluate(linear_model(), test, SPEC, "linear"))


REGISTRY = {
    "clean_dirty_numeric": q_clean_dirty_numeric,
    "clean_dirty_dates": q_clean_dirty_dates,
    "clean_dirty_labels": q_clean_dirty_labels,
    "date_rejects": q_date_rejects,
    "inventory_repeated_stock": q_inventory_repeated_stock,
    "rule_forecast_keywords": q_rule_forecast_keywords,
    "drift_sparse": q_drift_sparse,
    "history_series": q_history_series,
    "upload_no_roles": q_upload_no_roles,
    "linear_forecast": q_linear_forecast,
    "linear_backtest": q_linear_backtest,
    "linear_metrics": q_linear_metrics,
    "gbt_invariants": q_gbt_invariants,
    "daily_agg": q_daily_agg,
    "dense_panel": q_dense_panel,
    "date_features": q_date_features,
    "seasonal_features": q_seasonal_features,
    "lag_features": q_lag_features,
    "rolling_features": q_rolling_features,
    "feature_table": q_feature_table,
    "clean_numeric": q_clean_numeric,
    "clean_dates": q_clean_dates,
    "centers": q_centers,
    "items_by_center": q_items_by_center,
    "history_range": q_history_range,
    "demand_by_center": q_demand_by_center,
    "top_items": q_top_items,
    "weekday_mean": q_weekday_mean,
    "monthly_total": q_monthly_total,
    "monthly_by_series": q_monthly_by_series,
    "center_item_pivot": q_center_item_pivot,
    "summary": q_summary,
    "profile": q_profile,
    "last_n_rows": q_last_n_rows,
    "naive_metrics": q_naive_metrics,
    "best_model": q_best_model,
    "rule_forecast": q_rule_forecast,
    "forecast_summary": q_forecast_summary,
    "monthly_projection": q_monthly_projection,
    "upload_projection": q_upload_projection,
    "inventory": q_inventory,
    "split_tail": q_split_tail,
    "split_by_date": q_split_by_date,
    "column_moments": q_column_moments,
    "ks_drift": q_ks_drift,
    "drift_report": q_drift_report,
    "drift_alerts": q_drift_alerts,
    "date_bounds": q_date_bounds,
    "key_counts": q_key_counts,
    "top_centers": q_top_centers,
    "feature_preview": q_feature_preview,
    "best_run": q_best_run,
    "role_mapping": q_role_mapping,
    "profile_values": q_profile_values,
    "future_features": q_future_features,
    "gbt_forecast": q_gbt_forecast,
    "gbt_importance": q_gbt_importance,
    "gbt_backtest": q_gbt_backtest,
    "gbt_metrics": q_gbt_metrics,
}
