"""Registered queries that write and read tables of their own: stores, files, runs, rules, stored trees.

What they write lies under the session's checkpoint folder, in a folder of its own per call.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandkit.operators import dense, drift, features, forecast, metrics, models, reports, rules_table, split, trees
from demandkit.plans import jobs, refresh
from demandkit.plans.common import rounded
from demandkit.plans.queries import CFG, daily, drift_sides, feature_frame, naive_predictions_by_center, panel, sales, series_last_dates, stock_table
from demandkit.session import ensure_checkpoint_dir
from demandkit.sources import files, results, testdata
from demandkit.sources.testdata import SALES_SPEC as SPEC
from demandkit.spec import PanelSpec


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- features without the panel


def q_sparse_features(spark, sf_dir):
    """W1-W5 on the observed days alone, without the dense panel."""
    return rounded(features.sparse_features(daily(spark, sf_dir), SPEC, CFG))


REFRESH_CUT = "1998-06-15"


def q_incremental_features(spark, sf_dir):
    """B1 + S3: the feature store after two loads, the second with late rows among the first one's days."""
    rows = sales(spark, sf_dir)
    first = (F.col("date") < REFRESH_CUT) & (F.col("box") < 4)
    path = folder(spark, "feature-store")
    refresh.refresh_features(rows.filter(first), path, "first", SPEC, CFG)
    refresh.refresh_features(rows.filter(~first), path, "second", SPEC, CFG)
    return rounded(refresh.read_features(spark, path))


# ---------------------------------------------------------------- files and jobs


def q_csv_sales(spark, sf_dir):
    """S1 + S4: an export with quotes, commas, blanks and missing tokens, written as CSV and read back."""
    path = folder(spark, "csv-sales")
    files.write_csv(testdata.dirty_sales(spark, sf_dir), path)
    back = files.read_sales_csv(spark, path)
    return back.groupBy(
        F.col("order_key").cast("long").alias("order_key"),
        F.col("DATE").alias("date_text"),
        F.col("PARTY NAME").alias("party"),
        F.col("PAY WEIGHT").alias("weight_text"),
    ).agg(F.count(F.lit(1)).alias("n_rows"))


def broken_csv(spark: SparkSession, sf_dir: str, path: str) -> None:
    """lineitem as CSV lines, some with a field too few or too many, every file with its header."""
    li = testdata.table(spark, sf_dir, "lineitem")
    key, flag = F.col("l_orderkey").cast("string"), F.col("l_returnflag")
    whole = F.concat_ws(",", key, F.col("l_linenumber").cast("string"), flag)
    short, long = F.concat_ws(",", key, flag), F.concat(whole, F.lit(",surplus"))
    line = F.when(F.col("l_orderkey") % 11 == 0, short).when(F.col("l_orderkey") % 7 == 0, long).otherwise(whole)
    # One text column under the header's own text; quoting is off, so lines come out as they are.
    lines = li.select(line.alias("order_key,line,flag"))
    lines.write.option("header", "true").option("sep", "\u0001").option("quote", "\u0000").csv(path)


def q_csv_rejects(spark, sf_dir):
    """The records that the reader leaves out, with their text."""
    path = folder(spark, "csv-broken")
    broken_csv(spark, sf_dir, path)
    lost = files.csv_rejects(spark, path).groupBy("record").agg(F.count(F.lit(1)).alias("n_rows"))
    kept = files.read_sales_csv(spark, path).agg(F.lit("(rows read)").alias("record"), F.count(F.lit(1)).alias("n_rows"))
    return lost.unionByName(kept)


def q_job_features(spark, sf_dir):
    """B1 from CSV text to the written feature table."""
    source, target = folder(spark, "job-sales"), folder(spark, "job-features")
    files.write_csv(testdata.raw_sales(spark, sf_dir), source)
    jobs.build_features(spark, source, target)
    names = {PanelSpec().date: "date", PanelSpec().center: "center", PanelSpec().item: "item", PanelSpec().target: "pay_weight"}
    names |= {"AMOUNT": "amount", "RATE": "rate", "BOX": "box"}
    return rounded(files.read_parquet(spark, target).withColumnsRenamed(names))


def q_job_drift(spark, sf_dir):
    """B4 over two written tables."""
    ref, cur = drift_sides(spark, sf_dir)
    paths = folder(spark, "drift-reference"), folder(spark, "drift-current")
    for side, path in zip((ref, cur), paths):
        files.write_parquet(side, path)
    report, _ = jobs.drift_job(spark, *paths, method="asymptotic")
    return rounded(report)


def q_sorted_sink(spark, sf_dir):
    """S3 + T1: a table partitioned by center and sorted within, read back in file order."""
    path = folder(spark, "sorted")
    table = daily(spark, sf_dir).repartition(SPEC.center)
    files.write_parquet(table, path, partition_by=[SPEC.center], sort_within=[SPEC.item, SPEC.date])
    here = files.read_parquet(spark, path).select(
        F.col("center").cast("string").alias("center"), F.struct("item", "date").alias("key"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")
    )
    before = F.lag("key").over(Window.partitionBy("file").orderBy("at"))
    rows = here.withColumn("back", (before > F.col("key")).cast("int"))
    first, last = F.min_by("key", "at"), F.max_by("key", "at")
    return rows.groupBy("center").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("file").alias("n_files"),
        F.coalesce(F.sum("back"), F.lit(0)).alias("n_out_of_order"),
        first["item"].alias("first_item"),
        first["date"].alias("first_date"),
        last["item"].alias("last_item"),
        last["date"].alias("last_date"),
    )


# Features that differ in the future frame, each with a weight of its own.
FORMULA = "0.5D * lag_1 + 0.3D * rolling_std_7 + 0.25D * rolling_min_14 + 0.001D * rate + 5.0D * month_sin + 0.7D * day_of_week + 1.0D"


def q_job_forecast(spark, sf_dir):
    """B3 + S7: a saved model over a written feature table; recommendations for every stocked pair."""
    table, saved = folder(spark, "job-table"), folder(spark, "job-models")
    files.write_parquet(feature_frame(spark, sf_dir), table)
    model = PipelineModel(stages=[SQLTransformer(statement=f"SELECT *, ({FORMULA}) AS prediction FROM __THIS__")])
    model.write().save(f"{saved}/xgboost")
    stock = stock_table(spark, sf_dir).drop("last_date")
    return rounded(jobs.forecast_job(spark, table, saved, "xgboost", 30, stock=stock, spec=SPEC).recommendations)


# ---------------------------------------------------------------- runs


def q_best_run_params(spark, sf_dir):
    """A18 + S5: runs with parameter maps in an append-only history, written in two goes (the first one without params)."""
    found = metrics.accuracy(naive_predictions_by_center(spark, sf_dir), by=["experiment", "model"])
    runs = found.select(
        "experiment",
        F.concat_ws("/", "experiment", "model").alias("run_id"),
        F.create_map(F.lit("rmse"), "rmse", F.lit("mae"), "mae").alias("metrics"),
        F.when(F.col("model").startswith("rolling"), F.create_map(F.lit("window"), F.lit("7"), F.lit("kind"), F.lit("mean")))
        .otherwise(F.create_map(F.lit("kind"), F.lit("lag")))
        .alias("params"),
    )
    path = folder(spark, "runs")
    early = F.col("run_id").endswith("lag_1")
    results.append_runs(runs.filter(early).drop("params"), path)
    results.append_runs(runs.filter(~early), path)
    return rounded(metrics.best_run_params(results.read_runs(spark, path), ["kind", "window", "depth"]))


# ---------------------------------------------------------------- rules


def derived_rules(spark, sf_dir) -> DataFrame:
    """A rule for every 2- to 7-letter beginning and ending of the words that part names and brands hold."""
    part = testdata.table(spark, sf_dir, "part")
    text = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    word = part.select(F.explode(F.split(F.upper(text), " ")).alias("word")).distinct()
    size = F.explode(F.sequence(F.lit(2), F.lit(7))).alias("size")
    cut = word.select("word", size).filter(F.length("word") >= F.col("size"))
    both = F.explode(F.array(F.substring(F.col("word"), F.lit(1), F.col("size")), F.right("word", F.col("size")))).alias("keyword")
    keywords = cut.select(both).distinct()
    # The order is a digest's, so that short and long keywords come first by turns.
    order = F.conv(F.substring(F.md5(F.col("keyword").cast("binary")), 1, 12), 16, 10).cast("long")
    length = F.length("keyword")
    return keywords.select(
        order.alias("rule_order"),
        "keyword",
        (length * 100.0).alias("base"),
        (length * 10.0).alias("amplitude"),
        (F.lit(1.0) / length).alias("frequency"),
    )


def q_rule_table_match(spark, sf_dir):
    """X2 with rules as a table: the first rule of every part description."""
    part = testdata.table(spark, sf_dir, "part")
    items = part.select(F.concat_ws(" ", "p_name", F.lower("p_brand"), "p_type").alias("item"))
    return rounded(rules_table.match_rules(items, derived_rules(spark, sf_dir)))


def q_rule_table_forecast(spark, sf_dir):
    """R8 with rules as a table."""
    series = series_last_dates(spark, sf_dir)
    return rounded(forecast.rule_forecast(series, 30, as_of="last_date", rules=derived_rules(spark, sf_dir)))


def q_rule_forecast_noise(spark, sf_dir):
    """R8 with noise drawn from the keys."""
    return rounded(forecast.rule_forecast(series_last_dates(spark, sf_dir), 30, as_of="last_date", noise_sd=50.0, seed=7))


# ---------------------------------------------------------------- models

# A small stored ensemble over features that differ in the future frame:
# (tree, weight, node, feature, threshold, left, right, value, gain, n_rows).
TREES = (
    (0, 1.0, 0, "rolling_std_7", 40.0, 1, 2, 0.0, 9.0, 100),
    (0, 1.0, 1, "month", 6.0, 3, 4, 0.0, 4.0, 60),
    (0, 1.0, 2, None, None, None, None, 95.5, None, 40),
    (0, 1.0, 3, None, None, None, None, 20.25, None, 30),
    (0, 1.0, 4, None, None, None, None, 35.0, None, 30),
    (1, 0.5, 0, "rate", 1200.0, 1, 2, 0.0, 2.0, 100),
    (1, 0.5, 1, "rolling_max_14", 60.0, 3, 4, 0.0, 3.0, 50),
    (1, 0.5, 2, "day_of_week", 4.0, 5, 6, 0.0, 1.0, 50),
    (1, 0.5, 3, None, None, None, None, -8.0, None, 20),
    (1, 0.5, 4, None, None, None, None, 6.5, None, 30),
    (1, 0.5, 5, None, None, None, None, 11.0, None, 40),
    (1, 0.5, 6, None, None, None, None, -3.5, None, 10),
    (2, 0.25, 0, "lag_1", 25.0, 1, 2, 0.0, 5.0, 100),
    (2, 0.25, 1, "month_sin", 0.1, 3, 4, 0.0, 2.0, 70),
    (2, 0.25, 2, None, None, None, None, 40.0, None, 30),
    (2, 0.25, 3, None, None, None, None, 1.5, None, 35),
    (2, 0.25, 4, None, None, None, None, -12.0, None, 35),
)


def stored_trees(spark: SparkSession) -> trees.NodeTableModel:
    path = folder(spark, "trees")
    trees.save_nodes(spark.createDataFrame(TREES, trees.NODES), path)
    return trees.as_model(trees.load_nodes(spark, path))


def q_tree_forecast(spark, sf_dir):
    """R5 + R6 + S7: a stored ensemble, read back and compiled into columns."""
    return rounded(models.forecast(stored_trees(spark), feature_frame(spark, sf_dir), 30, SPEC, CFG))


def q_tree_backtest(spark, sf_dir):
    """R7 with the stored ensemble."""
    data, _ = models.prepare(feature_frame(spark, sf_dir), SPEC)
    return rounded(models.backtest(stored_trees(spark), data, SPEC))


def q_null_target_metrics(spark, sf_dir):
    """P8 + R3: days whose target is missing are not judged."""
    y = F.col(SPEC.target)
    holes = feature_frame(spark, sf_dir).withColumn(SPEC.target, F.when(F.dayofmonth(SPEC.date) != 13, y))
    data, _ = models.prepare(holes, SPEC)
    return rounded(models.evaluate(stored_trees(spark), data, SPEC, "trees"))


def q_cv_folds(spark, sf_dir):
    """Days and rows of every expanding window."""
    folds = split.expanding_folds(panel(spark, sf_dir), SPEC, 3, gap=2)
    return folds.groupBy("fold", "role").agg(
        F.min(SPEC.date).alias("first_date"), F.max(SPEC.date).alias("last_date"), F.count(F.lit(1)).alias("n_rows")
    )


def q_cv_linear_metrics(spark, sf_dir):
    """R3 over expanding windows: a line through (rolling_mean_7, target) fitted per fold, judged on the fold's test days."""
    data, _ = models.prepare(feature_frame(spark, sf_dir), SPEC)
    folds = split.expanding_folds(data, SPEC, 3).select("fold", "role", F.col(SPEC.target).alias("actual"), F.col("lag_7").alias("x"))
    folds = folds.checkpoint(eager=True)
    lines = folds.filter("role = 'train'").groupBy("fold").agg(F.regr_slope("actual", "x").alias("a"), F.regr_intercept("actual", "x").alias("b"))
    # One line a fold.
    judged = folds.filter("role = 'test'").join(F.broadcast(lines), "fold").withColumn("predicted", F.col("a") * F.col("x") + F.col("b"))
    return rounded(metrics.accuracy(judged, by=["fold"]))


# ---------------------------------------------------------------- drift, profiles, pivots


def monthly_regions(spark, sf_dir) -> DataFrame:
    """A row per month, a column per region: total demand to the nearest 500, so that values tie."""
    totals = sales(spark, sf_dir, ("center",)).groupBy(F.trunc("date", "month").alias("month"), "center").agg(F.sum("pay_weight").alias("t"))
    value = F.max(F.floor(F.col("t") / 500.0).cast("double"))
    names = [r[0] for r in testdata.table(spark, sf_dir, "region").select("r_name").orderBy("r_name").collect()]
    return totals.groupBy("month").pivot("center", names).agg(value)


def q_ks_exact(spark, sf_dir):
    """K2 on small samples of unequal size with ties."""
    rows = monthly_regions(spark, sf_dir).checkpoint(eager=True)
    early = F.col("month") < "1997-12-01"
    return rounded(drift.ks_test(rows.filter(early), rows.filter(~early), method="exact"))


def q_profile_sketch(spark, sf_dir):
    """A4 + A5 + A20 from stored parts: one part a year, merged."""
    raw = testdata.raw_sales(spark, sf_dir)
    path = folder(spark, "profile")
    files.write_parquet(reports.profile_parts(raw, by=F.substring("DATE", 1, 4)), path)
    return rounded(reports.merge_profile(files.read_parquet(spark, path)))


def q_center_item_map(spark, sf_dir):
    """A11 as a map: totals by key, a key that is not there, and the number of items."""
    found = reports.center_item_map(sales(spark, sf_dir), SPEC)

    def total(name: str):
        return F.try_element_at("totals", F.lit(name))

    return rounded(found.select("center", "n_items", total("PROMO").alias("promo"), total("SMALL").alias("small"), total("NOT THERE").alias("absent")))


REGISTRY = {
    "sparse_features": q_sparse_features,
    "incremental_features": q_incremental_features,
    "csv_sales": q_csv_sales,
    "csv_rejects": q_csv_rejects,
    "job_features": q_job_features,
    "job_drift": q_job_drift,
    "job_forecast": q_job_forecast,
    "sorted_sink": q_sorted_sink,
    "best_run_params": q_best_run_params,
    "rule_table_match": q_rule_table_match,
    "rule_table_forecast": q_rule_table_forecast,
    "rule_forecast_noise": q_rule_forecast_noise,
    "tree_forecast": q_tree_forecast,
    "tree_backtest": q_tree_backtest,
    "null_target_metrics": q_null_target_metrics,
    "cv_folds": q_cv_folds,
    "cv_linear_metrics": q_cv_linear_metrics,
    "ks_exact": q_ks_exact,
    "profile_sketch": q_profile_sketch,
    "center_item_map": q_center_item_map,
}
