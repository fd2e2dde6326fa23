import re
from datetime import date, timedelta

from pyspark.sql import functions as F

from demandkit.operators import dense, features
from demandkit.operators.indexing import dense_index
from demandkit.spec import FeatureConfig, PanelSpec

SPEC = PanelSpec(date="d", center="c", item="i", target="y", measures=(("amt", "sum"), ("rate", "mean")))


def fact(spark, rows):
    return spark.createDataFrame(rows, "d date, c string, i string, y double, amt double, rate double")


def test_dense_panel_shape_fill_and_sum(spark):
    d0 = date(2024, 2, 27)
    rows = [
        (d0, "A", "x", 1.0, 10.0, 2.0),
        (d0, "A", "x", 2.0, 5.0, 4.0),
        (d0 + timedelta(days=3), "B", "y", 7.0, 1.0, 6.0),
    ]
    daily = dense.daily_aggregate(fact(spark, rows), SPEC).cache()
    panel = dense.dense_panel(daily, SPEC).cache()
    assert panel.columns == ["d", "c", "i", "y", "amt", "rate"]
    assert panel.count() == 4 * 2 * 2  # days (leap day included) x centers x items
    assert panel.agg(F.sum("y")).first()[0] == 10.0
    first = panel.filter((F.col("c") == "A") & (F.col("i") == "x") & (F.col("d") == d0)).first()
    assert (first["y"], first["amt"], first["rate"]) == (3.0, 15.0, 3.0)
    gap = panel.filter((F.col("c") == "B") & (F.col("i") == "x")).collect()
    assert all(r["y"] == 0.0 and r["amt"] == 0.0 and r["rate"] == 4.5 for r in gap)  # mean of daily rates
    assert dense.dense_panel(daily, SPEC, observed_only=True).count() == 2 * 4


def test_empty_input_gives_empty_panel(spark):
    daily = dense.daily_aggregate(fact(spark, []), SPEC)
    assert dense.dense_panel(daily, SPEC).count() == 0


def test_feature_values_first_rows_and_short_series(spark):
    base = date(2024, 12, 28)
    rows = [(base + timedelta(days=k), "A", "x", float(k + 1), 0.0, 1.0) for k in range(4)]
    out = features.build_features(fact(spark, rows), SPEC, FeatureConfig()).orderBy("d").collect()
    first, second, last = out[0], out[1], out[3]
    assert first["lag_1"] is None and first["rolling_std_7"] is None
    assert first["rolling_mean_7"] == 1.0 and first["rolling_min_7"] == 1.0
    assert second["lag_1"] == 1.0 and abs(second["rolling_std_7"] - 0.7071067811865476) < 1e-12
    assert last["lag_3"] == 1.0 and last["lag_7"] is None
    assert last["rolling_mean_14"] == 2.5 and last["rolling_max_7"] == 4.0
    # 2024-12-28 is a Saturday; 2024-12-30 is in ISO week 1 of 2025; 12-31 is a month end.
    assert (first["day_of_week"], first["is_weekend"]) == (5, 1)
    assert out[2]["week_of_year"] == 1 and out[2]["day_of_week"] == 0
    assert last["is_month_end"] == 1 and last["quarter"] == 4 and last["day_of_year"] == 366
    assert len(out[0]) == 6 + 10 + 3 + 8 + 6


def test_exclude_current_removes_leakage(spark):
    rows = [(date(2024, 1, 1) + timedelta(days=k), "A", "x", float(k), 0.0, 1.0) for k in range(3)]
    cfg = FeatureConfig(lags=(1,), windows=(2,), seasonal=False, exclude_current=True)
    out = features.build_features(fact(spark, rows), SPEC, cfg).orderBy("d").collect()
    assert out[0]["rolling_mean_2"] is None and out[2]["rolling_mean_2"] == 0.5


def test_dense_index_is_consecutive_and_ordered(spark):
    df = spark.createDataFrame([(f"k{n:04d}",) for n in range(500)], "k string").repartition(7)
    rows = dense_index(df, ["k"], "idx", num_partitions=5).collect()
    got = sorted((r["idx"], r["k"]) for r in rows)
    assert [i for i, _ in got] == list(range(500))
    assert [k for _, k in got] == sorted(k for _, k in got)


def test_plan_single_window_no_python_no_reshuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(date(2024, 1, 1) + timedelta(days=k), c, i, 1.0, 1.0, 1.0) for k in range(0, 30, 2) for c in "AB" for i in "xyz"]
        daily = dense.daily_aggregate(fact(spark, rows), SPEC).cache()
        out = features.build_features(dense.dense_panel(daily, SPEC), SPEC)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert plan.count("Window [") == 1, plan  # lags and all rolling stats share one node
    between = plan.split("SortMergeJoin")[0]  # part of the plan above the panel join
    assert "Exchange" not in between, plan
    assert "Sort [" not in between, plan  # the join's sort already orders each series by date


def test_daily_aggregate_shuffles_on_all_three_keys(spark):
    # A hot (center, item) series must still spread over its days: the final
    # aggregate is hash-partitioned on (center, item, date), not on the pair.
    rows = [(date(2024, 1, 1) + timedelta(days=k), "A", "x", 1.0, 1.0, 1.0) for k in range(10)]
    daily = dense.daily_aggregate(fact(spark, rows), SPEC)
    plan = daily._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(c#\d+, i#\d+, d#\d+", plan), plan
    assert daily.columns == ["d", "c", "i", "y", "amt", "rate"]


def test_large_dimension_path_gives_same_panel(spark, monkeypatch):
    rows = [(date(2024, 1, 1) + timedelta(days=k), c, i, float(k), 1.0, 2.0) for k in range(0, 6, 5) for c in "ABC" for i in "xy"]
    daily = dense.daily_aggregate(fact(spark, rows), SPEC).cache()
    inline = sorted(tuple(r) for r in dense.dense_panel(daily, SPEC).collect())
    monkeypatch.setattr(dense, "INLINE_DIMENSION_LIMIT", 0)
    distributed = sorted(tuple(r) for r in dense.dense_panel(daily, SPEC).collect())
    assert inline == distributed and len(inline) == 6 * 3 * 2


def test_split_large_pair_path(spark, monkeypatch):
    from demandkit.operators import split

    rows = [(date(2024, 1, 1) + timedelta(days=k), c, i, 1.0, 1.0, 1.0) for k in range(4) for c in "AB" for i in "xy"]
    panel = fact(spark, rows)
    small = sorted(tuple(r) for r in split.split_rows_tail(panel, SPEC).collect())
    monkeypatch.setattr(split, "INLINE_DIMENSION_LIMIT", 0)
    big = sorted(tuple(r) for r in split.split_rows_tail(panel, SPEC).collect())
    assert small == big


def test_null_keys_form_no_group(spark):
    rows = [(date(2024, 1, 1), None, "x", 5.0, 1.0, 1.0), (date(2024, 1, 1), "A", "x", 2.0, 1.0, 1.0), (None, "A", "x", 9.0, 1.0, 1.0)]
    daily = dense.daily_aggregate(fact(spark, rows), SPEC)
    assert [(r["c"], r["y"]) for r in daily.collect()] == [("A", 2.0)]
    assert dense.dense_panel(daily, SPEC).count() == 1


def test_keep_time_parity_panel_on_timestamps(spark):
    from datetime import datetime

    from demandkit.operators import clean

    spec = PanelSpec(measures=())
    raw = spark.createDataFrame(
        [("2024-01-01 06:00:00", "A", "x", "1"), ("2024-01-02 06:00:00", "A", "x", "2"), ("2024-01-02 18:00:00", "A", "x", "4")],
        "DATE string, `CENTER NAME` string, ITEM string, `PAY WEIGHT` string",
    )
    cleaned = clean.clean_sales(raw, spec, keep_time=True)
    assert dict(cleaned.dtypes)["DATE"] == "timestamp_ntz"
    panel = dense.dense_panel(dense.daily_aggregate(cleaned, spec), spec).orderBy("DATE").collect()
    # daily steps from the first timestamp: the 18:00 row never matches the grid (parity)
    assert [(r["DATE"], r["PAY WEIGHT"]) for r in panel] == [(datetime(2024, 1, 1, 6), 1.0), (datetime(2024, 1, 2, 6), 2.0)]
    by_day = dense.dense_panel(dense.daily_aggregate(clean.clean_sales(raw, spec), spec), spec).collect()
    assert sorted(r["PAY WEIGHT"] for r in by_day) == [1.0, 6.0]  # default: truncated to DATE, nothing lost
