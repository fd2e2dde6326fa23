import math
from datetime import date, timedelta

import pytest

from demandkit.operators import forecast, inventory, metrics, reports
from demandkit.spec import PanelSpec

SPEC = PanelSpec(date="d", center="c", item="i", target="y", measures=())


def sales(spark, rows):
    return spark.createDataFrame(rows, "d date, c string, i string, y double")


def test_top_k_ties_by_name_and_demand_by(spark):
    rows = [(date(2024, 1, 1), "A", name, v) for name, v in [("b", 5.0), ("a", 5.0), ("c", 9.0), ("d", 1.0)]]
    top = [r["i"] for r in reports.top_k(sales(spark, rows), "i", 3, SPEC).collect()]
    assert top == ["c", "a", "b"]
    by = reports.demand_by(sales(spark, rows), "c", SPEC).collect()
    assert by[0]["total_demand"] == 20.0


def test_weekday_mean_monday_first(spark):
    rows = [(date(2024, 1, 1), "A", "x", 2.0), (date(2024, 1, 8), "A", "x", 4.0), (date(2024, 1, 7), "A", "x", 1.0)]
    out = reports.weekday_mean(sales(spark, rows), SPEC).collect()
    assert [(r["day_of_week"], r["weekday"], r["mean_demand"]) for r in out] == [(0, "Monday", 3.0), (6, "Sunday", 1.0)]


def test_pivot_fills_missing_cells(spark):
    rows = [(date(2024, 1, 1), "A", "x", 2.0), (date(2024, 1, 1), "B", "y", 3.0)]
    out = {r["center"]: r for r in reports.center_item_pivot(sales(spark, rows), SPEC).collect()}
    assert (out["A"]["x"], out["A"]["y"], out["B"]["x"], out["B"]["y"]) == (2.0, 0.0, 0.0, 3.0)


def test_monthly_reports_and_summary(spark):
    rows = [(date(2024, 1, 31), "A", "x", 2.0), (date(2024, 2, 1), "A", "x", 3.0), (date(2024, 2, 9), "A", "x", 1.0)]
    assert [(r["month"], r["total_demand"]) for r in reports.monthly_total(sales(spark, rows), SPEC).collect()] == [
        ("2024-01", 2.0),
        ("2024-02", 4.0),
    ]
    m = reports.monthly_by_series(sales(spark, rows), SPEC).orderBy("month").collect()
    assert m[1]["month"] == date(2024, 2, 1) and m[1]["demand"] == 4.0
    s = reports.summary(sales(spark, rows), SPEC).first()
    assert (s["total_records"], s["n_centers"], s["total_demand"], s["n_features"]) == (3, 1, 6.0, 0)


def test_profile_counts_null_as_value(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "S1", "p", "2"), ("2024-01-03", None, "p", "3"), ("bad", "S1", "q", "x")],
        "order_date string, store string, product string, qty string",
    )
    out, values = reports.profile(df)
    row = out.first()
    assert (row["total_records"], row["n_centers"], row["n_products"], row["total_demand"]) == (3, 2, 2, 5.0)
    assert (row["date_start"], row["date_end"]) == (date(2024, 1, 1), date(2024, 1, 3))
    assert row["roles"]["center"] == "store" and values.count() == 4


def test_rule_forecast_shape_bounds_and_factors(spark):
    series = spark.createDataFrame([("A", "MIX FISH"), ("A", "prawn head")], "center string, item string")
    out = forecast.rule_forecast(series, 10, as_of="2024-03-01").collect()
    assert len(out) == 20
    assert all(r["lower_bound"] <= r["forecast"] <= r["upper_bound"] and r["forecast"] >= 100 for r in out)
    first = [r for r in out if r["item"] == "MIX FISH" and r["step"] == 1][0]
    assert first["date"] == date(2024, 3, 2)  # Saturday in March: x1.2 x1.3
    assert first["forecast"] == round(2000.0 * 1.2 * 1.3, 2)
    prawn = [r for r in out if r["item"] == "prawn head" and r["step"] == 2][0]
    assert abs(prawn["forecast"] - round((800 + 200 * math.sin(0.25)) * 1.2 * 1.3, 2)) < 1e-9
    with pytest.raises(ValueError):
        forecast.rule_forecast(series, 0, as_of="2024-03-01")


def test_rule_forecast_with_noise_has_confidence(spark):
    series = spark.createDataFrame([("A", "x")], "center string, item string")
    out = forecast.rule_forecast(series, 30, as_of="2024-03-01", noise_sd=100.0).collect()
    assert all(0.7 <= r["confidence"] <= 0.95 and r["forecast"] >= 100 for r in out)


def test_monthly_projection_baseline_and_fallback(spark):
    rows = [(date(2024, m, 1), "A", "x", v) for m, v in [(1, 10.0), (2, 20.0), (3, 30.0), (4, 60.0)]]
    rows += [(date(2024, m, 1), "B", "z", v) for m, v in [(1, 4.0), (2, -1.0), (3, -2.0), (4, -3.0)]]
    out = forecast.monthly_projection(sales(spark, rows), SPEC, 2).orderBy("center", "month").collect()
    a0, a1, b0 = out[0], out[1], out[2]
    assert a0["month"] == "2024-05" and a0["forecast"] == round(110 / 3, 2)
    assert a1["forecast"] == round(110 / 3 * (1 + 0.12 * math.sin(2 * math.pi / 12)) * 1.015, 2)
    assert b0["forecast"] == 1.0  # baseline <= 0 -> max(median, 1) = max(-1.5, 1)
    assert a0["lower_bound"] == round(110 / 3 * 0.9, 2)


def test_last_window_stats_and_future_frame(spark):
    spec = PanelSpec(date="d", center="c", item="i", target="y", measures=(("amt", "sum"),))
    rows = [(date(2024, 1, 1) + timedelta(days=k), "A", "x", float(k), 1.0) for k in range(40)]
    hist = spark.createDataFrame(rows, "d date, c string, i string, y double, amt double")
    st = forecast.last_window_stats(hist, spec, 30, ["amt"]).first()
    assert st["tail_mean"] == sum(range(10, 40)) / 30 and st["last_date"] == date(2024, 2, 9)
    fut = forecast.future_frame(hist, 5, spec).orderBy("d").collect()
    assert len(fut) == 5 and fut[0]["d"] == date(2024, 2, 10)
    assert fut[0]["lag_1"] == st["tail_mean"] and fut[0]["rolling_max_14"] == 39.0 and fut[0]["amt"] == 1.0


def test_inventory_cases(spark):
    fc = spark.createDataFrame(
        [("A", "x", s, 10.0) for s in range(1, 15)] + [("B", "y", s, 0.0) for s in range(1, 15)],
        "center string, item string, step int, forecast double",
    )
    stock = spark.createDataFrame(
        [("A", "x", 5.0, 2), ("A", "x2", 5.0, 2), ("B", "y", 1.0, 3), ("A", "x", 1000.0, 1)],
        "center string, item string, current_stock double, lead_time int",
    )
    out = {(r["item"], r["current_stock"]): r for r in inventory.inventory_recommendations(fc, stock).collect()}
    a = out[("x", 5.0)]
    assert (a["expected_demand"], a["safety_stock"], a["reorder_point"], a["recommended_order"]) == (70.0, 14.0, 34.0, 29.0)
    assert a["stock_out_risk"] == 75.0
    assert out[("x", 1000.0)]["recommended_order"] == 0.0 and out[("x", 1000.0)]["stock_out_risk"] == 0.0
    assert out[("y", 1.0)]["stock_out_risk"] == 0.0  # lead-time demand 0
    z = out[("x2", 5.0)]
    assert (z["recommended_order"], z["reorder_point"], z["expected_demand"]) == (0.0, 0.0, 0.0)
    horizons = {(r["center"], r["item"]): r["horizon"] for r in inventory.series_horizons(stock).collect()}
    assert horizons == {("A", "x"): 9, ("A", "x2"): 9, ("B", "y"): 10}


def test_inventory_repeated_rows_and_long_lead_times(spark):
    fc = spark.createDataFrame([("A", "x", s, 10.0) for s in range(1, 15)], "center string, item string, step int, forecast double")
    stock = spark.createDataFrame(
        [("A", "x", 0.0, 2), ("A", "x", 0.0, 2), ("A", "x", 0.0, 400), ("A", "x", 0.0, 0), ("A", "x", 0.0, None), ("Z", "z", 0.0, 1)],
        "center string, item string, current_stock double, lead_time int",
    )
    got = sorted((r["lead_time"] or -1, r["reorder_point"], r["covered"]) for r in inventory.inventory_recommendations(fc, stock).collect())
    assert got == [(-1, 14.0, True), (-1, 14.0, True), (1, 0.0, False), (2, 34.0, True), (2, 34.0, True), (400, 154.0, False)]
    assert max(r["horizon"] for r in inventory.series_horizons(stock).collect()) == 407


def test_horizon_per_series_and_rules(spark):
    series = spark.createDataFrame(
        [("A", "red prawn mix fish", 2, "2024-01-01"), ("A", "MUNDI", 400, "2024-01-01"), ("B", "none", 0, "2024-01-01")],
        "center string, item string, days int, day string",
    )
    got = forecast.rule_forecast(series, "days", as_of="day")
    assert {r["item"]: r["count"] for r in got.groupBy("item").count().collect()} == {"red prawn mix fish": 2, "MUNDI": 400}
    first = {r["item"]: r["forecast"] for r in got.filter("step = 1").collect()}
    assert first == {"red prawn mix fish": 2000.0, "MUNDI": 600.0}  # the first rule wins
    own = forecast.rule_forecast(series, 1, as_of="day", rules=[("PRAWN", 300, 0, 1)], default=(150, 0, 1))
    assert sorted(r["forecast"] for r in own.collect()) == [150.0, 150.0, 300.0]


def test_metrics_and_model_choice(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (4.0, 5.0)], "actual double, predicted double")
    m = metrics.accuracy(df).first()
    assert m["mae"] == 1.0 and m["mse"] == 1.0 and m["rmse"] == 1.0
    assert abs(m["mape"] - (0.5 + 0.25) / 2 * 100) < 1e-12
    zero = spark.createDataFrame([(0.0, 1.0)], "actual double, predicted double")
    assert metrics.accuracy(zero).first()["mape"] is None
    mt = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "model string, rmse double")
    assert metrics.best_model(mt).first()["model"] == "a"


def test_best_run(spark):
    runs = spark.createDataFrame(
        [("r1", "e", 3.0, None), ("r2", "e", None, 1.0), ("r3", "e", 2.0, None), ("r4", "f", 9.0, 2.0)],
        "run_id string, experiment string, rmse double, mae double",
    )
    best = metrics.best_run(runs, "e").collect()
    assert [(r["run_id"], r["mae"]) for r in best] == [("r3", 0.0)]
    assert metrics.best_run(runs, "missing").count() == 0
    assert metrics.best_run(runs).count() == 2
