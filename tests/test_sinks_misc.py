import os
from datetime import date

from demandkit.operators import reports
from demandkit.sources import files
from demandkit.spec import PanelSpec

SPEC = PanelSpec(date="d", center="c", item="i", target="y", measures=())


def test_parquet_partitioned_sink_and_csv_forecast_sink(spark, tmp_out):
    df = spark.createDataFrame(
        [(date(2024, 1, k), c, "x", float(k)) for k in range(1, 4) for c in ("A", "B")], "d date, c string, i string, y double"
    )
    files.write_parquet(df, f"{tmp_out}/p", partition_by=["c"], sort_within=["c", "i", "d"])
    assert {"c=A", "c=B"} <= set(os.listdir(f"{tmp_out}/p"))
    back = files.read_parquet(spark, f"{tmp_out}/p")
    assert back.filter("c = 'B'").count() == 3  # partition column restored
    fc = spark.createDataFrame([("A", "x", date(2024, 2, 1), 1.5, 1.0, 2.0)], "center string, item string, date date, forecast double, lower_bound double, upper_bound double")
    files.write_csv(fc, f"{tmp_out}/fc")
    text = "".join(open(os.path.join(f"{tmp_out}/fc", n)).read() for n in os.listdir(f"{tmp_out}/fc") if n.endswith(".csv"))
    assert text.splitlines()[0] == "center,item,date,forecast,lower_bound,upper_bound"
    assert "A,x,2024-02-01,1.5,1.0,2.0" in text


def test_totals_counts_and_preview(spark):
    rows = [(date(2024, 1, k % 5 + 1), f"c{k % 3}", f"i{k % 4}", 1.0) for k in range(60)]
    df = spark.createDataFrame(rows, "d date, c string, i string, y double")
    totals = reports.center_item_totals(df, SPEC).collect()
    assert len(totals) == 12 and sum(r["total_demand"] for r in totals) == 60.0
    exact = reports.count_distinct_keys(df, SPEC).first()
    approx = reports.count_distinct_keys(df, SPEC, approximate=True).first()
    assert (exact["n_centers"], exact["n_items"]) == (3, 4) == (approx["n_centers"], approx["n_items"])
    head = reports.preview(df, ["d", "c", "i"], 5).collect()
    assert len(head) == 5 and all(r["d"] == date(2024, 1, 1) for r in head)
    assert reports.centers(df, SPEC).count() == 3 and reports.items_by_center(df, SPEC, "c0").count() == 4


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_queries_join_only_the_roles_they_use(spark):
    from demandkit.plans.queries import REGISTRY

    sf = "/root/testdata/sf0.001"
    for name in ("weekday_mean", "monthly_total", "date_bounds", "centers", "demand_by_center", "top_centers", "clean_dates"):
        assert "p_partkey" not in plan(REGISTRY[name](spark, sf)), name
    for name in ("top_items", "weekday_mean", "monthly_total", "date_bounds", "clean_dates"):
        assert "s_suppkey" not in plan(REGISTRY[name](spark, sf)), name


def test_backtest_limits_series_before_the_shuffle(spark):
    from demandkit.operators import models
    from demandkit.plans.queries import linear_model

    spec = PanelSpec(date="d", center="c", item="i", target="y", measures=())
    days = spark.range(100).selectExpr("date_add(date'2024-01-01', cast(id as int)) as d", "cast(id % 1 as string) as c", "cast(id % 1 as string) as i", "cast(id as double) as y")
    ft = days.selectExpr("*", "y as lag_1", "y as rolling_mean_7", "y as rolling_mean_14")
    out = models.backtest(linear_model(), ft, spec)
    assert abs(out.first()["mae"] - 1.0) < 1e-9
    text = out._jdf.queryExecution().executedPlan().toString()
    first = text.rindex("WindowGroupLimit")
    assert text.count("WindowGroupLimit") >= 2 and "Exchange" in text[:first]  # the partial limit is below the Exchange
    assert models.backtest(linear_model(), ft.filter("y < 30"), spec).first()["mae"] is None  # 30 rows are not more than 30


def test_history_keys_reach_the_scan(spark, tmp_out):
    from demandkit.operators import clean

    rows = [(date(2024, 1, k), c, "x", float(k)) for k in range(1, 4) for c in ("A", "B")]
    spark.createDataFrame(rows, "d date, c string, i string, y double").write.parquet(f"{tmp_out}/h")
    out = clean.history(files.read_parquet(spark, f"{tmp_out}/h"), SPEC, "2024-01-01", "2024-01-02", "A", "x")
    text = out._jdf.queryExecution().executedPlan().toString()
    pushed = text[text.index("PushedFilters") :]
    assert "EqualTo(c,A)" in pushed and "EqualTo(i,x)" in pushed and out.count() == 2


def test_pivot_names_and_bound(spark):
    import pytest

    df = spark.createDataFrame([("a", "center", 1.0), ("a", "x", 2.0), ("b", "x", 3.0)], "c string, i string, y double")
    got = {r["center"]: (r["item:center"], r["x"]) for r in reports.center_item_pivot(df, SPEC).collect()}
    assert got == {"a": (1.0, 2.0), "b": (0.0, 3.0)}
    with pytest.raises(ValueError):
        reports.center_item_pivot(df, SPEC, max_items=1)
