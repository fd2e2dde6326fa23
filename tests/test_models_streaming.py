import os
import time
from dataclasses import replace

from pyspark.sql import functions as F

from demandkit.operators import dense, features, models
from demandkit.plans import jobs
from demandkit.sources import results, synthetic
from demandkit.spec import PanelSpec
from demandkit.streaming import incremental

SPEC = PanelSpec(measures=())
SMALL = {n: replace(p, max_iter=5) for n, p in models.MODEL_PARAMS.items()}


def feature_table(spark):
    raw = synthetic.synthetic_panel(spark, "2023-01-01", "2023-03-31", centers=("KASARA", "VASAI"), items=("CHILAPI", "MUNDI"))
    daily = dense.daily_aggregate(raw.withColumn("DATE", F.to_date("DATE")), SPEC)
    return features.build_features(dense.dense_panel(daily, SPEC), SPEC).cache()


def test_synthetic_panel_values(spark):
    df = synthetic.synthetic_panel(spark)
    assert df.count() == 366 * 25
    row = df.filter((F.col("ITEM") == "MIX FISH") & (F.to_date("DATE") == F.lit("2023-01-07").cast("date"))).first()
    import math

    assert row["PAY WEIGHT"] == float(int(2000 * (1 + 0.3 * math.sin(2 * math.pi * 7 / 365)) * 1.2))


def test_train_forecast_backtest_save_load(spark, tmp_out):
    ft = feature_table(spark)
    result = models.train_models(ft, SPEC, 0.2, "date", SMALL)
    assert set(result.models) == {"xgboost", "lightgbm"} and len(result.features) == 27
    assert result.best in result.models
    m = result.metrics.collect()
    assert all(r["rmse"] >= 0 and r["mae"] >= 0 for r in m)
    imp = models.feature_importance(result.models["xgboost"], top=None).collect()
    assert abs(sum(r["importance"] for r in imp) - 1.0) < 1e-9 and len(imp) == 27
    fc = models.forecast(result.models["xgboost"], ft, 7, SPEC).collect()
    assert len(fc) == 7 * 4 and all(r["lower_bound"] <= max(r["forecast"], 0) <= r["upper_bound"] or r["forecast"] < 0 for r in fc)
    bt = models.backtest(result.models["xgboost"], ft, SPEC).first()
    assert bt["rmse"] is not None
    models.save_models(result, f"{tmp_out}/models")
    loaded = models.load_model(f"{tmp_out}/models", "xgboost")
    again = models.forecast(loaded, ft, 7, SPEC).orderBy("center", "item", "date").collect()
    assert [r["forecast"] for r in again] == [r["forecast"] for r in sorted(fc, key=lambda r: (r["center"], r["item"], r["date"]))]
    rec = results.training_record(result.metrics, result.best, result.features, when="2024-01-01T00:00:00")
    results.write_record(rec, f"{tmp_out}/record")
    back = results.read_record(spark, f"{tmp_out}/record").collect()
    assert sum(r["is_best"] for r in back) == 1 and back[0]["feature_columns"] == result.features
    assert results.read_record(spark, f"{tmp_out}/nothing").count() == 0


def test_rows_split_parity_mode(spark):
    ft = feature_table(spark)
    data, _ = models.prepare(ft, SPEC)
    train, test = models.split(data, SPEC, 0.2, "rows")
    n = data.count()
    assert test.count() == -(-n * 2 // 10) and train.count() + test.count() == n
    # the test part is the tail of the last series in (center, item) order
    assert test.filter((F.col("CENTER NAME") == "VASAI") & (F.col("ITEM") == "MUNDI")).count() == 72 == test.count()


def test_feature_job_end_to_end(spark, tmp_out):
    path = f"{tmp_out}/raw.csv"
    with open(path, "w") as fh:
        fh.write("DATE,CENTER NAME,ITEM,PAY WEIGHT,AMOUNT,RATE,BOX,NET\n")
        fh.write("2024-01-01,A,X,10,100,10,1,0\n2024-01-03,A,Y,5,50,10,1,0\n2024-01-03 08:00:00,B,X,bad,1,1,1,\n")
    out = jobs.build_features(spark, path, f"{tmp_out}/features")
    assert out.features.count() == 3 * 2 * 2
    s = out.summary.first()
    assert s["total_demand"] == 15.0 and s["n_features"] == 30
    assert [r["ITEM"] for r in out.top_items.collect()] == ["X", "Y"]
    assert os.path.isdir(f"{tmp_out}/features")


def test_streaming_daily_aggregate_and_drift_monitor(spark, tmp_out):
    src = f"{tmp_out}/stream_in"
    spec = PanelSpec(measures=(("AMOUNT", "sum"),))
    df = spark.createDataFrame(
        [("2024-01-01 10:00:00", "A", "x", 2.0, 1.0), ("2024-01-01 12:00:00", "A", "x", 3.0, 1.0), ("2024-01-05 09:00:00", "A", "x", 1.0, 1.0), ("2024-01-01 11:00:00", None, "x", 9.0, 1.0)],
        "DATE string, `CENTER NAME` string, ITEM string, `PAY WEIGHT` double, AMOUNT double",
    ).withColumn("DATE", F.col("DATE").cast("timestamp"))
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    agg = incremental.daily_aggregate_stream(stream, "1 day", spec)
    q = (
        agg.writeStream.outputMode("update")
        .format("memory")
        .queryName("daily_stream_test")
        .option("checkpointLocation", incremental.checkpoint_location(stream, f"daily-{time.time_ns()}", tmp_out))
        .start()
    )
    q.processAllAvailable()
    q.stop()
    got = {(str(r["DATE"]), r["PAY WEIGHT"]) for r in spark.sql("select * from daily_stream_test").collect()}
    assert got == {("2024-01-01", 5.0), ("2024-01-05", 1.0)}  # NULL keys form no group, as in batch
    reports = []
    ref = spark.createDataFrame([(float(k),) for k in range(50)], "`PAY WEIGHT` double")
    mon = incremental.drift_monitor(
        spark.readStream.schema(df.schema).parquet(src).select("PAY WEIGHT"),
        ref,
        lambda rep, bid: reports.append(rep.collect()),
        name=f"drift-{time.time_ns()}",
        location=tmp_out,
    )
    mon.processAllAvailable()
    mon.stop()
    assert reports and reports[0][0]["column_name"] == "PAY WEIGHT"


def test_train_and_forecast_jobs_with_inventory(spark, tmp_out):
    ft = feature_table(spark)
    ft.write.parquet(f"{tmp_out}/features")
    small = {"xgboost": SMALL["xgboost"]}
    result = jobs.train(spark, f"{tmp_out}/features", f"{tmp_out}/models", f"{tmp_out}/results", SPEC, params=small)
    assert result.best == "xgboost"
    assert results.read_record(spark, f"{tmp_out}/results").count() == 1
    stock = spark.createDataFrame(
        [("KASARA", "CHILAPI", 10.0, 3), ("VASAI", "MUNDI", 1e9, 2), ("NOWHERE", "X", 5.0, 1)],
        "center string, item string, current_stock double, lead_time int",
    )
    out = jobs.forecast_job(spark, f"{tmp_out}/features", f"{tmp_out}/models", "xgboost", 5, stock, SPEC)
    fc, recs, bt = out.forecast, out.recommendations, out.backtest
    assert out.importances.count() > 0
    one = spark.createDataFrame([("VASAI", "MUNDI")], "`CENTER NAME` string, ITEM string")
    only = jobs.forecast_job(spark, f"{tmp_out}/features", f"{tmp_out}/models", "xgboost", 5, spec=SPEC, series=one)
    assert only.forecast.count() == 5 and only.recommendations is None
    assert fc.count() == 4 * 5 and fc.agg(F.max("step")).first()[0] == 5
    by = {(r["center"], r["item"]): r for r in recs.collect()}
    assert by[("VASAI", "MUNDI")]["recommended_order"] == 0.0
    assert by[("NOWHERE", "X")]["reorder_point"] == 0.0  # no forecast for the pair
    assert by[("KASARA", "CHILAPI")]["expected_demand"] > 0
    assert bt.first()["rmse"] is not None
    import pytest

    with pytest.raises(ValueError):
        models.load_model(f"{tmp_out}/models", "unknown")


def test_drift_job_from_parquet(spark, tmp_out):
    ref = spark.createDataFrame([(float(k), k % 3) for k in range(300)], "v double, g int")
    cur = spark.createDataFrame([(float(k) * 2, k % 3) for k in range(300)], "v double, g int")
    ref.write.parquet(f"{tmp_out}/ref")
    cur.write.parquet(f"{tmp_out}/cur")
    report, alerts = jobs.drift_job(spark, f"{tmp_out}/ref", f"{tmp_out}/cur")
    rows = {r["column_name"]: r for r in report.collect()}
    assert rows["g"]["ks_statistic"] == 0.0 and rows["g"]["severity"] == "low"
    assert rows["v"]["drift_detected"] and [r[0] for r in alerts.collect()] == ["v"]


def test_stream_goes_on_where_it_stopped(spark, tmp_out):
    src, place = f"{tmp_out}/restart_in", f"{tmp_out}/progress"
    one = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    one.write.parquet(src)
    ref = spark.createDataFrame([(float(k),) for k in range(9)], "v double")
    seen = []

    def run():
        stream = spark.readStream.schema(one.schema).parquet(src)
        query = incremental.drift_monitor(stream, ref, lambda rep, batch: seen.append((batch, rep.count())), name="again", location=place)
        query.processAllAvailable()
        query.stop()

    run()
    run()  # nothing new: no batch is repeated
    one.write.mode("append").parquet(src)
    run()
    assert seen == [(0, 1), (1, 1)]
    import pytest

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError):
            incremental.checkpoint_location(one, "x")
