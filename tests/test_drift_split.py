import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandkit.functions.stats import ks_pvalue
from demandkit.operators import dense, drift, split
from demandkit.spec import PanelSpec


def brute_ks(a, b):
    a, b = np.sort(np.asarray(a, float)), np.sort(np.asarray(b, float))
    pts = np.concatenate([a, b])
    fa = np.searchsorted(a, pts, side="right") / len(a)
    fb = np.searchsorted(b, pts, side="right") / len(b)
    return float(np.max(np.abs(fa - fb)))


def frame(spark, xs, ys=None):
    rows = [(float(x), None if ys is None else ys[k]) for k, x in enumerate(xs)]
    return spark.createDataFrame(rows, "v double, w double")


def test_ks_matches_brute_force_with_ties_and_any_task_size(spark):
    rng = random.Random(7)
    a = [rng.choice([0, 1, 1, 2, 3, 5, 8]) + rng.random() * (k % 3 == 0) for k in range(700)]
    b = [rng.choice([1, 2, 2, 3, 13]) for _ in range(450)] + [2.0] * 300  # a hot value
    expected = brute_ks(a, b)
    for rows_per_task in (5, 40, 10_000):
        got = drift.ks_statistic(frame(spark, a), frame(spark, b), ["v"], rows_per_task=rows_per_task).first()
        assert abs(got["ks_statistic"] - expected) < 1e-12, rows_per_task
        assert (got["n_ref"], got["n_cur"]) == (700, 750)


def test_ks_identical_disjoint_nulls_and_missing_column(spark):
    xs = [float(k) for k in range(100)]
    same = drift.ks_test(frame(spark, xs), frame(spark, xs), ["v"]).first()
    assert same["ks_statistic"] == 0.0 and same["p_value"] == 1.0
    far = drift.ks_test(frame(spark, xs), frame(spark, [x + 1000 for x in xs]), ["v"]).first()
    assert far["ks_statistic"] == 1.0 and far["p_value"] < 1e-10
    ref = spark.createDataFrame([(1.0, 5), (None, 6), (float("nan"), 7)], "v double, only_ref int")
    cur = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert drift.shared_numeric_columns(ref, cur) == ["v"]
    out = drift.ks_statistic(ref, cur).collect()
    assert len(out) == 1 and out[0]["n_ref"] == 1 and out[0]["ks_statistic"] == 0.5


def test_ks_pvalue_series(spark):
    row = spark.range(1).select(
        ks_pvalue(F.lit(0.5), F.lit(100), F.lit(100)).alias("p"), ks_pvalue(F.lit(0.01), F.lit(10), F.lit(10)).alias("q")
    ).first()
    lam = 0.5 * math.sqrt(50)
    series = 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * lam * lam) for j in range(1, 101))
    assert abs(row["p"] - series) < 1e-15 and row["q"] == 1.0


def test_moments_bias_corrected_and_constant(spark):
    df = spark.createDataFrame([(x, 4.0) for x in [1.0, 2.0, 3.0, 10.0, 7.0]], "a double, k double")
    m = {r["column_name"]: r for r in drift.column_moments(df).collect()}
    x = np.array([1.0, 2.0, 3.0, 10.0, 7.0])
    n, d = len(x), x - x.mean()
    m2, m3, m4 = (d**2).mean(), (d**3).mean(), (d**4).mean()
    g1 = m3 / m2**1.5 * math.sqrt(n * (n - 1)) / (n - 2)
    g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2**2 - 3) + 6)
    assert abs(m["a"]["skew"] - g1) < 1e-12 and abs(m["a"]["kurtosis"] - g2) < 1e-12
    assert round(g1, 5) == 0.79333 and round(g2, 5) == -1.25336
    assert m["k"]["std"] == 0.0 and m["k"]["skew"] == 0.0 and m["k"]["kurtosis"] == 0.0
    tiny = drift.column_moments(spark.createDataFrame([(1.0,), (2.0,)], "a double")).first()
    assert tiny["skew"] is None and tiny["kurtosis"] is None


def test_drift_report_and_alerts(spark):
    ref = spark.createDataFrame([(float(k), 1.0) for k in range(200)], "v double, c double")
    cur = spark.createDataFrame([(float(k) + 150, 1.0) for k in range(200)], "v double, c double")
    rep = {r["column_name"]: r for r in drift.drift_report(ref, cur).collect()}
    assert rep["v"]["severity"] == "high" and rep["v"]["drift_detected"] is True
    assert abs(rep["v"]["mean_shift"] - 150 / np.std(np.arange(200), ddof=1)) < 1e-9
    assert rep["c"]["mean_shift"] is None and rep["c"]["severity"] == "low"  # std 0 -> NULL
    assert [r[0] for r in drift.drift_alerts(drift.drift_report(ref, cur)).collect()] == ["v"]


SPEC = PanelSpec(date="d", center="c", item="i", target="y", measures=())


def test_split_rows_tail_matches_row_order(spark):
    rows = [(date(2024, 1, 1) + timedelta(days=k), c, i, 1.0) for k in range(0, 9, 4) for c in "AB" for i in "xy"]
    daily = dense.daily_aggregate(spark.createDataFrame(rows, "d date, c string, i string, y double"), SPEC)
    panel = dense.dense_panel(daily, SPEC)
    out = split.split_rows_tail(panel, SPEC, 0.2).collect()
    ordered = sorted(out, key=lambda r: (r["c"], r["i"], r["d"]))
    assert [r["row_index"] for r in ordered] == list(range(36))
    assert sum(r["split"] == "test" for r in out) == math.ceil(0.2 * 36)
    assert all(r["split"] == "test" for r in ordered[-8:])
    sparse = split.split_rows_tail(daily, SPEC, 0.5).collect()  # not dense: exact fallback
    assert sorted(r["row_index"] for r in sparse) == list(range(12))
    by_date = split.split_by_date(panel, SPEC, 0.2).collect()
    assert {r["d"] for r in by_date if r["split"] == "test"} == {date(2024, 1, 8), date(2024, 1, 9)}


def test_report_from_reference_profile_equals_batch_report(spark):
    ref = spark.createDataFrame([(float(k % 7), k, None) for k in range(40)], "a double, b int, c double")
    cur = spark.createDataFrame([(float(k % 5) + 0.5, k * 2, 1.0) for k in range(25)], "a double, b int, c double")
    batch = {r["column_name"]: r.asDict() for r in drift.drift_report(ref, cur, rows_per_task=9).collect()}
    profile = drift.reference_profile(ref)
    streamed = {r["column_name"]: r.asDict() for r in drift.drift_report_from_profile(profile, cur, rows_per_task=9).collect()}
    assert batch.keys() == streamed.keys() == {"a", "b", "c"}
    for name, row in batch.items():
        for key, value in row.items():
            other = streamed[name][key]
            if isinstance(value, float):
                assert other == pytest.approx(value, rel=1e-12, abs=1e-12), (name, key)
            else:
                assert other == value, (name, key)
    only_a = spark.createDataFrame([(1.0,)], "a double")  # columns absent from current are skipped
    assert [r["column_name"] for r in drift.drift_report_from_profile(profile, only_a).collect()] == ["a"]


def test_ks_window_tasks_stay_bounded_and_nothing_stays_cached(spark):
    many = spark.range(20_000).selectExpr("cast(id as double) as v", "cast(id % 3 as double) as w")
    pinned = drift.pinned_counts(drift.value_counts(many, many, ["v", "w"]), rows_per_task=1000)
    sizes = [r["count"] for r in pinned.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 3000, sizes
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    got = {r["column_name"]: r["ks_statistic"] for r in drift.ks_from_counts(pinned, ["v", "w"]).collect()}
    assert got == {"v": 0.0, "w": 0.0}
    drift.drift_report(many, many).collect()
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before


def test_report_without_values_or_columns(spark):
    ref = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "a double, gone double")
    cur = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, gone double")
    rep = {r["column_name"]: r for r in drift.drift_report(ref, cur).collect()}
    assert rep["a"]["severity"] == "low"
    assert (rep["gone"]["ks_statistic"], rep["gone"]["p_value"], rep["gone"]["drift_detected"], rep["gone"]["severity"]) == (None,) * 4
    text = spark.createDataFrame([("x",)], "b string")
    for a, b in ((ref, text), (text, text)):
        empty = drift.drift_report(a, b)
        assert empty.count() == 0 and empty.columns == drift.drift_report(ref, cur).columns
        assert drift.drift_alerts(empty).count() == 0
    assert drift.drift_report_from_profile(drift.reference_profile(text), ref).count() == 0


def test_split_sees_a_duplicate_that_hides_a_gap(spark):
    d = [date(2024, 1, k) for k in (1, 2, 3)]
    rows = [(d[0], "A", "x", 1.0), (d[0], "A", "x", 2.0), (d[2], "A", "x", 3.0)]
    out = split.split_rows_tail(spark.createDataFrame(rows, "d date, c string, i string, y double"), SPEC, 0.3)
    assert sorted(r["row_index"] for r in out.collect()) == [0, 1, 2]
