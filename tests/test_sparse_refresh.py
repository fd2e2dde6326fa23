"""Features without the panel, and the incremental store that is built on them."""

import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from demandkit.operators import dense, features
from demandkit.plans import refresh
from demandkit.sources import files
from demandkit.spec import FeatureConfig, PanelSpec

SPEC = PanelSpec("d", "c", "i", "y", (("a", "sum"), ("r", "mean")))
SCHEMA = "d date, c string, i string, y double, a double, r double"


def gappy(rng, start=date(2023, 11, 20), days=90, n=260):
    """Sales of a few series with long gaps, single days, negative values and missing numbers."""
    out = []
    for _ in range(n):
        c, i = rng.choice("AB"), rng.choice("xyz")
        y = rng.choice([None, 0.0, -4.5, 7.25, 12.0, rng.uniform(0, 100)])
        out.append((start + timedelta(days=min(int(rng.expovariate(0.03)), days)), c, i, y, rng.choice([None, 1.5]), rng.choice([None, 2.0, 3.5])))
    return out


def shown(df, keys=("d", "c", "i")):
    names = sorted(df.columns)
    rows = {}
    for r in df.collect():
        rows[tuple(r[k] for k in keys)] = {c: (round(r[c], 8) + 0.0 if isinstance(r[c], float) else r[c]) for c in names}
    return rows


def assert_same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        for c in want[k]:
            a, b = got[k][c], want[k][c]
            assert a == b or (isinstance(a, float) and a == pytest.approx(b, abs=1e-7)), (k, c, a, b)


CONFIGS = [
    FeatureConfig(),
    FeatureConfig(exclude_current=True),
    FeatureConfig(lags=(1, 2, 30), windows=(1, 2, 45), seasonal=False),
]


@pytest.mark.parametrize("cfg", CONFIGS)
def test_equal_to_the_dense_path_on_observed_rows(spark, cfg):
    sales = spark.createDataFrame(gappy(random.Random(4)), SCHEMA)
    daily = dense.daily_aggregate(sales, SPEC)
    whole = features.build_features(dense.dense_panel(daily.cache(), SPEC), SPEC, cfg)
    # The dense panel fills a missing mean with the global one; the sparse rows keep it as it is.
    want = shown(whole.join(daily.select("d", "c", "i"), ["d", "c", "i"], "left_semi").drop("r"))
    assert_same(shown(features.sparse_features(daily, SPEC, cfg).drop("r")), want)


def test_no_grid_in_the_plan(spark):
    daily = dense.daily_aggregate(spark.createDataFrame(gappy(random.Random(5)), SCHEMA), SPEC)
    plan = features.sparse_features(daily, SPEC, FeatureConfig(), start="2023-11-20")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("Window [") == 1


def test_equal_values_have_no_deviation(spark):
    """The deviation of equal values is 0, not the noise of a difference of squares."""
    rows = [(date(2024, 1, 1) + timedelta(days=k), "A", "x", 1e6 + 0.1, None, None) for k in range(20)]
    got = features.sparse_features(spark.createDataFrame(rows, SCHEMA), SPEC).collect()
    assert {r.rolling_std_7 for r in got} == {None, 0.0}


def test_odd_inputs(spark):
    empty = features.sparse_features(spark.createDataFrame([], SCHEMA), SPEC)
    assert empty.count() == 0 and "rolling_std_14" in empty.columns
    with pytest.raises(TypeError):
        features.sparse_features(spark.createDataFrame([], SCHEMA).withColumn("d", F.col("d").cast("timestamp")), SPEC)


def full_load(spark, sales, tmp, cfg=FeatureConfig()):
    refresh.refresh_features(sales, tmp, "all", SPEC, cfg)
    return shown(refresh.read_features(spark, tmp))


def snapshot(path):
    return {f: os.stat(f).st_mtime_ns for d, _, names in os.walk(path) for f in (os.path.join(d, n) for n in names) if f.endswith(".parquet")}


@pytest.mark.parametrize("cut", ["late", "appended", "earlier"])
def test_two_loads_equal_one(spark, tmp_path, cut):
    sales = spark.createDataFrame(gappy(random.Random(8), days=150), SCHEMA)
    first = {
        "late": (F.col("d") < "2024-01-10") & (F.col("i") != "z"),
        "appended": F.col("d") < "2024-01-10",
        "earlier": F.col("d") >= "2023-12-05",  # the second load moves the panel's first day
    }[cut]
    path = str(tmp_path / "store")
    refresh.refresh_features(sales.filter(first), path, "one", SPEC)
    refresh.refresh_features(sales.filter(~first), path, "two", SPEC)
    got = shown(refresh.read_features(spark, path))
    assert_same(got, full_load(spark, sales, str(tmp_path / "whole")))
    daily = dense.daily_aggregate(sales, SPEC)
    assert_same(shown(refresh.read_daily(spark, path, SPEC)), shown(daily))


def test_untouched_months_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(date(2024, 1, 1) + timedelta(days=k), "A", "x", float(k), 1.0, 1.0) for k in range(100)]
    old = spark.createDataFrame(rows, SCHEMA)
    done = refresh.refresh_features(old, path, "old", SPEC)
    assert done.mark == date(2024, 4, 9) and done.months == ("2024-01", "2024-02", "2024-03", "2024-04")
    before = snapshot(f"{path}/features")
    new = spark.createDataFrame([(date(2024, 4, 10), "A", "x", 5.0, 1.0, 1.0), (date(2024, 5, 2), "B", "x", 5.0, 1.0, 1.0)], SCHEMA)
    done = refresh.refresh_features(new, path, "new", SPEC)
    assert done.mark == date(2024, 5, 2) and done.months == ("2024-04", "2024-05")
    after = snapshot(f"{path}/features")
    kept = {f: t for f, t in before.items() if "2024-04" not in f}
    assert kept and all(after.get(f) == t for f, t in kept.items())
    assert not [f for f in before if "2024-04" in f and f in after]


def test_a_load_run_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    sales = spark.createDataFrame(gappy(random.Random(2)), SCHEMA)
    late = F.col("c") == "B"
    refresh.refresh_features(sales.filter(~late), path, "one", SPEC)
    refresh.refresh_features(sales.filter(late), path, "two", SPEC)
    want = shown(refresh.read_features(spark, path))
    # As after a failure between the two writes: the load is there, its features are run again.
    refresh.refresh_features(sales.filter(late), path, "two", SPEC)
    assert_same(shown(refresh.read_features(spark, path)), want)
    done = refresh.refresh_features(sales.limit(0), path, "none", SPEC)
    assert done.months == () and done.mark is not None
    assert_same(shown(refresh.read_features(spark, path)), want)


def test_lookup_columns_skip_row_groups(spark, tmp_path):
    """Sorted files with Bloom filters: a search for one series reads only its row groups."""
    table = spark.range(200_000).select(
        F.concat(F.lit("c"), F.col("id") % 50).alias("c"), F.concat(F.lit("i"), F.col("id") % 40).alias("i"), F.col("id").cast("double").alias("y")
    )
    spark.conf.set("parquet.block.size", 64 * 1024)
    try:
        files.write_parquet(table.coalesce(1), str(tmp_path / "t"), sort_within=["c", "i"], lookup=["c", "i"])
    finally:
        spark.conf.unset("parquet.block.size")
    found = files.read_parquet(spark, str(tmp_path / "t")).filter("c = 'c7' and i = 'i7'")
    assert found.agg(F.sum("y")).count() == 1
    rows = found.collect()
    assert len(rows) == 1000

    def scans(plan):
        own = [plan] if plan.nodeName().startswith("Scan") else []
        children = [plan.children().apply(k) for k in range(plan.children().size())]
        if plan.nodeName() == "AdaptiveSparkPlan":
            children = [plan.executedPlan()]
        return own + [s for c in children for s in scans(c)]

    executed = found._jdf.queryExecution().executedPlan()
    found._jdf.collectToPython()
    read = sum(s.metrics().apply("numOutputRows").value() for s in scans(executed))
    assert 0 < read < 100_000, read
