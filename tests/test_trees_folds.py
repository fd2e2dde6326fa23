"""Early stopping, expanding windows, compiled trees, run histories, rule tables, sketches, noise and exact KS."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from demandkit.functions import stats
from demandkit.operators import drift, forecast, metrics, models, reports, rules_table, split, trees
from demandkit.sources import results
from demandkit.spec import PanelSpec

SPEC = PanelSpec("d", "c", "i", "y", ())
SMALL = models.BoostingParams(max_iter=6, max_depth=3)


def panel(spark, days=120, noise=1.0, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(days):
        for c in "AB":
            a, b = rng.random() * 10, rng.random()
            rows.append((date(2024, 1, 1) + timedelta(days=k), c, "x", 3 * a + (5 if b > 0.5 else 0) + noise * rng.gauss(0, 1), a, b))
    return spark.createDataFrame(rows, "d date, c string, i string, y double, a double, b double")


def test_early_stopping_keeps_fewer_rounds(spark):
    data, feats = models.prepare(panel(spark, noise=20.0), SPEC)
    params = {
        "all": models.BoostingParams(max_iter=12, max_depth=2),
        "stopped": models.BoostingParams(max_iter=12, max_depth=2, validation_share=0.25, validation_tol=0.02),
    }
    fitted = models.fit_all(data, feats, SPEC, params)
    assert models.rounds_kept(fitted["all"]) == 12 > models.rounds_kept(fitted["stopped"]) >= 1
    marked = models.mark_validation(data, SPEC, 0.25)
    ends = {r[0]: (r[1], r[2]) for r in marked.groupBy(models.VALIDATION).agg(F.min("d"), F.max("d")).collect()}
    assert ends[False][1] < ends[True][0] and (ends[True][1] - ends[True][0]).days == 29
    # The mark is no feature.
    assert fitted["stopped"].stages[0].getInputCols() == feats


def test_result_reports_rounds(spark):
    out = models.train_models(panel(spark, 60), SPEC, params={"m": SMALL})
    assert out.rounds == {"m": 6}


def test_fold_days():
    assert split.fold_days(100, 3) == [(1, 25, 50), (2, 50, 75), (3, 75, 100)]
    assert split.fold_days(11, 3, gap=2) == [(1, 5, 7), (2, 7, 9), (3, 9, 11)]
    for bad in ((3, 3, 0), (8, 3, 2), (10, 0, 0)):
        with pytest.raises(ValueError):
            split.fold_days(*bad)


def test_expanding_folds_never_look_ahead(spark):
    folds = split.expanding_folds(panel(spark, 50), SPEC, 4, gap=3).cache()
    ends = {(r.fold, r.role): (r.lo, r.hi, r.n) for r in folds.groupBy("fold", "role").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("n")).collect()}
    for k in range(1, 5):
        (lo, hi, n), (start, end, m) = ends[k, "train"], ends[k, "test"]
        assert lo == date(2024, 1, 1) and (start - hi).days == 4 and m == 20 and n == 2 * ((hi - lo).days + 1)
    assert ends[4, "test"][1] == date(2024, 2, 19)
    assert split.expanding_folds(panel(spark, 50).limit(0), SPEC).count() == 0
    plan = split.expanding_folds(panel(spark, 50), SPEC)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate") == 1


def test_cross_validate(spark):
    out = {(r.model, r.fold): r.rmse for r in models.cross_validate(panel(spark, 80), SPEC, 3, {"m": SMALL}).collect()}
    assert set(out) == {("m", 1), ("m", 2), ("m", 3)} and all(v < 20 for v in out.values())


def test_compiled_trees_equal_the_model(spark):
    data, feats = models.prepare(panel(spark), SPEC)
    model = models.fit(data, feats, SPEC, models.BoostingParams(max_iter=8, max_depth=4))
    nodes = trees.ensemble_nodes(model)
    odd = data.limit(1).withColumn("a", F.lit(float("nan"))).unionByName(data.limit(1).withColumn("b", F.lit(1e300)))
    rows = data.unionByName(odd)
    both = trees.as_model(nodes).transform(model.transform(rows).withColumnRenamed("prediction", "want"))
    assert both.agg(F.max(F.abs(F.col("prediction") - F.col("want")))).first()[0] < 1e-9
    got = {r.feature: r.importance for r in trees.node_importance(nodes, None).collect()}
    want = {r.feature: r.importance for r in models.feature_importance(model, None).collect() if r.importance > 0}
    assert got == pytest.approx(want, abs=1e-9)


def test_stored_trees_come_back(spark, tmp_path):
    data, feats = models.prepare(panel(spark), SPEC)
    nodes = trees.ensemble_nodes(models.fit(data, feats, SPEC, SMALL))
    trees.save_nodes(nodes, str(tmp_path / "n"))
    back = trees.load_nodes(spark, str(tmp_path / "n"))
    assert sorted(map(str, back.collect())) == sorted(map(str, nodes.collect()))
    with pytest.raises(ValueError):
        trees.compile_nodes(back, max_nodes=3)
    plan = trees.as_model(back).transform(data.drop("c"))._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and "VectorAssembler" not in plan


def test_run_history(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert results.read_runs(spark, path).count() == 0
    assert metrics.best_run_params(results.read_runs(spark, path), ["depth"]).count() == 0
    first = spark.createDataFrame([("e", "r1", {"rmse": 2.0})], "experiment string, run_id string, metrics map<string,double>")
    later = spark.createDataFrame(
        [("e", "r2", {"rmse": 1.0, "r2": 0.5}, {"depth": "6"}), ("f", "r3", {"mae": 1.0}, None)],
        "experiment string, run_id string, metrics map<string,double>, params map<string,string>",
    )
    results.append_runs(first, path)
    results.append_runs(later, path)
    got = metrics.best_run_params(results.read_runs(spark, path), ["depth", "none"]).orderBy("experiment").collect()
    assert [tuple(r) for r in got] == [("e", "r2", "runs:/r2/model", 1.0, "6", None), ("f", "r3", "runs:/r3/model", 0.0, None, None)]


def test_rule_table_against_a_loop(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcAB é") for _ in range(rng.randrange(0, 9))) for _ in range(150)]
    rules = [(k, "".join(rng.choice("abcé ") for _ in range(max(1, 5 - k // 15))), float(k)) for k in range(60)]
    rules += [(100, None, 0.0), (101, "bca", 1.0)]
    texts = spark.createDataFrame([(w,) for w in words] + [(None,)], "item string")
    frame = spark.createDataFrame(rules, "rule_order int, keyword string, base double")

    def brute(text, own):
        hit = [r for r in own if text is not None and r[1] is not None and r[1].upper() in text.upper()]
        return min(hit)[0] if hit else None

    got = {r.item: r.rule_order for r in rules_table.match_rules(texts, frame).collect()}
    assert got == {w: brute(w, rules) for w in [*words, None]}
    assert any(v is None for k, v in got.items() if k) and len(set(got.values())) > 10
    every = frame.unionByName(spark.createDataFrame([(50_000, "", 9.0)], frame.schema))
    got = {r.item: r.rule_order for r in rules_table.match_rules(texts, every).collect()}
    assert got == {w: brute(w, [*rules, (50_000, "", 9.0)]) for w in [*words, None]}
    assert rules_table.match_rules(texts.limit(0), frame).count() == 0
    assert {r.rule_order for r in rules_table.match_rules(texts, frame.limit(0)).collect()} == {None}


def test_rule_table_gives_the_same_forecast_as_the_chain(spark):
    from demandkit.functions.rules import FORECAST_RULES

    series = spark.createDataFrame([("A", "Prawn Mundi"), ("A", "chilapi"), ("B", "other"), ("B", "MIX FISH")], "center string, item string")
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(FORECAST_RULES)], "rule_order int, keyword string, base double, amplitude double, frequency double")
    a = forecast.rule_forecast(series, 40, as_of="2024-02-20").collect()
    b = forecast.rule_forecast(series, 40, as_of="2024-02-20", rules=table).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_noise_does_not_depend_on_the_layout(spark):
    series = spark.range(40).select(F.concat(F.lit("c"), F.col("id") % 5).alias("center"), F.concat(F.lit("i"), "id").alias("item"))

    def drawn(df, seed=3):
        return sorted(map(tuple, forecast.rule_forecast(df, 60, as_of="2024-01-01", noise_sd=25.0, seed=seed).collect()))

    one = drawn(series.coalesce(1))
    assert one == drawn(series.repartition(64)) and one != drawn(series, seed=4)
    plain = {(r.center, r.item, r.step): r.forecast for r in forecast.rule_forecast(series, 60, as_of="2024-01-01").collect()}
    gaps = [r[4] - plain[r[0], r[1], r[3]] for r in one]
    mean = sum(gaps) / len(gaps)
    sd = (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5
    assert abs(mean) < 2.5 and abs(sd - 25) < 2.5 and all(0.7 <= r[7] <= 0.95 for r in one)


def brute_ks_p(d, n, m):
    """Share of all orders of two samples whose statistic is at least d, by dynamic counting in whole numbers."""
    h = round(d * n * m)
    rows = [[0] * (m + 1) for _ in range(n + 1)]
    every = [[1] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                every[i][j] = every[i - 1][j] + every[i][j - 1]
            if abs(i * m - j * n) < h:
                rows[i][j] = 1 if i == j == 0 else (rows[i - 1][j] if i else 0) + (rows[i][j - 1] if j else 0)
    return 1 - rows[n][m] / every[n][m]


def test_exact_ks_against_counted_paths():
    rng = random.Random(9)
    for _ in range(150):
        n, m = rng.randrange(1, 25), rng.randrange(1, 25)
        h = rng.randrange(0, n * m + 1)
        assert stats.ks_path_share(h / (n * m), n, m) == pytest.approx(brute_ks_p(h / (n * m), n, m), abs=1e-12)
    # Fixed values from tables of the two-sample statistic: n = m = 5, D = 4/5 and D = 1.
    assert stats.ks_path_share(0.8, 5, 5) == pytest.approx(20 / 252) and stats.ks_path_share(1.0, 5, 5) == pytest.approx(2 / 252)
    # Long samples: close to the limit distribution, however many paths there are.
    d, n, m = 0.02, 9000, 9500
    lam = d * (n * m / (n + m)) ** 0.5
    limit = 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * lam * lam) for j in range(1, 50))
    assert stats.ks_path_share(d, n, m) == pytest.approx(limit, rel=0.03)


def test_ks_methods(spark):
    rng = random.Random(1)
    a = spark.createDataFrame([(float(rng.randrange(8)),) for _ in range(13)], "x double")
    b = spark.createDataFrame([(float(rng.randrange(3, 11)),) for _ in range(17)], "x double")
    got = {m: drift.ks_test(a, b, method=m).first() for m in stats.KS_METHODS}
    want = brute_ks_p(got["exact"].ks_statistic, 13, 17)
    assert got["exact"].p_value == got["auto"].p_value == pytest.approx(want) != got["asymptotic"].p_value
    many = spark.range(stats.KS_EXACT_MAX + 1).select(F.col("id").cast("double").alias("x"))
    large = {m: drift.ks_test(many, b, method=m).first().p_value for m in ("auto", "asymptotic")}
    assert large["auto"] == large["asymptotic"]
    with pytest.raises(ValueError):
        drift.ks_test(a, b, method="guess")
    none = drift.ks_test(a, b.limit(0)).first()
    assert none.p_value is None


def test_profile_parts_add_up(spark):
    table = spark.range(60_000).select(
        F.date_add(F.lit("2024-01-01"), (F.col("id") % 90).cast("int")).cast("string").alias("DATE"),
        F.when(F.col("id") % 100 != 0, F.concat(F.lit("c"), F.col("id") % 7_001)).alias("CENTER NAME"),
        F.concat(F.lit("i"), F.col("id") % 31).alias("ITEM"),
        (F.col("id") % 10).cast("string").alias("PAY WEIGHT"),
    )
    exact = reports.profile(table)[0].first()
    day = F.substring("DATE", 1, 7)
    old, new = reports.profile_parts(table.filter("DATE < '2024-03-01'"), by=day), reports.profile_parts(table.filter("DATE >= '2024-03-01'"), by=day)
    got = reports.merge_profile(old.unionByName(new)).first()
    for name in ("total_records", "date_start", "date_end", "n_products", "total_demand"):
        assert got[name] == exact[name], name
    assert abs(got.n_centers - exact.n_centers) / exact.n_centers < 4 * 1.04 / 2 ** (reports.SKETCH_BITS / 2)
    whole = reports.merge_profile(reports.profile_parts(table)).first()
    assert abs(whole.n_centers - got.n_centers) / exact.n_centers < 0.01
    empty = reports.merge_profile(reports.profile_parts(table.limit(0))).first()
    assert empty.total_records == 0 and empty.n_centers == 0


def test_center_item_map_has_no_item_limit(spark):
    many = spark.range(30_000).select(
        F.concat(F.lit("c"), F.col("id") % 2).alias("c"), F.concat(F.lit("i"), F.col("id") % 12_000).alias("i"), F.lit(1.5).alias("y")
    )
    got = {r.center: r for r in reports.center_item_map(many.unionByName(many.limit(1).withColumn("i", F.lit(None).cast("string"))), SPEC).collect()}
    assert got["c0"].n_items == len(got["c0"].totals) == 6_000 and got["c1"].totals["i1"] == 4.5
    assert "none" not in got["c0"].totals
