"""The feature table against a brute force that computes every cell from the raw
rows on its own, plus a hot-key fixture where one series holds a third of all rows."""

import math
import random
import statistics
from datetime import date, timedelta

from demandkit.operators import dense, features
from demandkit.spec import FeatureConfig, PanelSpec

SPEC = PanelSpec(date="d", center="c", item="i", target="y", measures=(("amt", "sum"), ("rate", "mean")))


def random_sales(seed=3, n=400):
    rng = random.Random(seed)
    start = date(2023, 12, 20)
    rows = []
    for _ in range(n):
        rows.append(
            (
                start + timedelta(days=rng.randrange(45)),
                rng.choice(["north", "south", "east"]),
                rng.choice(["a", "b"]),
                float(rng.randrange(0, 30)),
                round(rng.random() * 100, 2),
                round(rng.random() * 10, 3),
            )
        )
    return rows


class Brute:
    """Any cell of the feature table straight from the sales rows: no grid, no join, no running state."""

    def __init__(self, rows):
        self.rows = rows
        self.first, self.last = min(r[0] for r in rows), max(r[0] for r in rows)
        per_day = {}
        for d, c, i, _, _, rate in rows:
            per_day.setdefault((d, c, i), []).append(rate)
        self.mean_rate = statistics.fmean(statistics.fmean(v) for v in per_day.values())

    def sold(self, c, i, day):
        return sum(r[3] for r in self.rows if r[:3] == (day, c, i))

    def cell(self, name, c, i, day):
        if name == "y":
            return self.sold(c, i, day)
        if name == "amt":
            return sum(r[4] for r in self.rows if r[:3] == (day, c, i))
        if name == "rate":
            own = [r[5] for r in self.rows if r[:3] == (day, c, i)]
            return statistics.fmean(own) if own else self.mean_rate
        if name == "day_of_week":
            return day.weekday()
        if name == "week_of_year":
            return day.isocalendar()[1]
        if name == "is_month_end":
            return int((day + timedelta(days=1)).day == 1)
        if name == "day_of_year_sin":
            return math.sin(2 * math.pi * day.timetuple().tm_yday / 365.25)
        kind, *middle, n = name.split("_")
        if kind == "lag":
            back = day - timedelta(days=int(n))
            return self.sold(c, i, back) if back >= self.first else None
        window = [day - timedelta(days=k) for k in range(int(n)) if day - timedelta(days=k) >= self.first]
        seen = [self.sold(c, i, d) for d in window]
        if middle == ["std"]:
            return statistics.stdev(seen) if len(seen) > 1 else None
        return {"mean": statistics.fmean, "min": min, "max": max}[middle[0]](seen)


def test_every_cell_matches_brute_force(spark):
    rows = random_sales()
    fact = spark.createDataFrame(rows, "d date, c string, i string, y double, amt double, rate double")
    daily = dense.daily_aggregate(fact, SPEC).cache()
    got = features.build_features(dense.dense_panel(daily, SPEC), SPEC, FeatureConfig()).collect()
    want = Brute(rows)
    assert len(got) == ((want.last - want.first).days + 1) * 6
    assert len({(r["c"], r["i"], r["d"]) for r in got}) == len(got)
    names = ["y", "amt", "rate", "lag_1", "lag_3", "lag_7", "day_of_week", "week_of_year", "is_month_end", "day_of_year_sin"]
    names += [f"rolling_{s}_{w}" for w in (7, 14) for s in ("mean", "std", "min", "max")]
    for r in got:
        for name in names:
            expected = want.cell(name, r["c"], r["i"], r["d"])
            if expected is None:
                assert r[name] is None, (name, r)
            else:
                assert math.isclose(r[name], expected, rel_tol=1e-9, abs_tol=1e-9), (name, r)


def test_hot_series_is_combined_map_side(spark):
    rng = random.Random(11)
    day0 = date(2024, 1, 1)
    rows = [(day0 + timedelta(days=rng.randrange(10)), "hot", "x", 1.0, 1.0, 1.0) for _ in range(3000)]
    rows += [(day0 + timedelta(days=rng.randrange(10)), f"c{k % 50}", f"i{k % 7}", 2.0, 1.0, 1.0) for k in range(6000)]
    fact = spark.createDataFrame(rows, "d date, c string, i string, y double, amt double, rate double").repartition(8)
    daily = dense.daily_aggregate(fact, SPEC)
    plan = daily._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan  # combined before the shuffle
    hot = daily.filter("c = 'hot'").collect()
    assert len(hot) == 10 and sum(r["y"] for r in hot) == 3000.0
    panel = dense.dense_panel(daily.cache(), SPEC)
    assert panel.filter("c = 'hot' and i = 'x'").count() == 10  # a series never exceeds its days
    assert math.isclose(panel.agg({"y": "sum"}).first()[0], 3000.0 + 12000.0)
