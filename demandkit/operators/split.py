"""Train / test splits of a panel.

``split_rows_tail`` reproduces a sequential split of rows stored in
(center, item, date) order: the last ceil(f N) rows are test.  On a dense
panel the row position is arithmetic - (pair rank x days) + day offset -
so only the pair list is ranked, never the whole table.
"""

from __future__ import annotations

import math
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandkit.operators.dense import INLINE_DIMENSION_LIMIT
from demandkit.operators.indexing import dense_index
from demandkit.spec import PanelSpec


def _c(name: str):
    return F.col(f"`{name}`")


def split_rows_tail(
    df: DataFrame, spec: PanelSpec = PanelSpec(), test_size: float = 0.2, keys: DataFrame | None = None, dense: bool = True
) -> DataFrame:
    """Add ``row_index`` and ``split`` ('train'/'test') in stored-row order.

    ``keys`` is a small table with the date, center and item columns that the
    panel was made from (the daily aggregate): with it the bounds and the pair
    list come from there, the caller vouches that the panel is dense over them,
    and the panel itself is evaluated once.  Without it one pass over ``df``
    checks that every pair has every day exactly once; otherwise, or with
    ``dense=False``, the rows get a distributed index."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must be in (0, 1)")
    date = _c(spec.date)
    source = df if keys is None else keys
    columns = [_c(spec.center), _c(spec.item)]
    pairs = source.groupBy(*columns).agg(
        F.min(date).alias("lo"), F.max(date).alias("hi"), F.count(F.lit(1)).alias("n"), F.count_distinct(date).alias("n_days")
    )
    # At most INLINE_DIMENSION_LIMIT rows come to the driver, the rest is summed where it is.
    listed = pairs.orderBy(*columns).limit(INLINE_DIMENSION_LIMIT + 1).collect() if dense else []
    few = 0 < len(listed) <= INLINE_DIMENSION_LIMIT
    if few:
        lo, hi = min(r["lo"] for r in listed), max(r["hi"] for r in listed)
        n_pairs, rows = len(listed), sum(r["n"] for r in listed)
        least = min(min(r["n"], r["n_days"]) for r in listed)
        most = max(r["n"] for r in listed)
    else:
        whole = pairs.agg(
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.count(F.lit(1)).alias("pairs"),
            F.sum("n").alias("rows"),
            F.min(F.least("n", "n_days")).alias("least"),
            F.max("n").alias("most"),
        ).first()
        lo, hi, n_pairs, rows, least, most = whole
    if not rows:
        return df.withColumn("row_index", F.lit(None).cast("long")).withColumn("split", F.lit(None).cast("string"))
    n_days = (hi - lo).days + 1
    if dense and (keys is not None or least == most == n_days):
        total = n_pairs * n_days
        if few:
            schema = df.select(*columns).schema.add("_pair", "long")
            names = [(r[spec.center], r[spec.item], i) for i, r in enumerate(listed)]
            ranked = F.broadcast(df.sparkSession.createDataFrame(names, schema))
        else:
            ranked = dense_index(pairs.select(*columns), [spec.center, spec.item], "_pair")
        offset = F.datediff(F.to_date(date), F.to_date(F.lit(str(lo)[:10])))
        out = df.join(ranked, [spec.center, spec.item]).withColumn(
            "row_index", F.col("_pair") * F.lit(n_days) + offset.cast("long")
        ).drop("_pair")
    else:
        total = rows if keys is None else df.count()
        out = dense_index(df, [spec.center, spec.item, spec.date], "row_index")
    n_test = math.ceil(test_size * total)
    return out.withColumn("split", F.when(F.col("row_index") >= total - n_test, "test").otherwise("train"))


def split_by_date(df: DataFrame, spec: PanelSpec = PanelSpec(), test_size: float = 0.2, keys: DataFrame | None = None) -> DataFrame:
    """Time-ordered split: the last ceil(f x days) calendar days are test.

    ``keys`` is a smaller table with the same first and last date."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must be in (0, 1)")
    date = _c(spec.date)
    bounds = (df if keys is None else keys).agg(F.min(date).alias("lo"), F.max(date).alias("hi")).first()
    if bounds["lo"] is None:
        return df.withColumn("split", F.lit(None).cast("string"))
    n_days = (bounds["hi"] - bounds["lo"]).days + 1
    cutoff = bounds["lo"] + timedelta(days=n_days - math.ceil(test_size * n_days))
    return df.withColumn("split", F.when(F.to_date(date) >= F.lit(cutoff), "test").otherwise("train"))


def fold_days(n_days: int, n_splits: int, gap: int = 0) -> list[tuple[int, int, int]]:
    """(fold, first test day, end of test days) as day offsets; training days are those ``gap`` days before the first.

    The tests are the last ``n_splits`` equal stretches of days (a remainder
    goes to the training days of all folds), so every window starts at day 0
    and grows by one stretch."""
    size = n_days // (n_splits + 1)
    if n_splits < 1 or size < 1 or n_days - n_splits * size - gap < 1:
        raise ValueError(f"{n_days} days are too few for {n_splits} folds with a gap of {gap}")
    start = n_days - n_splits * size
    return [(k + 1, start + k * size, start + (k + 1) * size) for k in range(n_splits)]


def expanding_folds(df: DataFrame, spec: PanelSpec = PanelSpec(), n_splits: int = 3, gap: int = 0, keys: DataFrame | None = None) -> DataFrame:
    """Rows with ``fold`` (1 .. n_splits) and ``role`` ('train' or 'test'), one per fold that uses the row.

    Windows expand over calendar days: no fold trains on a day at or after its
    test days.  One explode per row over its own memberships, no join and no
    second pass.  ``keys`` is a smaller table with the same first and last
    date."""
    date = _c(spec.date)
    bounds = (df if keys is None else keys).agg(F.min(date).alias("lo"), F.max(date).alias("hi")).first()
    if bounds["lo"] is None:
        return df.withColumn("fold", F.lit(None).cast("int")).withColumn("role", F.lit(None).cast("string"))
    day = F.datediff(F.to_date(date), F.to_date(F.lit(str(bounds["lo"])[:10])))

    def member(fold: int, start: int, end: int) -> Column:
        role = F.when(day < start - gap, "train").when((day >= start) & (day < end), "test")
        return F.when(role.isNotNull(), F.struct(F.lit(fold).alias("fold"), role.alias("role")))

    folds = fold_days((bounds["hi"] - bounds["lo"]).days + 1, n_splits, gap)
    members = F.array_compact(F.array(*[member(*f) for f in folds]))
    return df.select("*", F.explode(members).alias("_m")).select(*[_c(c) for c in df.columns], "_m.fold", "_m.role")
