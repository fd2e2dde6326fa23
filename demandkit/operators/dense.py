"""Daily aggregate and the dense day x center x item panel.

Physical layout (the point of this module):

* the daily aggregate is a partial + final hash aggregate, so a hot series
  is reduced map-side before any shuffle;
* the grid is generated per (center, item) pair: only the pair list is
  shuffled (hash on center, item); the days are exploded locally, so the
  grid inherits that partitioning and is never shuffled itself;
* the observed aggregate is hash-partitioned the same way, so the left
  join on (date, center, item) and the feature window on (center, item)
  reuse one layout (with ``requireAllClusterKeysForCoPartition=false``).

No cross join: center names get a distributed dense index; each item row
explodes the index range and an equi-join maps indexes back to names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandkit.operators.indexing import dense_index
from demandkit.session import default_parallelism
from demandkit.spec import PanelSpec

# Grid rows per partition.  The grid's partitioning is kept through the
# panel join, the sort and the feature window (no Exchange in between), where
# rows widen to ~40 columns, so this sizes those tasks too: 1M rows is about
# 100 MB of panel rows per sort.
ROWS_PER_PARTITION = 1_000_000


def _c(name: str):
    return F.col(f"`{name}`")


def daily_aggregate(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """A1: sum(target) and each measure by its rule per (date, center, item).

    Rows with a NULL date, center or item form no group (as in a default
    pandas ``groupby``); cleaning normally replaced such labels already."""
    aggs = [F.sum(_c(spec.target)).alias(spec.target)]
    for name, how in spec.measures:
        if how == "sum":
            aggs.append(F.sum(_c(name)).alias(name))
        elif how == "mean":
            aggs.append(F.avg(_c(name)).alias(name))
        else:
            raise ValueError(f"unknown measure aggregation {how!r} for {name}")
    keyed = df.filter(_c(spec.date).isNotNull() & _c(spec.center).isNotNull() & _c(spec.item).isNotNull())
    # Grouped (and so hash-shuffled) on all three keys, so a hot series still
    # spreads over its days; the key order (center, item, date) is what the
    # panel join and the per-series window sort on.
    out = keyed.groupBy(_c(spec.center), _c(spec.item), _c(spec.date)).agg(*aggs)
    return out.select(*[_c(k) for k in spec.grain], _c(spec.target), *[_c(m) for m in spec.measure_names])


def date_bounds(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """A2: one row (min_date, max_date)."""
    return df.agg(F.min(_c(spec.date)).alias("min_date"), F.max(_c(spec.date)).alias("max_date"))


# Dimension lists up to this many values are inlined into the plan as a
# literal array (checked with an exact count first); longer lists take the
# distributed index path.
INLINE_DIMENSION_LIMIT = 10_000


def series_pairs(daily: DataFrame, spec: PanelSpec, observed_only: bool = False) -> DataFrame:
    """(center, item) pairs of the grid: every center x every item, or only
    pairs with at least one observation.

    Each distinct item row explodes the center list.  The list is inlined
    when an exact check (``distinct().limit(N + 1)``) finds at most
    ``INLINE_DIMENSION_LIMIT`` centers; otherwise the centers get a
    distributed dense index and an equi-join maps indexes back to names."""
    center, item = spec.center, spec.item
    if observed_only:
        return daily.select(_c(center), _c(item)).distinct()
    items = daily.select(_c(item)).distinct()
    distinct_centers = daily.select(_c(center)).distinct()
    names = [r[0] for r in distinct_centers.limit(INLINE_DIMENSION_LIMIT + 1).collect()]
    if len(names) <= INLINE_DIMENSION_LIMIT:
        if not names:
            return items.select(F.lit(None).cast("string").alias(center), _c(item)).limit(0)
        listed = F.array(*[F.lit(n) for n in sorted(names)])
        return items.select(F.explode(listed).alias(center), _c(item))
    centers = dense_index(distinct_centers, [center], "_c")
    last = F.lit(centers.count() - 1).cast("long")
    spread = items.select(_c(item), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_c"))
    return spread.join(centers, "_c").select(_c(center), _c(item))


def dense_panel(
    daily: DataFrame,
    spec: PanelSpec = PanelSpec(),
    observed_only: bool = False,
    num_partitions: int | None = None,
) -> DataFrame:
    """Every day between the first and last date x every center x
    every item, left-joined to the daily aggregate.  Missing target and sum
    measures are 0; mean measures get the mean of observed daily values.

    ``daily`` should be persisted by the caller: it is read for the bounds,
    the dimension lists and the join.
    """
    date, center, item = spec.grain
    mean_measures = [n for n, how in spec.measures if how == "mean"]
    sum_measures = [n for n, how in spec.measures if how == "sum"]
    # Distinct counts only size the partitions, so HyperLogLog estimates
    # (one pass, no Expand) are enough here.
    scal = daily.agg(
        F.min(_c(date)).alias("lo"),
        F.max(_c(date)).alias("hi"),
        F.approx_count_distinct(_c(center)).alias("n_centers"),
        F.approx_count_distinct(_c(item)).alias("n_items"),
        F.approx_count_distinct(F.struct(_c(center), _c(item))).alias("n_observed"),
        *[F.avg(_c(m)).alias(f"m{i}") for i, m in enumerate(mean_measures)],
    ).first()
    pairs = series_pairs(daily, spec, observed_only)
    if scal["lo"] is None:
        grid = pairs.select(F.lit(None).cast(daily.schema[date].dataType).alias(date), _c(center), _c(item)).limit(0)
        n = num_partitions or default_parallelism(daily.sparkSession)
    else:
        n_days = (scal["hi"] - scal["lo"]).days + 1
        if num_partitions is None:
            n_pairs = scal["n_observed"] if observed_only else scal["n_centers"] * scal["n_items"]
            n = max(default_parallelism(daily.sparkSession), math.ceil(n_pairs * n_days / ROWS_PER_PARTITION))
        else:
            n = num_partitions
        # Bounds go back as text cast to the column's own type (DATE or
        # TIMESTAMP_NTZ), so the grid's join key type matches exactly.
        dtype = daily.schema[date].dataType
        lo, hi = (F.lit(str(scal[k])).cast(dtype) for k in ("lo", "hi"))
        days = F.sequence(lo, hi, F.expr("INTERVAL 1 DAY"))
        grid = pairs.repartition(n, _c(center), _c(item)).select(F.explode(days).alias(date), _c(center), _c(item))
    # No explicit shuffle of the observed side: the planner re-partitions it
    # to the grid's hash(center, item) for a sort-merge join, or broadcasts it.
    # Keys go in (center, item, date) order, so the sort-merge join's sort is
    # the one the per-series feature window needs (no second sort).
    joined = grid.join(daily, [center, item, date], "left")
    fills = {spec.target: F.coalesce(_c(spec.target), F.lit(0.0))}
    for m in sum_measures:
        fills[m] = F.coalesce(_c(m), F.lit(0.0))
    for i, m in enumerate(mean_measures):
        fills[m] = F.coalesce(_c(m), F.lit(scal[f"m{i}"]).cast("double"))
    return joined.withColumns(fills).select(
        _c(date), _c(center), _c(item), _c(spec.target), *[_c(m) for m in spec.measure_names]
    )
