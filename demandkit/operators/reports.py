"""Reporting aggregates over a sales fact or a panel.

All are single aggregations (partial + final hash aggregate); sorted
outputs are small (one row per dimension value) and top-k uses
``orderBy().limit()`` which Spark plans as a per-partition top-k merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandkit.functions.calendar import day_of_week, month_label, month_start, weekday_name
from demandkit.functions.cleaning import coerce_double, parse_timestamp
from demandkit.spec import PanelSpec, detect_roles, feature_columns

# Spark's own limit on pivot values; pivoting on more is refused.
MAX_PIVOT_VALUES = 10_000


def _c(name: str):
    return F.col(f"`{name}`")


def centers(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """A3: sorted distinct non-blank centers."""
    c = _c(spec.center)
    return (
        df.select(c.alias("center"))
        .filter(F.col("center").isNotNull() & (F.trim("center") != ""))
        .distinct()
        .orderBy("center")
    )


def items_by_center(df: DataFrame, spec: PanelSpec = PanelSpec(), center: str | None = None) -> DataFrame:
    """A3: sorted distinct (center, item); restricted to one center if given."""
    if center is not None:
        df = df.filter(_c(spec.center) == F.lit(center))
    i = _c(spec.item)
    return (
        df.select(_c(spec.center).alias("center"), i.alias("item"))
        .filter(F.col("item").isNotNull() & (F.trim("item") != ""))
        .distinct()
        .orderBy("center", "item")
    )


def count_distinct_keys(df: DataFrame, spec: PanelSpec = PanelSpec(), approximate: bool = False) -> DataFrame:
    """A4: number of distinct centers and items (exact or HyperLogLog++)."""
    fn = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(fn(_c(spec.center)).alias("n_centers"), fn(_c(spec.item)).alias("n_items"))


def summary(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """A5 (+A2, A4): one-row summary of a panel / feature table."""
    y = _c(spec.target)
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.min(_c(spec.date)).alias("min_date"),
        F.max(_c(spec.date)).alias("max_date"),
        F.count_distinct(_c(spec.center)).alias("n_centers"),
        F.count_distinct(_c(spec.item)).alias("n_items"),
        F.sum(y).alias("total_demand"),
        F.avg(y).alias("avg_demand"),
    ).withColumn("n_features", F.lit(len(feature_columns(df.columns, spec))))


def demand_by(df: DataFrame, key: str, spec: PanelSpec = PanelSpec(), alias: str | None = None) -> DataFrame:
    """Total target by ``key``, largest first (ties by name)."""
    name = alias or key
    out = (
        df.filter(_c(key).isNotNull())
        .groupBy(_c(key).alias(name))
        .agg(F.sum(_c(spec.target)).alias("total_demand"))
    )
    return out.orderBy(F.desc("total_demand"), F.asc(name))


def top_k(df: DataFrame, key: str, k: int = 5, spec: PanelSpec = PanelSpec(), alias: str | None = None) -> DataFrame:
    """The ``k`` keys with the largest total target (ties by name)."""
    return demand_by(df, key, spec, alias).limit(k)


def weekday_mean(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Mean target per weekday, Monday first; days without rows absent."""
    d = _c(spec.date)
    return (
        df.filter(d.isNotNull())
        .groupBy(day_of_week(d).alias("day_of_week"), weekday_name(d).alias("weekday"))
        .agg(F.avg(_c(spec.target)).alias("mean_demand"))
        .orderBy("day_of_week")
    )


def monthly_total(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Total target per calendar month, labelled ``yyyy-MM``."""
    d = _c(spec.date)
    return (
        df.filter(d.isNotNull())
        .groupBy(month_label(d).alias("month"))
        .agg(F.sum(_c(spec.target)).alias("total_demand"))
        .orderBy("month")
    )


def monthly_by_series(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """A10: total target per (center, item, month start)."""
    d = _c(spec.date)
    return (
        df.filter(d.isNotNull() & _c(spec.center).isNotNull() & _c(spec.item).isNotNull())
        .groupBy(_c(spec.center).alias("center"), _c(spec.item).alias("item"), month_start(d).alias("month"))
        .agg(F.sum(_c(spec.target)).alias("demand"))
    )


def pivot_values(df: DataFrame, column: str, limit: int = MAX_PIVOT_VALUES) -> list:
    """Sorted distinct values of a dimension column (checked size bound)."""
    vals = df.select(_c(column)).filter(_c(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(vals) > limit:
        raise ValueError(
            f"{column} has more than {limit} distinct values; use center_item_totals (long form) instead"
        )
    return sorted(r[0] for r in vals)


def center_item_pivot(
    df: DataFrame, spec: PanelSpec = PanelSpec(), items: list | None = None, max_items: int = MAX_PIVOT_VALUES
) -> DataFrame:
    """A11 in wide form: one row per center, one column per item (sum of target), 0 if absent.

    For lists that are known to be short; ``max_items`` is the most columns that
    are made (more raise).  ``center_item_totals`` has the same totals for any
    number of items.  An item called like the center column gets its column
    under ``item:<name>``."""
    values = items if items is not None else pivot_values(df, spec.item, max_items)
    names = {v: f"item:{v}" if str(v) == "center" else str(v) for v in values}
    amounts = [F.sum(F.when(_c(spec.item) == F.lit(v), _c(spec.target))) for v in values]
    return df.groupBy(_c(spec.center).alias("center")).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.coalesce(a, F.lit(0.0)).alias(names[v]) for a, v in zip(amounts, values)]
    ).drop("_rows")


def center_item_totals(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """A11 in long form: (center, item, total_demand) for any number of items."""
    return df.groupBy(_c(spec.center).alias("center"), _c(spec.item).alias("item")).agg(
        F.sum(_c(spec.target)).alias("total_demand")
    )


def center_item_map(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """A11 with the items as a map: (center, n_items, totals MAP<item, total>) for any number of items.

    The totals are summed per pair first, so a center's map is gathered from one
    row per item; no list of items goes through the driver and the plan does not
    grow with it.  An absent item has no key; rows without an item are left out."""
    totals = center_item_totals(df.filter(_c(spec.item).isNotNull()), spec)
    entries = F.array_sort(F.collect_list(F.struct("item", F.coalesce("total_demand", F.lit(0.0)).alias("total_demand"))))
    return totals.groupBy("center").agg(F.count(F.lit(1)).alias("n_items"), F.map_from_entries(entries).alias("totals"))


def forecast_summary(forecast: DataFrame, with_confidence: bool = False) -> DataFrame:
    """Mean / max / min forecast (and mean confidence) per series."""
    aggs = [
        F.avg("forecast").alias("mean_forecast"),
        F.max("forecast").alias("max_forecast"),
        F.min("forecast").alias("min_forecast"),
    ]
    if with_confidence and "confidence" in forecast.columns:
        aggs.append(F.avg("confidence").alias("mean_confidence"))
    return forecast.groupBy("center", "item").agg(*aggs)


def _count_distinct_with_null(c):
    return F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))


def profile(df: DataFrame, day_first: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Profile of an arbitrary table via keyword role detection.

    Returns ``(summary, distinct_values)``: a one-row summary (records,
    columns, detected roles, date range, distinct centers / products incl.
    NULL, total demand, notes) and a ``(role, value)`` table of the distinct
    center and product values (kept apart: it can be large).
    """
    roles = detect_roles(df.columns)
    aggs = [F.count(F.lit(1)).alias("total_records")]
    if roles["date"]:
        ts = parse_timestamp(_c(roles["date"]), day_first)
        aggs += [F.to_date(F.min(ts)).alias("date_start"), F.to_date(F.max(ts)).alias("date_end")]
    else:
        aggs += [F.lit(None).cast("date").alias("date_start"), F.lit(None).cast("date").alias("date_end")]
    for role, name in (("center", "n_centers"), ("item", "n_products")):
        col = roles[role]
        aggs.append(_count_distinct_with_null(_c(col)).alias(name) if col else F.lit(0).cast("long").alias(name))
    if roles["target"]:
        field = df.schema[roles["target"]].dataType
        aggs.append(F.sum(coerce_double(_c(roles["target"]), field)).alias("total_demand"))
    else:
        aggs.append(F.lit(0.0).alias("total_demand"))
    out = df.agg(*aggs).select(
        "*",
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.create_map(*[x for r, c in roles.items() for x in (F.lit(r), F.lit(c))]).alias("roles"),
    )
    def found(column: str, what: str):
        return F.when(F.col(column) > 0, F.format_string(f"{what}: %d", F.col(column))).otherwise(F.lit(f"{what}: none"))

    notes = F.array(
        F.format_string("rows read: %d", F.col("total_records")), found("n_centers", "locations"), found("n_products", "products")
    )
    out = out.withColumn("notes", notes)
    parts = [
        df.select(F.lit(role).alias("role"), _c(roles[role]).cast("string").alias("value")).distinct()
        for role in ("center", "item")
        if roles[role]
    ]
    distinct_values = None
    for p in parts:
        distinct_values = p if distinct_values is None else distinct_values.unionByName(p)
    return out, distinct_values


# log2 of a sketch's buckets: a standard error of 1.04 / sqrt(2 ** k), 1.6 % here, in 4 KB at most.
SKETCH_BITS = 12


def profile_parts(df: DataFrame, by: str | Column | None = None, day_first: bool = False, bits: int = SKETCH_BITS) -> DataFrame:
    """A20 in parts that add up: one row per ``by`` (a day, a file, a load), or one for all of ``df``.

    Records, date range, total demand, and HyperLogLog sketches of centers and
    products (with a flag for NULL, which the profile counts as a value).  Store
    the parts; new data only needs its own, and ``merge_profile`` puts any of
    them together."""
    roles = detect_roles(df.columns)
    ts = F.to_date(parse_timestamp(_c(roles["date"]), day_first)) if roles["date"] else F.lit(None).cast("date")
    demand = coerce_double(_c(roles["target"]), df.schema[roles["target"]].dataType) if roles["target"] else F.lit(0.0)
    key = F.lit(None).cast("string") if by is None else (_c(by) if isinstance(by, str) else by)
    center, item = (_c(roles[r]).cast("string") if roles[r] else F.lit(None).cast("string") for r in ("center", "item"))
    rows = df.select(key.alias("part"), ts.alias("day"), demand.alias("demand"), center.alias("center"), item.alias("item"))
    aggs = [
        F.count(F.lit(1)).alias("records"),
        F.min("day").alias("date_start"),
        F.max("day").alias("date_end"),
        F.sum("demand").alias("demand"),
    ]
    for role in ("center", "item"):
        aggs.append(F.hll_sketch_agg(role, F.lit(bits)).alias(f"{role}s"))
        aggs.append(F.max(F.col(role).isNull() if roles[role] else F.lit(False)).alias(f"{role}_null"))
    return rows.groupBy("part").agg(*aggs)


def merge_profile(parts: DataFrame) -> DataFrame:
    """The approximate profile of everything that ``parts`` cover: sketches are united, no rows are read again."""

    def distinct(role: str) -> Column:
        return F.hll_sketch_estimate(F.hll_union_agg(f"{role}s")) + F.max(F.when(F.col(f"{role}_null"), 1).otherwise(0))

    return parts.agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("total_records"),
        F.min("date_start").alias("date_start"),
        F.max("date_end").alias("date_end"),
        F.coalesce(distinct("center"), F.lit(0)).alias("n_centers"),
        F.coalesce(distinct("item"), F.lit(0)).alias("n_products"),
        F.coalesce(F.sum("demand"), F.lit(0.0)).alias("total_demand"),
    )


def preview(df: DataFrame, order_by, n: int = 200) -> DataFrame:
    """First ``n`` rows in a given order (top-n, not a full sort)."""
    return df.orderBy(*order_by).limit(n)
