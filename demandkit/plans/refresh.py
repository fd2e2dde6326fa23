"""Incremental feature refresh (B1, S3): load new sales, recompute only the days they can change.

A store has two Parquet tables under one folder:

* ``daily``: per load, day and series, what the daily aggregate needs to be put
  together again (sums, and sum and count of every mean), partitioned by month
  and load;
* ``features``: ``sparse_features`` of all observed days, partitioned by month.

A refresh writes its own load, then works out which months its days reach (a
feature looks back ``reach`` days, so a day changes itself and the ``reach`` days
after it), reads those months and the days before them, and overwrites just these
months of ``features``.  Files of other months are not touched.

Late rows (before the high-water mark) are no special case: the days they fall
on are put together from all loads again and the days after them recomputed.  A
row before the panel's first day moves that day, which changes the first
``reach`` days after the old one as well.  A refresh that failed half way is
simply run again under the same load name: it overwrites what it wrote.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType

from demandkit.operators.features import sparse_features
from demandkit.sources import files
from demandkit.spec import FeatureConfig, PanelSpec

PART = "part_month"  # the partition column: the month, as yyyy-MM


@dataclass(frozen=True)
class Refresh:
    """What a refresh did: the last day now held, and the months of features it wrote."""

    mark: date | None
    months: tuple[str, ...]


def _c(name: str):
    return F.col(f"`{name}`")


def reach_days(cfg: FeatureConfig) -> int:
    """How many days back the features of a day look."""
    return max([0, *cfg.lags, *(w if cfg.exclude_current else w - 1 for w in cfg.windows)])


def month_of(day: date) -> str:
    return f"{day.year:04d}-{day.month:02d}"


def months_between(first: date, last: date) -> list[str]:
    return [f"{n // 12:04d}-{n % 12 + 1:02d}" for n in range(first.year * 12 + first.month - 1, last.year * 12 + last.month)]


def _first_day(month: str) -> date:
    return date(int(month[:4]), int(month[5:]), 1)


def _part_names(spec: PanelSpec) -> list[str]:
    names = [spec.target]
    for name, how in spec.measures:
        names += [name] if how == "sum" else [f"{name}_sum", f"{name}_n"]
    return names


def _parts(sales: DataFrame, spec: PanelSpec) -> DataFrame:
    """Sums (and counts of means) per day and series: they add up over loads."""
    keyed = sales.filter(_c(spec.date).isNotNull() & _c(spec.center).isNotNull() & _c(spec.item).isNotNull())
    aggs = [F.sum(_c(spec.target).cast("double")).alias(spec.target)]
    for name, how in spec.measures:
        total = F.sum(_c(name).cast("double"))
        aggs += [total.alias(name)] if how == "sum" else [total.alias(f"{name}_sum"), F.count(_c(name)).alias(f"{name}_n")]
    day = F.to_date(_c(spec.date)).alias(spec.date)
    grouped = keyed.groupBy(_c(spec.center).cast("string").alias(spec.center), _c(spec.item).cast("string").alias(spec.item), day).agg(*aggs)
    return grouped.withColumn(PART, F.date_format(_c(spec.date), "yyyy-MM"))


def _part_schema(spec: PanelSpec) -> StructType:
    kinds = {n: LongType() if n.endswith("_n") and n not in spec.measure_names else DoubleType() for n in _part_names(spec)}
    keys = [StructField(spec.center, StringType()), StructField(spec.item, StringType()), StructField(spec.date, DateType())]
    # Said, not inferred: "2024-01" must stay text.
    return StructType([*keys, *(StructField(n, k) for n, k in kinds.items()), StructField(PART, StringType()), StructField("load", StringType())])


def _read_parts(spark: SparkSession, path: str, spec: PanelSpec) -> DataFrame:
    try:
        return spark.read.schema(_part_schema(spec)).parquet(f"{path}/daily")
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return spark.createDataFrame([], _part_schema(spec))
        raise


def read_daily(spark: SparkSession, path: str, spec: PanelSpec = PanelSpec(), months: list[str] | None = None) -> DataFrame:
    """The daily aggregate of all loads (of ``months`` only: the others' files are not opened)."""
    parts = _read_parts(spark, path, spec)
    if months is not None:
        parts = parts.filter(F.col(PART).isin(months))
    sums = parts.groupBy(*[_c(k) for k in (spec.center, spec.item, spec.date)]).agg(*[F.sum(_c(n)).alias(n) for n in _part_names(spec)])
    measures = [_c(n) if how == "sum" else F.try_divide(_c(f"{n}_sum"), _c(f"{n}_n")).alias(n) for n, how in spec.measures]
    return sums.select(*[_c(k) for k in spec.grain], _c(spec.target), *measures)


def _bounds(parts: DataFrame, spec: PanelSpec) -> tuple[date | None, date | None]:
    """First and last day held; only the files of the first and last month are read for it."""
    ends = parts.agg(F.min(PART).alias("lo"), F.max(PART).alias("hi")).first()
    if ends["lo"] is None:
        return None, None
    days = parts.filter(F.col(PART).isin(ends["lo"], ends["hi"])).agg(F.min(_c(spec.date)), F.max(_c(spec.date))).first()
    return days[0], days[1]


def _overwrite(df: DataFrame, path: str, partitions: list[str], spec: PanelSpec) -> None:
    """Replace the partitions that ``df`` has rows for, and no others."""
    # AQE splits large partitions of the shuffle and joins small ones: no hot month, few files.
    laid_out = df.hint("rebalance", *partitions).sortWithinPartitions(*partitions, _c(spec.center), _c(spec.item), _c(spec.date))
    files.write_partitions(laid_out, path, partitions, lookup=[spec.center, spec.item])


def refresh_features(
    sales: DataFrame, path: str, load: str, spec: PanelSpec = PanelSpec(), cfg: FeatureConfig = FeatureConfig()
) -> Refresh:
    """Add cleaned ``sales`` to the store at ``path`` as ``load`` and bring its features up to date.

    The same load name again, with the same rows, changes nothing.  Rows without
    a date, center or item are left out, as in the daily aggregate.  No rows
    leave the store as it is.
    """
    spark, path = sales.sparkSession, path.rstrip("/")
    # From the other loads alone, so that a refresh run again sees what it saw the first time.
    old_first, _ = _bounds(_read_parts(spark, path, spec).filter(F.col("load") != load), spec)
    _overwrite(_parts(sales, spec).withColumn("load", F.lit(load)), f"{path}/daily", [PART, "load"], spec)
    parts = _read_parts(spark, path, spec)
    first, last = _bounds(parts, spec)
    # One row a month: bounded by the calendar.
    loaded = parts.filter(F.col("load") == load).groupBy(PART).agg(F.min(_c(spec.date)).alias("lo"), F.max(_c(spec.date)).alias("hi")).collect()
    if not loaded:
        return Refresh(last, ())
    reach = timedelta(days=reach_days(cfg))
    spans = [(r["lo"], r["hi"]) for r in loaded]
    if old_first is not None and first < old_first:
        spans.append((old_first, old_first))
    changed = sorted({m for lo, hi in spans for m in months_between(lo, min(hi + reach, last))})
    needed = sorted({m for month in changed for m in months_between(_first_day(month) - reach, _first_day(month))})
    daily = read_daily(spark, path, spec, needed)
    table = sparse_features(daily, spec, cfg, start=str(first)).withColumn(PART, F.date_format(_c(spec.date), "yyyy-MM"))
    _overwrite(table.filter(F.col(PART).isin(changed)), f"{path}/features", [PART], spec)
    return Refresh(last, tuple(changed))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The feature table without its partition column."""
    return files.read_parquet(spark, f"{path.rstrip('/')}/features").drop(PART)
