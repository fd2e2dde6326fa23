"""Cleaning, role mapping and row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandkit.functions.cleaning import coerce_double, fill_unknown, parse_date, parse_timestamp
from demandkit.operators.indexing import dense_index
from demandkit.spec import (
    ALL_LOCATIONS,
    ALL_PRODUCTS,
    CATEGORICAL_COLUMNS,
    NUMERIC_COLUMNS,
    UNKNOWN,
    PanelSpec,
    detect_roles,
    feature_columns,
    require_columns,
)


def parse_dates(df: DataFrame, date_col: str, day_first: bool = False, keep_time: bool = False) -> DataFrame:
    """Parse ``date_col``, drop rows that fail (``date_rejects`` has them).

    By default the time of day is dropped (DATE); ``keep_time=True`` keeps a
    TIMESTAMP_NTZ, as the original pipeline did.
    """
    col = F.col(f"`{date_col}`")
    parsed = parse_timestamp(col, day_first) if keep_time else parse_date(col, day_first)
    return df.withColumn(date_col, parsed).filter(col.isNotNull())


def date_rejects(df: DataFrame, date_col: str, day_first: bool = False) -> DataFrame:
    """The rows that ``parse_dates`` drops, as they came, with ``reject_reason``
    ('missing date' or 'unreadable date')."""
    col = F.col(f"`{date_col}`")
    blank = col.isNull() | (F.trim(col.cast("string")) == "")
    reason = F.when(blank, "missing date").otherwise("unreadable date")
    return df.filter(parse_timestamp(col, day_first).isNull()).withColumn("reject_reason", reason)


def coerce_numeric(df: DataFrame, columns=NUMERIC_COLUMNS, fill: float = 0.0) -> DataFrame:
    """Numeric coercion (NULL / NaN / unparsable -> ``fill``) for the
    listed columns that are present, in one projection."""
    types = dict(df.dtypes)
    fields = {f.name: f.dataType for f in df.schema.fields}
    present = [c for c in columns if c in types]
    return df.withColumns({c: coerce_double(F.col(f"`{c}`"), fields[c], fill) for c in present})


def fill_categorical(df: DataFrame, columns=CATEGORICAL_COLUMNS, value: str = UNKNOWN) -> DataFrame:
    """NULL -> 'Unknown' for the listed columns that are present."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: fill_unknown(F.col(f"`{c}`"), value) for c in present})


def clean_sales(
    df: DataFrame,
    spec: PanelSpec = PanelSpec(),
    numeric=NUMERIC_COLUMNS,
    categorical=CATEGORICAL_COLUMNS,
    day_first: bool = False,
    keep_time: bool = False,
) -> DataFrame:
    """P1-P3 as one narrow stage: parse dates, coerce numbers, fill labels.

    Rows without a readable date are dropped; ``date_rejects`` returns them."""
    out = parse_dates(df, spec.date, day_first, keep_time)
    out = coerce_numeric(out, numeric)
    return fill_categorical(out, categorical)


def check_required(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Raise ``KeyError`` listing absent required columns (no data read)."""
    require_columns(df.columns, spec.required)
    return df


def map_roles(
    df: DataFrame,
    as_of: str | None = None,
    order_by: list[str] | None = None,
) -> tuple[DataFrame, PanelSpec] | tuple[None, None]:
    """P5 + P6: find date/center/item/demand columns by keyword and
    synthesize missing roles.

    Returns ``(frame, spec)`` where frame has exactly the four role columns,
    or ``(None, None)`` when no demand column exists.  Without a date column,
    consecutive days ending the day before ``as_of`` are assigned in
    ``order_by`` order (a distributed index, no single-task numbering).
    """
    roles = detect_roles(df.columns)
    if roles["target"] is None:
        return None, None
    cols: dict[str, Column] = {}
    if roles["date"] is None:
        if as_of is None or not order_by:
            raise ValueError("a table without a date column needs as_of and order_by")
        # Only the columns that are read again go through the sort and the checkpoint.
        read = dict.fromkeys([*(c for c in (roles["center"], roles["item"], roles["target"]) if c), *order_by])
        indexed = dense_index(df.select(*[F.col(f"`{c}`") for c in read]), order_by, "_row")
        total = indexed.count()
        cols["date"] = F.date_add(F.date_sub(F.to_date(F.lit(as_of)), total), F.col("_row").cast("int"))
        df = indexed
    else:
        cols["date"] = parse_date(F.col(f"`{roles['date']}`"))
    cols["center"] = F.col(f"`{roles['center']}`").cast("string") if roles["center"] else F.lit(ALL_LOCATIONS)
    cols["item"] = F.col(f"`{roles['item']}`").cast("string") if roles["item"] else F.lit(ALL_PRODUCTS)
    cols["demand"] = F.col(f"`{roles['target']}`")
    out = df.select(*[c.alias(n) for n, c in cols.items()]).filter(F.col("date").isNotNull())
    spec = PanelSpec(date="date", center="center", item="item", target="demand", measures=())
    return out, spec


def fill_features(df: DataFrame, spec: PanelSpec, value: float = 0.0) -> DataFrame:
    """NULL features -> 0 (lags and stds of a series' first rows)."""
    return df.fillna(value, subset=feature_columns(df.columns, spec))


def drop_null_target(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """P8."""
    return df.dropna(subset=[spec.target])


def select_series(df: DataFrame, spec: PanelSpec, center: str | None = None, item: str | None = None) -> DataFrame:
    """equality filter on center and/or item (pushed to the scan)."""
    if center is not None:
        df = df.filter(F.col(f"`{spec.center}`") == F.lit(center))
    if item is not None:
        df = df.filter(F.col(f"`{spec.item}`") == F.lit(item))
    return df


def history(
    df: DataFrame,
    spec: PanelSpec,
    start: str,
    end: str,
    center: str | None = None,
    item: str | None = None,
    amount: str | None = "AMOUNT",
    rate: str | None = "RATE",
) -> DataFrame:
    """F2 + P10: rows of [start, end] as (center, item, date, demand, amount,
    rate); absent measures are 0.  Both days count whole: a timestamp later on
    the end day is inside (the original stopped at that day's midnight)."""
    d = F.col(f"`{spec.date}`")
    out = select_series(df, spec, center, item).filter(
        (F.to_date(d) >= F.to_date(F.lit(start))) & (F.to_date(d) <= F.to_date(F.lit(end)))
    )

    def measure(name):
        return F.col(f"`{name}`").cast("double") if name and name in df.columns else F.lit(0.0)

    return out.select(
        F.col(f"`{spec.center}`").alias("center"),
        F.col(f"`{spec.item}`").alias("item"),
        F.to_date(d).alias("date"),
        F.col(f"`{spec.target}`").cast("double").alias("demand"),
        measure(amount).alias("amount"),
        measure(rate).alias("rate"),
    )


def non_blank(df: DataFrame, column: str) -> DataFrame:
    """drop NULL and whitespace-only labels."""
    c = F.col(f"`{column}`")
    return df.filter(c.isNotNull() & (F.trim(c.cast("string")) != ""))
