"""Calendar and cyclical feature expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Periods of the cyclical encodings.
MONTH_PERIOD = 12.0
WEEK_PERIOD = 7.0
YEAR_PERIOD = 365.25

DATE_FEATURES = (
    "year",
    "month",
    "day",
    "day_of_week",
    "day_of_year",
    "week_of_year",
    "is_weekend",
    "is_month_start",
    "is_month_end",
    "quarter",
)
SEASONAL_FEATURES = (
    "month_sin",
    "month_cos",
    "week_sin",
    "week_cos",
    "day_of_year_sin",
    "day_of_year_cos",
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_of_week(d) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_col(d))


def date_feature_columns(d) -> list[Column]:
    """Ten INT calendar columns in their canonical order."""
    d = _col(d)
    dow = day_of_week(d)
    return [
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("day"),
        dow.alias("day_of_week"),
        F.dayofyear(d).alias("day_of_year"),
        F.weekofyear(d).alias("week_of_year"),
        (dow >= 5).cast("int").alias("is_weekend"),
        (F.dayofmonth(d) == 1).cast("int").alias("is_month_start"),
        (F.to_date(d) == F.last_day(d)).cast("int").alias("is_month_end"),
        F.quarter(d).alias("quarter"),
    ]


def cyclical(value: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2.0 * math.pi) * value / F.lit(period)
    return F.sin(angle), F.cos(angle)


def seasonal_feature_columns(d) -> list[Column]:
    """sin/cos of month/12, weekday/7 and day-of-year/365.25."""
    d = _col(d)
    month_sin, month_cos = cyclical(F.month(d), MONTH_PERIOD)
    week_sin, week_cos = cyclical(day_of_week(d), WEEK_PERIOD)
    doy_sin, doy_cos = cyclical(F.dayofyear(d), YEAR_PERIOD)
    return [
        month_sin.alias("month_sin"),
        month_cos.alias("month_cos"),
        week_sin.alias("week_sin"),
        week_cos.alias("week_cos"),
        doy_sin.alias("day_of_year_sin"),
        doy_cos.alias("day_of_year_cos"),
    ]


def weekday_name(d) -> Column:
    return F.date_format(_col(d), "EEEE")


def month_start(d) -> Column:
    return F.trunc(_col(d), "month")


def month_label(d) -> Column:
    return F.date_format(_col(d), "yyyy-MM")
