"""Keyword rules shared by the rule-based forecast and the synthetic panel."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rule forecast by item keyword (upper-cased substring match,
# first rule wins): keyword, base level, sine amplitude, sine frequency per step.
FORECAST_RULES = (
    ("CHILAPI", 1500.0, 300.0, 0.2),
    ("MIX FISH", 2000.0, 400.0, 0.15),
    ("PRAWN", 800.0, 200.0, 0.25),
    ("MUNDI", 600.0, 150.0, 0.3),
)
FORECAST_DEFAULT = (1000.0, 200.0, 0.1)
WEEKEND_FACTOR = 1.2
SUMMER_MONTHS = (3, 6)
SUMMER_FACTOR = 1.3
FORECAST_FLOOR = 100.0
RULE_LOWER, RULE_UPPER = 0.85, 1.15
CONFIDENCE_RANGE = (0.70, 0.95)

# Synthetic panel (centers, items, base level by keyword).
SAMPLE_CENTERS = ("KASARA", "TALOJA", "ALIBAG", "UTTAN", "VASAI")
SAMPLE_ITEMS = ("CHILAPI", "MIX FISH", "PRAWN HEAD AND SHEL", "MUNDI", "BOMBIL")
SAMPLE_BASE = (("CHILAPI", 1500.0), ("MIX FISH", 2000.0), ("PRAWN", 800.0), ("MUNDI", 600.0))
SAMPLE_BASE_DEFAULT = 1000.0
SAMPLE_START, SAMPLE_END = "2023-01-01", "2024-01-01"
SAMPLE_SEASONAL_AMPLITUDE = 0.3
SAMPLE_FLOOR = 100

# Monthly projection shape.
PROJECTION_SEASONAL_AMPLITUDE = 0.12
PROJECTION_TREND = 0.015
PROJECTION_LOWER, PROJECTION_UPPER = 0.9, 1.1


def keyword_case(item: Column, rules, default) -> Column:
    """CASE chain over ``contains(item, keyword)``; order matters."""
    default = default if isinstance(default, Column) else F.lit(default)
    expr = None
    for keyword, value in rules:
        cond = item.contains(keyword)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return default if expr is None else expr.otherwise(default)


def rule_level(item: Column, step: Column, rules=FORECAST_RULES, default=FORECAST_DEFAULT) -> Column:
    """base + amplitude * sin(step * frequency) by upper-cased item keyword (first rule that matches)."""
    upper = F.upper(item)
    base, amp, freq = (
        keyword_case(upper, [(rule[0], F.lit(float(rule[1 + k]))) for rule in rules], F.lit(float(default[k]))) for k in range(3)
    )
    return base + amp * F.sin(step.cast("double") * freq)


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) decided by ``keys`` alone: the first 52 bits of their md5.

    Unlike ``rand(seed)`` it does not depend on where a row lies, so a task that
    is run again, or another partitioning, draws the same numbers.
    """
    digits = F.substring(F.md5(F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def normal(*keys: Column) -> Column:
    """A standard normal number decided by ``keys`` (Box-Muller over two ``uniform`` draws)."""
    radius = F.sqrt(-2.0 * F.log(uniform(*keys, F.lit("radius"))))
    return radius * F.cos(2 * math.pi * uniform(*keys, F.lit("angle")))


def sample_base(item: Column) -> Column:
    return keyword_case(item, [(k, F.lit(b)) for k, b in SAMPLE_BASE], F.lit(SAMPLE_BASE_DEFAULT))


def annual_wave(day_of_year: Column, amplitude: float = SAMPLE_SEASONAL_AMPLITUDE) -> Column:
    return 1 + F.lit(amplitude) * F.sin(F.lit(2 * math.pi) * day_of_year / F.lit(365.0))
