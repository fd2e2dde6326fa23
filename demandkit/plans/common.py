"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

# Doubles are compared with the SQL oracle after rounding to this many
# decimals on both sides (summation order differs between engines).
DIGITS = 6


def round_half_away(x, digits: int = DIGITS):
    """round(x * 10^d) / 10^d with ties away from zero, in plain double
    arithmetic (the SQL oracle's ``round``), so both engines print the same
    value.  ``F.round`` rounds the decimal text instead, which differs on
    ties such as 2079.5628125."""
    m = float(10**digits)
    y = x * F.lit(m)
    t = F.abs(y)
    frac = t % F.lit(1.0)
    r = t - frac + F.when(frac >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))
    out = F.signum(y) * r / F.lit(m)
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), x).otherwise(out)


def round_half_away_sql(column: str, digits: int = DIGITS) -> str:
    """``round_half_away`` as SQL text (one JVM call for a whole projection)."""
    m = f"{float(10**digits)!r}D"
    x = f"CAST(`{column}` AS DOUBLE)"
    t = f"abs({x} * {m})"
    out = f"(signum({x} * {m}) * ({t} - ({t} % 1.0D) + CASE WHEN ({t} % 1.0D) >= 0.5D THEN 1.0D ELSE 0.0D END) / {m})"
    return f"CASE WHEN isnan({out}) OR abs({out}) = double('inf') THEN {x} ELSE {out} END AS `{column}`"


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every DOUBLE/FLOAT column (presentation only)."""
    exprs = [
        round_half_away_sql(f.name, digits) if isinstance(f.dataType, (DoubleType, FloatType)) else f"`{f.name}`"
        for f in df.schema.fields
    ]
    return df.selectExpr(*exprs)
