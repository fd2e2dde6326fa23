"""Statistical expressions: sample moments, KS p-value, drift severity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity cut-offs on the KS p-value.
HIGH_P = 0.01
MEDIUM_P = 0.05
# Terms of the Kolmogorov limit series and the lambda below which Q = 1.
KS_SERIES_TERMS = 100
KS_SMALL_LAMBDA = 0.2
# Fixed value: samples of up to this many values get the exact KS p-value.
KS_EXACT_MAX = 10_000
KS_METHODS = ("auto", "exact", "asymptotic")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sample_skewness(c) -> Column:
    """Bias-corrected skewness G1 (pandas ``skew``) as an aggregate.

    Spark's ``skewness`` is the population g1; G1 = g1*sqrt(n(n-1))/(n-2).
    NULL for n < 3, 0 for a constant column.
    """
    x = _col(c)
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    return (
        F.when(n < 3, F.lit(None).cast("double"))
        .when(F.var_pop(x) == 0, F.lit(0.0))
        .otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2))
    )


def sample_kurtosis(c) -> Column:
    """Bias-corrected excess kurtosis G2 (pandas ``kurt``) as an aggregate.

    Spark's ``kurtosis`` is the population excess g2;
    G2 = (n-1)/((n-2)(n-3)) * ((n+1)*g2 + 6).  NULL for n < 4, 0 if constant.
    """
    x = _col(c)
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    return (
        F.when(n < 4, F.lit(None).cast("double"))
        .when(F.var_pop(x) == 0, F.lit(0.0))
        .otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    )


def kolmogorov_q(lam) -> Column:
    """Q(lambda) = 2 * sum_{j>=1} (-1)^(j-1) exp(-2 j^2 lambda^2), clamped to [0, 1]."""
    lam = _col(lam)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_SERIES_TERMS)),
        F.lit(0.0),
        lambda acc, j: acc
        + F.when(j % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(-2.0 * j * j * lam * lam),
    )
    q = F.least(F.greatest(2.0 * series, F.lit(0.0)), F.lit(1.0))
    return F.when(lam < KS_SMALL_LAMBDA, F.lit(1.0)).otherwise(q)


def ks_path_share(d: float, n: int, m: int) -> float:
    """Probability that two samples of ``n`` and ``m`` values of one distribution have a KS statistic of ``d`` or more.

    Their order is a lattice path from (0, 0) to (n, m), all equally likely; the
    statistic stays below ``d`` when the path keeps i/n and j/m closer than
    that.  Row by row, ``share[j]`` is the scaled share of paths to (i, j) that
    did: share(i, j) = share(i, j-1) + share(i-1, j) * i / (i + m), a running sum
    of the row before over the columns within reach.
    """
    reach = int(np.ceil(d * n * m - 1e-3)) - 1  # of |i * m - j * n|, whole numbers
    if reach < 0:
        return 1.0
    share, log_scale, before = np.zeros(m + 1), 0.0, 0
    share[: min(m, reach // n) + 1] = 1.0
    for i in range(1, n + 1):
        lo, hi = max(0, -((reach - i * m) // n)), min(m, (reach + i * m) // n)
        row = np.cumsum(share[lo : hi + 1]) * (i / (i + m))
        top = row.max(initial=0.0)
        if top == 0.0:
            return 1.0
        # A row is kept to its largest entry: the shares of long samples are too small for a double.
        share[lo : hi + 1] = row / top
        share[before:lo] = 0.0
        log_scale, before = log_scale + np.log(top), lo
    return float(min(1.0, max(0.0, 1.0 - share[m] * np.exp(log_scale))))


def ks_exact_pvalue(d, n_ref, n_cur, largest: int = KS_EXACT_MAX) -> Column:
    """Exact two-sided p-value of the two-sample KS statistic; NULL where a sample is empty or above ``largest``.

    The recurrence runs over arrays, in NumPy, for the few rows of a report (one a column).
    """

    @F.pandas_udf("double")
    def exact(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        fit = d.notna() & (n > 0) & (m > 0) & (n <= largest) & (m <= largest)
        return pd.Series([ks_path_share(x, int(a), int(b)) if ok else None for x, a, b, ok in zip(d, n, m, fit)], dtype="float64")

    return exact(_col(d).cast("double"), F.coalesce(_col(n_ref), F.lit(0)).cast("long"), F.coalesce(_col(n_cur), F.lit(0)).cast("long"))


def ks_pvalue(d, n_ref, n_cur, method: str = "asymptotic") -> Column:
    """Two-sided p-value of the two-sample KS statistic; NULL where a sample is empty.

    ``auto`` is exact where both samples have at most ``KS_EXACT_MAX`` values and asymptotic beyond.
    """
    if method not in KS_METHODS:
        raise ValueError(f"unknown method {method!r}; there are {KS_METHODS}")
    n = _col(n_ref).cast("double")
    m = _col(n_cur).cast("double")
    lam = _col(d) * F.sqrt(n * m / (n + m))
    limit = F.when((n > 0) & (m > 0), kolmogorov_q(lam))
    if method == "asymptotic":
        return limit
    exact = ks_exact_pvalue(d, n_ref, n_cur, KS_EXACT_MAX if method == "auto" else 2**31 - 1)
    return F.coalesce(exact, limit) if method == "auto" else exact


def severity(p) -> Column:
    """'high', 'medium' or 'low'; NULL when there is no p-value to judge by."""
    p = _col(p)
    return F.when(p < HIGH_P, F.lit("high")).when(p < MEDIUM_P, F.lit("medium")).when(p.isNotNull(), F.lit("low"))
