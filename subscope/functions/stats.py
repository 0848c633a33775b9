"""Closed-form statistics as column expressions over additive moments."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def slope(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column) -> Column:
    """Least-squares slope from sums; 0 for fewer than two points or a constant x.

    n, sx and sxx are whole numbers. If y is a decimal, both differences are exact and only the last
    division rounds.
    """
    n, sx, sxx = (c.cast("decimal(20,0)") for c in (n, sx, sxx))
    top, bottom = n * sxy - sx * sy, n * sxx - sx * sx
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def _ks_argument(stat: Column, n: Column, m: Column) -> Column:
    size = (n.cast("double") * m.cast("double")) / (n + m).cast("double")
    return F.sqrt(size) * stat


def _ks_small(lam: Column, terms: int) -> Column:
    """The p-value by the series that converges fast for small arguments."""
    total = sum((F.exp(F.lit(-((2 * k - 1) ** 2) * math.pi**2 / 8) / (lam * lam)) for k in range(1, terms + 1)), start=F.lit(0.0))
    return 1 - F.lit(math.sqrt(2 * math.pi)) / lam * total


def ks_p_value(stat: Column, n: Column, m: Column, terms: int = 4) -> Column:
    """Asymptotic two-sided Kolmogorov-Smirnov p-value.

    The limit distribution has two series, one that converges fast for large arguments and one for
    small; switching between them makes four terms of each exact to double precision.
    """
    lam = _ks_argument(stat, n, m)
    large = F.lit(0.0)
    for k in range(1, terms + 1):
        large = large + F.lit(2.0 if k % 2 else -2.0) * F.exp(F.lit(-2.0 * k * k) * lam * lam)
    p = F.when(lam > 1.18, large).when(lam > 0, _ks_small(lam, terms))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p.otherwise(1.0)))


def ks_log10_p_value(stat: Column, n: Column, m: Column, terms: int = 4) -> Column:
    """Decimal logarithm of the p-value, so that values too small for a double stay apart.

    For large arguments the first term leads: its logarithm is taken as it is, and the rest enters as a ratio to it.
    """
    lam = _ks_argument(stat, n, m)
    square = lam * lam
    rest = F.lit(0.0)
    for k in range(2, terms + 1):
        rest = rest + F.lit(1.0 if k % 2 else -1.0) * F.exp(F.lit(-2.0 * (k * k - 1)) * square)
    large = F.lit(math.log(2)) - 2 * square + F.log1p(rest)
    small = F.log(F.least(F.lit(1.0), _ks_small(lam, terms)))
    return F.when(lam > 1.18, large).when(lam > 0.1, small).otherwise(0.0) / math.log(10) + F.lit(0.0)


def bin_index(value: str, lo: str, hi: str, bins: int) -> Column:
    """0-based equal-width bin over [lo, hi]; the last bin is closed, values outside are clipped.

    Arguments are SQL fragments. Counting the inner edges at or below the value puts a value that
    equals an edge into the bin above it, whatever its rounding.
    """
    edges = (f"{lo} + {float(k)}D * ({hi} - {lo}) / {float(bins)}D" for k in range(1, bins))
    return F.expr(" + ".join(["0", *(f"if({value} >= {e}, 1, 0)" for e in edges)]))
