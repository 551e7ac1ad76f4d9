"""Statistics that stay null, and do not fail, where they are undefined."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def both(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    """Two columns, each null where either is."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    known = a.isNotNull() & b.isNotNull()
    return F.when(known, a.cast("double")), F.when(known, b.cast("double"))


def safe_corr(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation over rows where both are known; null for a constant side."""
    x, y = both(a, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def t_statistic(x: Column | str) -> Column:
    """Of the hypothesis that the mean is zero."""
    x = F.col(x) if isinstance(x, str) else x
    return F.try_divide(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x)))


def t_p_value(t: float, n: int) -> float:
    """Two-sided p-value of a t statistic with ``n - 1`` degrees of freedom."""
    if n < 2 or t is None or math.isnan(t):
        return float("nan")
    df = n - 1
    return _beta(df / (df + t * t), df / 2, 0.5)


def _beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.log(a) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number, by Stirling's series eight places further on."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(product)


def incomplete_beta(x: Column, a: Column, b: Column, steps: int = 200) -> Column:
    """Regularised incomplete beta function for ``x < (a + 1) / (a + b + 2)``: its continued fraction, folded over a sequence."""
    tiny = F.lit(1e-300)
    firm = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    d0 = 1 / firm(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def half(s: Column, n: Column) -> Column:
        d, c = 1 / firm(1 + n * s["d"]), firm(1 + n / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    def step(s: Column, i: Column) -> Column:
        n = F.floor(i / 2).cast("double")
        even = n * (b - n) * x / ((a + 2 * n - 1) * (a + 2 * n))
        odd = -(a + n) * (a + b + n) * x / ((a + 2 * n) * (a + 2 * n + 1))
        return half(s, F.when(i % 2 == 0, even).otherwise(odd))

    h = F.aggregate(F.sequence(F.lit(2), F.lit(2 * steps + 1)), start, step, lambda s: s["h"])
    front = F.exp(a * F.ln(x) + b * F.log1p(-x) - F.ln(a) - (ln_gamma(a) + ln_gamma(b) - ln_gamma(a + b)))
    return front * h


def p_value(t: Column, n: Column) -> Column:
    """Two-sided p-value of a t statistic of ``n`` values (``n - 1`` degrees of freedom); null under two of them."""
    v = (n - 1).cast("double")
    x = v / (v + t * t)
    a, b = v / 2, F.lit(0.5)
    low = incomplete_beta(x, a, b)
    high = 1 - incomplete_beta(1 - x, b, a)
    return F.when((n < 2) | t.isNull() | F.isnan(t), F.lit(None)).when(t == 0, 1.0).when(x <= 0, 0.0).when(x < (a + 1) / (a + b + 2), low).otherwise(high)


def array_ranks(xs: Column) -> Column:
    """Of numbers in an array, how many are smaller, plus one."""
    return F.transform(xs, lambda x: F.size(F.filter(xs, lambda y: y < x)) + 1.0)


def array_corr(xs: Column, ys: Column) -> Column:
    """Pearson correlation of two arrays of equal length without nulls; null for a constant side."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    n = F.size(xs).cast("double")
    mx, my = F.try_divide(total(xs), n), F.try_divide(total(ys), n)
    cov = total(F.zip_with(xs, ys, lambda x, y: (x - mx) * (y - my)))
    vx, vy = total(F.transform(xs, lambda x: (x - mx) * (x - mx))), total(F.transform(ys, lambda y: (y - my) * (y - my)))
    return F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating-point NaN becomes null, so that aggregates skip it and comparisons are unknown."""
    fixed = {n: F.when(F.isnan(n), F.lit(None)).otherwise(F.col(n)) for n, kind in df.dtypes if kind in ("double", "float")}
    return df.withColumns(fixed) if fixed else df


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)
