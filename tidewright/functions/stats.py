"""Correlation intervals and tests as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def fisher_bound(r: Column, n: Column, sign: int, z: float = 1.96) -> Column:
    """One end of the Fisher confidence interval of a correlation."""
    safe = F.when((F.abs(r) < 1) & (n > 3), F.atanh(r) + F.lit(sign * z) / F.sqrt(F.greatest(n - 3, F.lit(1))))
    return F.tanh(safe)


#: Steps of the continued fraction; enough for full accuracy at any number of degrees of freedom (see the tests).
BETA_STEPS = 60


def pearson_p(r: Column, n: Column) -> Column:
    """Two-sided p value of a correlation from Student's t with n - 2 degrees of freedom, one formula for all n.

    With x = 1 - r^2 the tail is the regularised incomplete beta function I_x(df / 2, 1 / 2). Its continued fraction is taken on
    the side where it converges, so a small p is computed itself and not as the rest to one.
    """
    df = (n - 2).cast("double")
    a, x = df / 2, F.lit(1.0) - r * r
    own = x < (a + 1) / (a + 2.5)
    first, second = F.when(own, a).otherwise(F.lit(0.5)), F.when(own, F.lit(0.5)).otherwise(a)
    at = F.when(own, x).otherwise(r * r)
    # log of x^a (1 - x)^(1/2) / B(a, 1/2), the same on both sides
    front = F.when((x > 0) & (r != 0), a * F.log(x) + F.log(F.abs(r)) + F.log(_gamma_ratio(a) / math.sqrt(math.pi)))
    part = F.exp(front) / first * _beta_fraction(first, second, at)
    p = F.when(own, part).otherwise(1 - part)
    return F.when(df >= 1, F.when(x <= 0, F.lit(0.0)).when(r == 0, F.lit(1.0)).otherwise(p))


def _gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a) by its asymptotic series, ten steps further up."""
    y = a + 10
    series = 1 + (-1 / 8 + (1 / 128 + (5 / 1024 - (21 / 32768) / y) / y) / y) / y
    ratio = F.sqrt(y) * series
    for i in range(10):
        ratio = ratio * (a + i) / (a + i + 0.5)
    return ratio


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its far end inwards."""
    start = F.struct(a.alias("a"), b.alias("b"), x.alias("x"), F.lit(1.0).alias("f"))

    def step(s: Column, i: Column) -> Column:
        m = F.lit(float(BETA_STEPS)) - i
        even = m * (s.b - m) * s.x / ((s.a + 2 * m - 1) * (s.a + 2 * m))
        odd = -(s.a + m) * (s.a + s.b + m) * s.x / ((s.a + 2 * m) * (s.a + 2 * m + 1))
        inner = 1 + odd / s.f
        return F.struct(s.a.alias("a"), s.b.alias("b"), s.x.alias("x"), F.when(m > 0, 1 + even / inner).otherwise(inner).alias("f"))

    return F.lit(1.0) / F.aggregate(F.sequence(F.lit(0), F.lit(BETA_STEPS)), start, step, lambda s: s.f)


def partial_corr(rxy: Column, rxz: Column, ryz: Column) -> Column:
    return F.try_divide(rxy - rxz * ryz, F.sqrt((1 - rxz * rxz) * (1 - ryz * ryz)))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation of the pairs where both are present; NULL when either does not vary (the built-in raises then)."""
    x, y = _col(x), _col(y)
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))


def line_slope(y: Column | str, x: Column | str) -> Column:
    """Least-squares slope; NULL when x does not vary."""
    x, y = _col(x), _col(y)
    return F.try_divide(F.covar_pop(x, y), F.var_pop(F.when(y.isNotNull(), x)))


def line_intercept(y: Column | str, x: Column | str) -> Column:
    x, y = _col(x), _col(y)
    return F.avg(F.when(x.isNotNull(), y)) - line_slope(y, x) * F.avg(F.when(y.isNotNull(), x))
