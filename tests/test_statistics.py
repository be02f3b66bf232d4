"""The correlation test's p value against numeric integration, over all degrees of freedom alike."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import stats


def integrated(r: float, df: int, steps: int = 200_000) -> float:
    """Two-sided tail from the density of r, (1 - u^2)^((df - 2) / 2), by Simpson's rule."""

    def area(a: float) -> tuple[float, float]:
        b = min(1 - 1e-12, a + 60 / math.sqrt(df)) if df > 50 else 1 - 1e-12
        u = np.linspace(a, b, steps + 1)
        scale = (df - 2) / 2 * math.log1p(-a * a)
        y = np.exp((df - 2) / 2 * np.log1p(-u * u) - scale)
        w = np.ones(steps + 1)
        w[1:-1:2], w[2:-1:2] = 4, 2
        return (b - a) / steps / 3 * float((w * y).sum()), scale

    (x, lx), (y, ly) = area(abs(r)), area(0.0)
    return x / y * math.exp(lx - ly)


def test_p_value(spark):
    rows = [(r, n) for n in (4, 5, 12, 102, 2002, 2003, 10_002, 1_000_002) for r in (0.001, -0.01, 0.1, 0.2, -0.3, 0.5)]
    for x in spark.createDataFrame(rows, "r double, n long").withColumn("p", stats.pearson_p(F.col("r"), F.col("n"))).collect():
        want = integrated(x.r, x.n - 2)
        assert x.p == pytest.approx(want, rel=5e-6, abs=1e-300), x


def test_p_value_at_the_ends(spark):
    rows = [(0.0, 10), (1.0, 10), (-1.0, 10), (0.5, 2), (None, 10)]
    got = spark.createDataFrame(rows, "r double, n long").select(stats.pearson_p(F.col("r"), F.col("n")).alias("p")).collect()
    assert [x.p for x in got] == [1.0, 0.0, 0.0, None, None]
