import numpy as np
import pytest

from vesper import Monitor, step
from vesper.functions import intervals, stats


def test_fits():
    x = np.arange(20)
    fit = stats.polynomial_fit(x, 2 + 3 * x + 0.5 * x**2, 2)
    assert np.allclose(fit.coefficients, [2, 3, 0.5]) and fit.r2 > 0.999999 and fit.rmse < 1e-6
    assert stats.polynomial_fit([1, 2, 3], [5, 5, 5]).r2 == 1.0


def test_rank_test():
    u, p = stats.mann_whitney([1, 2, 3, 4, 5], [6, 7, 8, 9, 10])
    assert u == 0 and 0.01 < p < 0.013
    assert stats.mann_whitney([1, 1], [1, 1]) == (2.0, 1.0)
    assert stats.ranks(np.array([3, 1, 3])).tolist() == [2.5, 1.0, 2.5]


def test_interval_arithmetic(spark):
    from pyspark.sql import functions as F

    x, y = (F.lit(1.0), F.lit(2.0)), (F.lit(0.5), F.lit(1.5))
    row = spark.range(1).select(*intervals.add(x, y), *intervals.subtract(x, y), *intervals.negate(x), *intervals.shift(x, 1), *intervals.least(x, y), *intervals.greatest(x, y), intervals.decided((F.lit(1), F.lit(1)))).first()
    assert tuple(row) == (1.5, 3.5, -0.5, 1.5, -2.0, -1.0, 2.0, 3.0, 0.5, 1.5, 1.0, 2.0, True)


def test_steps():
    assert step("x", 5.5, "10ms") == ("x", 5.5, 0.01) and step("x", 1, 3) == ("x", 1.0, 3.0) and step("x", 1, "2s")[2] == 2.0
    with pytest.raises(ValueError, match="unit"):
        step("x", 1, "3h")
    assert Monitor("x > 5").update(*step("x", 7, "1500us")).verdicts() == [(0.0015, 2.0)]
