"""The standard normal distribution, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of rational approximations (fixed values): of the quantile by Acklam (relative error below 1.2e-9),
# of the distribution by Hart as given by West (double precision).
_CENTRE = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_CENTRE_BELOW = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
_TAIL = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_TAIL_BELOW = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
_EDGE = 0.02425
_UP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_DOWN = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda total, c: total * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def quantile(p: Column) -> Column:
    """``x`` with ``P(X <= x) = p``; null outside (0, 1)."""
    tail = lambda q: _polynomial(_TAIL, q) / _polynomial(_TAIL_BELOW, q)
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    q = p - 0.5
    centre = _polynomial(_CENTRE, q * q) * q / _polynomial(_CENTRE_BELOW, q * q)
    inside = (p > 0) & (p < 1)
    return F.when(inside & (p < _EDGE), tail(low)).when(inside & (p > 1 - _EDGE), -tail(high)).when(inside, centre)


def distribution(x: Column) -> Column:
    """``P(X <= x)``."""
    a = F.abs(x)
    bell = F.exp(-a * a / 2)
    near = bell * _polynomial(_UP, a) / _polynomial(_DOWN, a)
    chain = reduce(lambda rest, k: a + F.lit(float(k)) / rest, (4, 3, 2, 1), a + 0.65)
    upper = F.when(a < 7.07106781186547, near).otherwise(bell / chain / 2.506628274631)
    return F.when(x > 0, 1 - upper).otherwise(upper)
