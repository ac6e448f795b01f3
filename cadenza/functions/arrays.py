"""Column functions over vectors and scores. Log zero is the constant LOG_ZERO, as comparisons with it matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The log-zero sentinel, and the difference below which an addition in logs has no effect.
LOG_ZERO, LOG_ADD_MIN = -1_000_000.0, -13.815510558
LOG10_E, LN_10 = 0.4342944819032518, 2.302585092994046


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vec(x: Column | str) -> Column:
    return _c(x).cast("array<double>")


def total(x: Column | str) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + v)


def dot(x: Column | str, y: Column | str) -> Column:
    return total(F.zip_with(_c(x), _c(y), lambda a, b: a * b))


def squared_sum(x: Column | str) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + v * v)


def mean(x: Column | str) -> Column:
    return total(x) / F.size(_c(x))


def log_add(x: Column | str, y: Column | str) -> Column:
    """ln(e^x + e^y), exact; the smaller is left out where it is below the cut-off."""
    hi, lo = F.greatest(_c(x), _c(y)), F.least(_c(x), _c(y))
    return F.when(lo - hi < LOG_ADD_MIN, hi).otherwise(hi + F.log1p(F.exp(lo - hi)))


def log_sum_exp(x: Column | str) -> Column:
    """ln of the sum of e^v over an array; LOG_ZERO for an empty one."""
    top = F.array_max(_c(x))
    return F.coalesce(top + F.log(F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + F.exp(v - top))), F.lit(LOG_ZERO))


def log_sum_exp_agg(x: Column | str, top: Column | str) -> Column:
    """The same as an aggregate, given the group's maximum as a column."""
    return F.max(_c(top)) + F.log(F.sum(F.exp(_c(x) - _c(top))))


def top_mean(x: Column | str, n: int) -> Column:
    """Mean of the n highest values above LOG_ZERO; LOG_ZERO if there are none."""
    best = F.slice(F.sort_array(F.filter(_c(x), lambda v: v > LOG_ZERO), asc=False), 1, n)
    return F.when(F.size(best) > 0, mean(best)).otherwise(F.lit(LOG_ZERO))
