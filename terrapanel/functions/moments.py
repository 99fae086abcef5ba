"""Moments as aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def skew(c: Column) -> Column:
    """Mean cube of deviations over the cubed sample deviation; NULL below 3 values, 0 without spread."""
    n, sd = F.count(c), F.stddev_samp(c)
    return F.when(n < 3, None).when(sd < 1e-12, 0.0).otherwise(F.skewness(c) * F.pow((n - 1) / n, F.lit(1.5)))


def excess_kurtosis(c: Column) -> Column:
    """As skew, with fourth powers, minus 3; NULL below 4 values, 0 without spread."""
    n, sd = F.count(c), F.stddev_samp(c)
    return F.when(n < 4, None).when(sd < 1e-12, 0.0).otherwise((F.kurtosis(c) + 3) * F.pow((n - 1) / n, F.lit(2.0)) - 3)


def r_squared(error_squared: Column, truth: Column) -> Column:
    """1 - SSE / SST of a group; NULL where the truth has no spread."""
    return F.lit(1.0) - F.try_divide(F.sum(error_squared), F.nullif((F.count(truth) - 1) * F.var_samp(truth), F.lit(0.0)))
