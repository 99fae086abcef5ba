"""Guarded arithmetic on columns.

Missing values are NULL, never NaN: ``normalise`` is applied where data come in,
so that comparisons, averages and counts behave alike everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalise(df: DataFrame) -> DataFrame:
    """NaN in floating-point columns becomes NULL."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def finite(c: Column) -> Column:
    """Whether a number is neither NULL, NaN nor infinite; never NULL itself."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def numeric_or_null(c: Column, sentinel: float = -666666666.0) -> Column:
    """Text or number as double; what is no number, and the sentinel, become NULL."""
    return F.nullif(c.try_cast("double"), F.lit(sentinel))


def ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """num / den * scale; NULL where den is 0 or NULL."""
    return F.try_divide(num * F.lit(float(scale)), F.nullif(den, F.lit(0)))


def sum_or_zero(columns: Sequence[Column]) -> Column:
    """Row-wise sum that takes NULL as 0: all NULL gives 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns])


def weighted_mean(values: Sequence[tuple[Column, float]], total: Column) -> Column:
    """Mean of fixed mid-points, weighted by count columns."""
    return ratio(sum_or_zero([c * F.lit(float(w)) for c, w in values]), total)


def log_positive(c: Column) -> Column:
    """Natural logarithm; NULL for 0 and below."""
    return F.when(c > 0, F.ln(c))


def clip(c: Column, low, high) -> Column:
    """Within bounds; NULL stays NULL."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def nearest(c: Column, choices: Sequence[int]) -> Column:
    """The choice with the least distance; of two, the smaller."""
    options = F.array(*[F.struct(F.abs(c - F.lit(y)).alias("d"), F.lit(y).alias("y")) for y in sorted(choices)])
    return F.when(c.isNotNull(), F.array_min(options)["y"])


def first_at_or_after(c: Column, choices: Sequence[int]) -> Column:
    """The smallest choice that is not below c, or NULL."""
    years = F.array(*[F.lit(y) for y in sorted(choices)])
    return F.array_min(F.filter(years, lambda y: y >= c))


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise linear through the knots; constant beyond the ends.  xs is ascending."""
    n = F.size(xs)
    at = F.greatest(F.lit(1), F.least(n - 1, F.size(F.filter(xs, lambda k: k <= x))))  # knot to the left, from 1
    x0, x1 = F.element_at(xs, at), F.element_at(xs, F.least(n, at + 1))
    y0, y1 = F.element_at(ys, at), F.element_at(ys, F.least(n, at + 1))
    inner = y0 + F.coalesce(F.try_divide((x - x0) * (y1 - y0), F.nullif(x1 - x0, F.lit(0.0))), F.lit(0.0))
    return F.when(x <= F.element_at(xs, 1), F.element_at(ys, 1)).when(x >= F.element_at(xs, -1), F.element_at(ys, -1)).when(x.isNotNull(), inner)


def last_label_wins(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """Labels that are written one after the other: of several that apply, the last one stands."""
    out = F.lit(default)
    for mask, label in rules:
        out = F.when(F.coalesce(mask, F.lit(False)), F.lit(label)).otherwise(out)
    return out


def exact_mean(value: Column) -> Column:
    """Aggregate: the mean of doubles, the same whatever order they are added in, so that equal groups tie.

    Their digits to the base 2^26, which are whole numbers, are added up by
    place down to 2^-78, and the sum is rounded once.
    Beyond 10^15, or where one is not finite, it is the plain mean.
    """
    base, fits = 2.0**26, F.abs(value) < F.lit(1e15)
    places = [F.sum(F.when(fits, (value * F.lit(base**k)) % F.lit(base)).cast("long")) for k in range(-1, 4)]
    whole = lambda c: c.cast("decimal(38,0)")
    total = whole(places[0])
    for place in places[1:4]:
        total = (total * F.lit(int(base)).cast("decimal(9,0)")).cast("decimal(38,0)") + whole(place)
    parts = [place.cast("double") * F.lit(base**-k) for k, place in zip(range(-1, 4), places, strict=True)]
    rough = parts[0] + parts[1] + parts[2] + parts[3]
    exact = F.when(F.abs(rough) < F.lit(1e22), total.cast("double") * F.lit(base**-2)).otherwise(rough) + parts[4]
    return F.when(F.count(F.when(~fits, 1)) > 0, F.avg(value)).otherwise(F.try_divide(exact, F.count(value)))
