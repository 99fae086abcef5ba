"""Panel operators: relative scores, changes, event timing, long differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapanel.functions.numeric import log_positive, ratio
from terrapanel.functions.quantiles import group_quantiles
from terrapanel.functions.special import Z_95

#: 90 % margins of error to standard errors.
MARGIN_TO_ERROR = 1.645


def relative_scores(df: DataFrame, income: str, margin: str, by: list[str]) -> DataFrame:
    """z-score of log income within each vintage, and its standard error by the delta method.

    Mean and deviation are one small aggregate for each vintage, joined back.
    """
    own = df.withColumn("log_value", log_positive(F.col(income))).withColumn("log_error", ratio(F.col(margin) / MARGIN_TO_ERROR, F.col(income)))
    stats = own.groupBy(*by).agg(F.avg("log_value").alias("__mean"), F.stddev_samp("log_value").alias("__sd"))
    joined = own.join(stats, by) if by else own.crossJoin(F.broadcast(stats))
    z = ratio(F.col("log_value") - F.col("__mean"), F.col("__sd"))
    return joined.withColumns({"rel_score": z, "rel_error": ratio(F.col("log_error"), F.col("__sd"))}).drop("__mean", "__sd")


def change_test(before: Column, after: Column, error_before: Column, error_after: Column) -> tuple[Column, Column, Column]:
    """Difference, |z| and the flag for p < 0.05."""
    z = F.try_divide(F.abs(after - before), F.nullif(F.sqrt(error_before * error_before + error_after * error_after), F.lit(0.0)))
    return after - before, z, F.coalesce(z > Z_95, F.lit(False))


def consecutive_changes(df: DataFrame, unit: str, year: str, score: str, error: str) -> DataFrame:
    """Rows (unit, from, to, diff, z, significant) for each pair of neighbouring observations."""
    order = W.partitionBy(unit).orderBy(year)
    own = df.withColumns({"from_year": F.lag(year).over(order), "__s": F.lag(score).over(order), "__e": F.lag(error).over(order)}).where("from_year IS NOT NULL")
    diff, z, flag = change_test(F.col("__s"), F.col(score), F.col("__e"), F.col(error))
    return own.select(unit, "from_year", F.col(year).alias("to_year"), diff.alias("diff"), z.alias("z"), flag.alias("significant"))


def first_last_change(df: DataFrame, unit: str, year: str, score: str, error: str) -> DataFrame:
    """As consecutive_changes, for the first and the last of more than two observations."""
    ends = df.groupBy(unit).agg(
        F.count("*").alias("n"), F.min_by(F.struct(year, score, error), F.col(year)).alias("a"), F.max_by(F.struct(year, score, error), F.col(year)).alias("b")
    )
    diff, z, flag = change_test(F.col(f"a.{score}"), F.col(f"b.{score}"), F.col(f"a.{error}"), F.col(f"b.{error}"))
    return ends.where("n > 2").select(unit, F.col(f"a.{year}").alias("from_year"), F.col(f"b.{year}").alias("to_year"), diff.alias("diff"), z.alias("z"), flag.alias("significant"))


def structural_change(changes: DataFrame, overall: DataFrame, unit: str) -> DataFrame:
    """Rows (unit, yo_yo, valid): two significant changes in a row of opposite sign; any significant one without that."""
    order = W.partitionBy(unit).orderBy("from_year")
    turned = F.col("significant") & F.lag("significant").over(order) & (F.signum("diff") != F.lag(F.signum("diff")).over(order))
    flags = changes.withColumn("turned", F.coalesce(turned, F.lit(False))).select(unit, "significant", "turned")
    both = flags.unionByName(overall.select(unit, "significant", F.lit(False).alias("turned")))
    return both.groupBy(unit).agg(F.bool_or("turned").alias("yo_yo"), (F.bool_or("significant") & ~F.bool_or("turned")).alias("valid"))


def cumulative(df: DataFrame, unit: str, year: str, value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(W.partitionBy(unit).orderBy(year).rowsBetween(W.unboundedPreceding, W.currentRow)))


def first_year_over(df: DataFrame, unit: str, year: str, share: str, threshold: float, name: str) -> DataFrame:
    """The first year of each unit with a share above the threshold; 0 if there is none."""
    return df.groupBy(unit).agg(F.coalesce(F.min(F.when(F.col(share) > threshold, F.col(year))), F.lit(0)).alias(name))


def before_and_after(df: DataFrame, unit: str, year: str, value: str, event: str) -> DataFrame:
    """Means before and from the event year on, and their difference; units with both sides only."""
    sides = df.groupBy(unit).agg(
        F.avg(F.when(F.col(year) < F.col(event), F.col(value))).alias("mean_before"), F.avg(F.when(F.col(year) >= F.col(event), F.col(value))).alias("mean_after")
    )
    return sides.where("mean_before IS NOT NULL AND mean_after IS NOT NULL").withColumn("delta", F.col("mean_after") - F.col("mean_before"))


def winsorise(df: DataFrame, value: str, by: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values beyond the group's quantiles become those quantiles; the quantiles are a small aggregate."""
    q = group_quantiles(df, value, [low, high], by, "__q")
    bounded = F.greatest(F.least(F.col(value), F.col("__q")[1]), F.col("__q")[0])
    return df.join(q, by).withColumn(value, bounded).drop("__q")


def rolling_sum(df: DataFrame, order: list[str], by: list[str], value: str, size: int, name: str) -> DataFrame:
    """Sum over the latest ``size`` rows; NULL until there are as many."""
    window = W.partitionBy(*by).orderBy(*order).rowsBetween(1 - size, 0)
    return df.withColumn(name, F.when(F.count("*").over(window) == size, F.sum(value).over(window)))


def exponential_mean(df: DataFrame, by: list[str], order: str, value: str, span: int, name: str) -> DataFrame:
    """The last exponentially weighted mean of each group, without adjustment.

    It is a weighted sum over the ranks from the end, so nothing is folded row
    by row: weight a(1-a)^k for the k-th last row, (1-a)^(n-1) for the first.
    """
    a = 2.0 / (span + 1)
    back = F.row_number().over(W.partitionBy(*by).orderBy(F.col(order).desc())) - 1
    n = F.count("*").over(W.partitionBy(*by))
    weight = F.pow(F.lit(1 - a), F.col("__k")) * F.when(F.col("__k") == F.col("__n") - 1, F.lit(1.0)).otherwise(F.lit(a))
    return df.withColumns({"__k": back, "__n": n}).groupBy(*by).agg(F.sum(F.col(value) * weight).alias(name))
