"""Ranks with ties, plotting positions, percentiles of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapanel.functions.quantiles import in_parts, ordered_counts


def with_average_rank(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """df with the average rank from 1 within groups; ties share the mean of their ranks, NULL for NULL.

    Ranks come from running counts of distinct values (see ``ordered_counts``)
    and are joined back by value.
    """
    ranks = ordered_counts(df, value, by).select(*by, value, (F.col("__before") + (F.col("__n") + 1) / 2).alias(name))
    return df.join(ranks, [*by, value], "left")


def with_place(df: DataFrame, value: str, key: str, by: list[str], name: str) -> DataFrame:
    """df with the place from 1 in the order of value, then key; rows without a value are left out.

    Rows are dealt by ranges of (group, value, key) and numbered where they are,
    so neither a large group nor one frequent value meets in one task.
    """
    dealt = in_parts(df.where(F.col(value).isNotNull()), [*by, value, key])
    parts = dealt.groupBy(*by, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(W.partitionBy(*by).orderBy("__part")) - F.col("__n")
    placed = dealt.join(parts.withColumn("__before", before).drop("__n"), [*by, "__part"])
    return placed.withColumn(name, F.col("__before") + F.col("__at") - F.col("__first") + 1).drop("__part", "__at", "__before", "__first")


def hazen(rank: Column, n: Column, margin: float = 1e-6) -> Column:
    """Plotting position (rank - 1/2) / n, kept off 0 and 1."""
    return F.greatest(F.least((rank - F.lit(0.5)) / n, F.lit(1 - margin)), F.lit(margin))


def percentile_of_score(value: Column, score: Column) -> Column:
    """Aggregate: mean of the shares below and not above the score, in percent."""
    return F.lit(100.0) * (F.avg((value < score).cast("double")) + F.avg((value <= score).cast("double"))) / 2
