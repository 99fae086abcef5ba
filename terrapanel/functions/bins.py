"""Bins by quantiles or by given edges.  ``edges`` are array columns, ascending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.quantiles import group_quantiles


def inner(edges: Column) -> Column:
    return F.slice(edges, F.lit(2), F.greatest(F.lit(0), F.size(edges) - 2))


def right_closed(x: Column, edges: Column) -> Column:
    """Number of inner edges below x: bins are open on the left, the first one is closed."""
    return F.when(x.isNotNull(), F.size(F.filter(inner(edges), lambda e: e < x)))


def left_closed(x: Column, edges: Column) -> Column:
    """Number of inner edges not above x."""
    return F.when(x.isNotNull(), F.size(F.filter(inner(edges), lambda e: e <= x)))


def qcut(df: DataFrame, value: str, bins: int, by: list[str] | None = None, name: str = "bin") -> DataFrame:
    """Quantile bins of a value within groups (or over all rows).

    Edges are a small table that is joined back; it comes from bucket counts,
    so no group has to fit into one task.  NULL values get no bin.
    """
    quantiles = group_quantiles(df, value, [k / bins for k in range(bins + 1)], by or (), "__edges").withColumn("__edges", F.array_distinct("__edges"))
    joined = df.join(quantiles, by, "left") if by else df.join(F.broadcast(quantiles), F.lit(True), "left")  # one row
    return joined.withColumn(name, right_closed(F.col(value), F.col("__edges"))).drop("__edges")


def cut_stretched(x: Column, edges: Column) -> Column:
    """Bins 1 .. n by given edges, right-closed, where the outer bins take what lies beyond."""
    return right_closed(x, edges) + 1


def histogram_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """Equal bins 0 .. bins - 1; the last one is closed; NULL outside."""
    at = F.floor((x - F.lit(low)) * F.lit(bins) / F.lit(high - low)).cast("int")
    return F.when((x >= low) & (x <= high), F.least(at, F.lit(bins - 1)))
