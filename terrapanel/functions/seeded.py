"""Reproducible random order, samples and weighted draws, from hashes of keys.

Nothing depends on partitioning or on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order_key(seed: int, *keys: Column) -> Column:
    """A text whose order is random but fixed for seed and keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1)."""
    return (F.conv(F.substring(order_key(seed, *keys), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def sample_n(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows; a top-k by hash, so no full sort."""
    return df.orderBy(order_key(seed, *map(F.col, keys)), *keys).limit(n)


def sample_per_group(df: DataFrame, group: list[str], n: int, seed: int, *keys: str) -> DataFrame:
    """n rows of each group (all of a smaller one)."""
    place = F.row_number().over(W.partitionBy(*group).orderBy(order_key(seed, *map(F.col, keys)), *keys))
    return df.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def weighted_key(weight: Column, seed: int, *keys: Column) -> Column:
    """Exponential draw with rate ``weight``: the k smallest are a weighted sample without replacement."""
    return F.when(weight > 0, -F.ln(uniform(seed, *keys)) / weight)
