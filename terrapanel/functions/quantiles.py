"""Order statistics of large groups: running counts of distinct values, and exact quantiles.

A window over a group sorts all of it in one task, and Spark's ``percentile``
keeps a group's values in one task's memory.  Here a group's distinct values
are counted first, dealt to tasks by ranges of (group, value), and written, slim
and once; all that follows reads that table.  The parts' counts, as many as
there are tasks and groups, are added up, and values are sorted within their
part only.  So a hot group is spread over all tasks, whatever its distribution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapanel.sources.scratch import folder

#: Bits of the rows' numbers within a task, as ``monotonically_increasing_id`` gives them.
_IN_TASK = 33


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what several steps read, made once."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_parts(df: DataFrame, order: Sequence[str], part: str = "__part", place: str = "__at") -> DataFrame:
    """df, written, in ranges of ``order``: with the number of a row's range, and its place within, in that order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    kept = written(dealt, "ranges")
    return kept.withColumns({part: F.shiftright(place, _IN_TASK).cast("int"), place: F.col(place).bitwiseAND(F.lit((1 << _IN_TASK) - 1))})


def ordered_counts(df: DataFrame, value: str, by: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Rows (by..., value, __n, __before, __total) for each distinct non-null value of each group.

    ``__n`` rows (or their weight) have the value, ``__before`` have a smaller
    one, ``__total`` are in the group.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.count("*") if weight is None else F.sum(weight)).alias("__n")).where("__n > 0")
    dealt = in_parts(counts, [*by, value])
    sums = dealt.groupBy(*by, "__part").agg(F.sum("__n").alias("__in_part"))
    of_group = W.partitionBy(*by)
    # As many rows of each group as there are tasks, at most.
    sums = sums.withColumns({"__offset": F.sum("__in_part").over(of_group.orderBy("__part")) - F.col("__in_part"), "__total": F.sum("__in_part").over(of_group)})
    inside = W.partitionBy(*by, "__part").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    running = dealt.withColumn("__upto", F.sum("__n").over(inside))
    found = running.join(sums.drop("__in_part"), [*by, "__part"])
    return found.select(*by, value, "__n", (F.col("__offset") + F.col("__upto") - F.col("__n")).alias("__before"), "__total")


def group_quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), name: str = "quantiles", weight: Column | None = None) -> DataFrame:
    """Rows (by..., name): linearly interpolated quantiles of the non-null values, in the order of the shares.

    With a whole-number ``weight`` each row counts as so many.
    """
    keys = list(by) or ["__all"]
    own = df if by else df.withColumn("__all", F.lit(1))
    own = own.select(*keys, F.col(value).cast("double").alias("__v"), *([] if weight is None else [weight.alias("__w")]))
    counts = ordered_counts(own, "__v", keys, None if weight is None else F.col("__w"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(s)) * (F.col("__total") - 1)).alias("h")) for i, s in enumerate(shares)])
    there = lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__n"))
    hits = counts.withColumn("__hit", F.explode(F.filter(wanted, lambda w: there(F.floor(w["h"])) | there(F.ceil(w["h"])))))
    h = F.col("__hit.h")
    each = hits.groupBy(*keys, F.col("__hit.i").alias("__i"), h.alias("__h")).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    between = F.col("__low") + (F.col("__h") - F.floor("__h")) * (F.col("__high") - F.col("__low"))
    out = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", between.alias("__q")))), lambda x: x["__q"]).alias(name))
    return out if by else out.drop("__all")
