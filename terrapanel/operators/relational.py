"""Relational building blocks: de-duplication, pivots, first matches, checked joins, audits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_first(df: DataFrame, keys: list[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    return df.withColumn("__n", F.count("*").over(W.partitionBy(*keys))).where("__n > 1").drop("__n")


def alive_years(df: DataFrame, years: Sequence[int], start: Column, end: Column, name: str = "year") -> DataFrame:
    """A row for each panel year with start <= year < end.

    The years are filtered inside the row, so there is no join at all; missing
    bounds count as always and never.
    """
    begin, stop = F.coalesce(start.cast("int"), F.lit(0)), F.coalesce(end.cast("int"), F.lit(2999))
    panel = F.array(*[F.lit(y) for y in years])
    return df.withColumn(name, F.explode(F.filter(panel, lambda y: (begin <= y) & (stop > y))))


def fan_out(df: DataFrame, value: str, thresholds: dict[str, float], name: str = "level") -> DataFrame:
    """A row for each threshold that the value meets."""
    levels = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in thresholds.items()])
    met = F.filter(levels, lambda x: F.col(value) >= x["v"])
    return df.withColumn("__l", F.explode(met)).withColumn(name, F.col("__l.k")).drop("__l")


def dense_grid(df: DataFrame, key: str, values: Sequence[int], name: str) -> DataFrame:
    """Every distinct key with every value."""
    return df.select(key).distinct().withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def pivot_first(df: DataFrame, keys: list[str], on: str, values: Sequence, cell: str, prefix: str) -> DataFrame:
    """Long to wide: the cell of each value (the smallest, so that repeated cells are defined)."""
    cells = [F.min(F.when(F.col(on) == v, F.col(cell))).alias(f"{prefix}{v}") for v in values]
    return df.groupBy(*keys).agg(*cells)


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def crosstab_shares(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts of column values for each row value, as shares of the row."""
    cells = [(F.sum((F.col(column) == v).cast("int")) / F.count("*")).alias(f"share_{v}") for v in values]
    return df.groupBy(row).agg(*cells)


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str, validate: str) -> DataFrame:
    """A join after a check that keys are unique: "1:1", "m:1", "1:m" or "m:m"."""
    for side, df in (("left", left), ("right", right)):
        if validate.split(":")[0 if side == "left" else 1] == "1":
            if df.groupBy(*on).count().where("count > 1").limit(1).count():
                raise ValueError(f"keys of the {side} side are not unique")
    return left.join(right, on, how)


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: list[str], take: list[str], how: str = "left") -> DataFrame:
    """left with columns of the right side's first row of each key."""
    first = right.groupBy(*on).agg(F.min(F.struct(*order, *[c for c in take if c not in order])).alias("__first"))
    return left.join(first.select(*on, *[F.col(f"__first.{c}").alias(c) for c in take]), on, how)


def stack(parts: dict[object, DataFrame], tag: str) -> DataFrame:
    """Union by name, with the key of each part as a literal column; absent columns are NULL."""
    tagged = [df.withColumn(tag, F.lit(k)) for k, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def null_counts(df: DataFrame) -> DataFrame:
    """Rows (column, n_null, n_rows) from one pass; NaN counts as missing."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    missing = lambda c: F.col(c).isNull() | F.isnan(c) if c in floats else F.col(c).isNull()
    one = df.agg(*[F.coalesce(F.sum(missing(c).cast("long")), F.lit(0)).alias(c) for c in df.columns], F.count("*").alias("n_rows"))
    return one.unpivot(["n_rows"], df.columns, "column_name", "n_null")


def rename_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def suffix_columns(df: DataFrame, suffix: str, but: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in df.columns if c not in but})


def without_mode(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value is not the most frequent one (of several, the lowest)."""
    mode = df.agg(F.mode(value, True).alias("__mode"))  # one row
    return df.crossJoin(F.broadcast(mode)).where(F.col(value) != F.col("__mode")).drop("__mode")


def apply_groups(df: DataFrame, by: list[str], f: Callable[[pd.DataFrame], dict | None], schema: str) -> DataFrame:
    """One row (by..., schema) from ``f`` of each group's rows; none where it gives None.

    A group meets in one task's memory, so groups must be small, as a unit's
    years are; what built-in aggregates can say is better said by them.  Rows
    come sorted by group, and ``f`` is called on slices of Arrow batches, as a
    batch and a frame for each group cost far more than ``f``.
    """
    kinds = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), schema])
    names = [f.name for f in T.StructType.fromDDL(schema)]
    columns, marks = df.columns, [(f"__key{n}", f"__null{n}") for n in range(len(by))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
            own, out = pdf[columns], []
            keys = [np.where(pdf[null], None, pdf[key].astype(object))[starts] for key, null in marks]
            for n, (at, upto) in enumerate(zip(starts, [*starts[1:], len(pdf)], strict=True)):
                rows = own.iloc[at:upto]
                rows.index = pd.RangeIndex(upto - at)
                if (value := f(rows)) is not None:
                    out.append([*(k[n] for k in keys), *[value[c] for c in names]])
            values = zip(*out, strict=True) if out else [()] * (len(by) + len(names))
            return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip([*by, *names], values, strict=True)})

        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            new = np.zeros(len(pdf), bool)
            new[0] = True
            for key, null in marks:
                k, none, missing = pdf[key].to_numpy(), pdf[key].isna().to_numpy(), pdf[null].to_numpy()
                other = (k[1:] != k[:-1]) & ~(none[1:] & none[:-1])
                new[1:] |= (other & ~missing[1:]) | (missing[1:] != missing[:-1])
            starts = np.flatnonzero(new)
            # The last group may go on in the next batch.
            if len(starts) > 1:
                yield found(pdf.iloc[: starts[-1]], starts[:-1])
            rest = pdf.iloc[starts[-1] :]
        if rest is not None:
            yield found(rest, np.zeros(1, np.int64))

    def key(c: str) -> Column:
        kind = df.schema[c].dataType
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return F.col(c) + F.lit(0).cast(kind)  # one zero
        # Whole numbers stay such beside a NULL.
        return F.coalesce(F.col(c), F.lit(0).cast(kind)) if isinstance(kind, T.IntegralType) else F.col(c)

    marked = df.withColumns({name: c for n, own in enumerate(by) for name, c in ((f"__key{n}", key(own)), (f"__null{n}", F.col(own).isNull()))})
    order = [c for key_, null in marks for c in (null, key_)]
    dealt = marked.repartition(*order).sortWithinPartitions(*order) if order else marked.coalesce(1)
    return dealt.mapInPandas(run, kinds)
