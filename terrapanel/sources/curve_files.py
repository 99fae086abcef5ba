"""Tables of points or boxes laid out along a space-filling curve, so that a scan of a box reads few row groups."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.functions.curves import box_ranges, morton, steps

#: The column of curve numbers.
CURVE = "curve"


def _system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def write_along_curve(df: DataFrame, path: str, x: str, y: str, row_group_bytes: int = 16 << 20, parts: int | None = None) -> None:
    """df as Parquet in the order of the Morton numbers of (x, y), in ranges of about equal rows, with the layout in ``_curve.json``.

    Spark samples the ranges, so a crowded place is split like any other; within
    a file rows are sorted, so a row group's bounds of x, y and the curve are
    tight.  NULL coordinates stand at the lower bound.
    """
    spark = df.sparkSession
    e = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    low = [float(v) if v is not None else 0.0 for v in (e[0], e[2])]
    high = [float(v) if v is not None else 1.0 for v in (e[1], e[3])]
    number = morton(steps(F.col(x), low[0], high[0]), steps(F.col(y), low[1], high[1]))
    keyed = df.withColumn(CURVE, number)
    dealt = keyed.repartitionByRange(parts, CURVE) if parts else keyed.repartitionByRange(CURVE)
    dealt.sortWithinPartitions(CURVE).write.option("parquet.block.size", row_group_bytes).parquet(path)
    system, place = _system(spark, f"{path}/_curve.json")
    out = system.create(place, True)
    out.write(bytearray(json.dumps({"x": x, "y": y, "low": low, "high": high}).encode()))
    out.close()


def in_box(layout: dict, minx: float, miny: float, maxx: float, maxy: float) -> Column:
    """The condition of a box, ends included: ranges of the curve, which skip files and row groups, and the coordinates themselves."""
    low, high = layout["low"], layout["high"]
    top = (1 << 16) - 1

    def at(v: float, k: int) -> int:
        share = (v - low[k]) / ((high[k] - low[k]) or 1.0)
        return math.floor(max(0.0, min(1.0, share)) * top)

    found = F.lit(False)
    for first, last in box_ranges(at(minx, 0), at(miny, 1), at(maxx, 0), at(maxy, 1)):
        found = found | F.col(CURVE).between(first, last)
    return found & F.col(layout["x"]).between(minx, maxx) & F.col(layout["y"]).between(miny, maxy)


def read_box(spark: SparkSession, path: str, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """The rows of a box, without the column of the curve."""
    system, place = _system(spark, f"{path}/_curve.json")
    stream = system.open(place)
    layout = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    stream.close()
    return spark.read.parquet(path).where(in_box(layout, minx, miny, maxx, maxy)).drop(CURVE)
