import glob

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from terrapanel.functions.curves import box_ranges, morton
from terrapanel.sources.curve_files import read_box, write_along_curve


def interleaved(x, y, bits=16):
    return sum(((x >> k & 1) << 2 * k) | ((y >> k & 1) << 2 * k + 1) for k in range(bits))


def test_numbers_and_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(int(x), int(y)) for x, y in rng.integers(0, 65536, (200, 2))]
    got = spark.createDataFrame(rows, "x long, y long").select(morton(F.col("x"), F.col("y")).alias("m")).collect()
    assert [r.m for r in got] == [interleaved(x, y) for x, y in rows]
    for _ in range(20):
        (x0, x1), (y0, y1) = np.sort(rng.integers(0, 65536, (2, 2)), axis=1).tolist()
        ranges = box_ranges(x0, y0, x1, y1)
        assert len(ranges) <= 32 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
        inside = [(int(x), int(y)) for x, y in zip(rng.integers(x0, x1 + 1, 100), rng.integers(y0, y1 + 1, 100), strict=True)]
        assert all(any(a <= interleaved(x, y) <= b for a, b in ranges) for x, y in inside)
    small = [box_ranges(x, y, x + 3, y + 2, size=1, most=64) for x in range(0, 250, 17) for y in range(0, 250, 13)]
    assert all(sum(b - a + 1 for a, b in r) == 12 for r in small)


def test_a_box_reads_few_row_groups(spark, tmp_path):
    df = spark.range(60_000).select("id", (F.rand(1) * 1000).alias("x"), (F.rand(2) * 500 - 250).alias("y"))
    df = df.withColumn("x", F.when(F.col("id") % 3 == 0, 10.0).otherwise(F.col("x"))).withColumn("text", F.repeat(F.md5(F.col("id").cast("string")), 8)).cache()
    path = f"{tmp_path}/points"
    write_along_curve(df, path, "x", "y", row_group_bytes=200_000, parts=12)
    box = (300.0, -40.0, 420.0, 30.0)
    want = {r.id for r in df.where("x BETWEEN 300 AND 420 AND y BETWEEN -40 AND 30").collect()}
    found = read_box(spark, path, *box)
    assert {r.id for r in found.collect()} == want and found.columns == ["id", "x", "y", "text"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "OrEqual(curve" in plan and "PushedFilters" in plan
    groups = touched = 0
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        names = meta.schema.to_arrow_schema().names
        for g in range(meta.num_row_groups):
            bounds = {c: meta.row_group(g).column(names.index(c)).statistics for c in ("x", "y")}
            groups += 1
            touched += bounds["x"].min <= box[2] and bounds["x"].max >= box[0] and bounds["y"].min <= box[3] and bounds["y"].max >= box[1]
    assert groups >= 20 and touched <= groups / 4
    write_along_curve(df.limit(0), f"{tmp_path}/none", "x", "y")
    assert read_box(spark, f"{tmp_path}/none", *box).count() == 0
