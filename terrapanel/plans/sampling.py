"""Sorting, top-k, samples and shards (O of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapanel.functions import seeded
from terrapanel.operators import splits, stats
from terrapanel.plans.registry import PANEL_SQL, panel, register, spread, table
from terrapanel.sources.scratch import folder


def _key(seed: int, *keys: str) -> str:
    return f"md5('{seed}|' || " + " || '|' || ".join(keys) + ")"


@register("O1_sort", "SELECT n_nationkey, n_name FROM nation ORDER BY n_regionkey, n_name")
def o1(spark, d):
    return table(spark, d, "nation").orderBy("n_regionkey", "n_name").select("n_nationkey", "n_name")


@register("O2_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def o2(spark, d):
    """A top-k report."""
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@register("O3_sample", f"SELECT c_custkey FROM customer ORDER BY {_key(7, 'c_custkey')}, c_custkey LIMIT 100")
def o3(spark, d):
    return seeded.sample_n(table(spark, d, "customer"), 100, 7, "c_custkey").select("c_custkey")


@register("O4_stratified_sample", f"SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY {_key(7, 'c_custkey')}, c_custkey) <= 3")
def o4(spark, d):
    return seeded.sample_per_group(table(spark, d, "customer"), ["c_nationkey"], 3, 7, "c_custkey").select("c_nationkey", "c_custkey")


@register(
    "O5_group_sample",
    f"""WITH {PANEL_SQL}, g AS (SELECT DISTINCT c_nationkey FROM customer ORDER BY {_key(3, 'c_nationkey')} LIMIT 7),
        b AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM g) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY {_key(4, 'c_custkey')}, c_custkey) = 1)
        SELECT unit_id, year FROM panel WHERE unit_id IN (SELECT c_custkey FROM b)""",
)
def o5(spark, d):
    """One unit, with all its years, of each of 30 % of the groups (25 nations)."""
    c = table(spark, d, "customer")
    groups = seeded.sample_n(c.select("c_nationkey").distinct(), 7, 3, "c_nationkey")
    one = seeded.sample_per_group(c.join(groups, "c_nationkey", "left_semi"), ["c_nationkey"], 1, 4, "c_custkey")
    return panel(spark, d).join(one.select(F.col("c_custkey").alias("unit_id")), "unit_id", "left_semi").select("unit_id", "year")


@register("O6_weighted_choice", f"SELECT p_partkey FROM part ORDER BY -ln((CAST(CAST('0x' || substr({_key(5, 'p_partkey')}, 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296) / p_retailprice, p_partkey LIMIT 20")
def o6(spark, d):
    """20 parts, by price, without replacement."""
    return table(spark, d, "part").orderBy(seeded.weighted_key(F.col("p_retailprice"), 5, F.col("p_partkey")), "p_partkey").limit(20).select("p_partkey")


def tracts(spark, d):
    """Suppliers as tracts of 100 x 100 on a lattice, with a quintile of their balance."""
    s = table(spark, d, "supplier")
    x, y = (F.col("s_suppkey") % 20) * 100.0, F.floor(F.col("s_suppkey") / 20) * 100.0
    return s.select("s_suppkey", x.alias("minx"), y.cast("double").alias("miny"), (x + 100.0).alias("maxx"), (y + 100.0).alias("maxy"), F.pmod("s_suppkey", F.lit(5)).alias("stratum"), F.lit(10000.0).alias("area"))


def polygon_tracts(spark, d):
    """The tracts as polygons that leave a margin of 10, a notch and a hole."""
    at = lambda c, far: F.col(f"min{c}") + far
    ring = lambda *points: F.array(*[F.struct(at("x", float(x)).alias("x"), at("y", float(y)).alias("y")) for x, y in [*points, points[0]]])
    outer = ring((10, 10), (90, 10), (90, 50), (50, 50), (50, 90), (10, 90))
    return tracts(spark, d).withColumn("parts", F.array(F.array(outer, ring((20, 20), (20, 30), (30, 30), (30, 20)))))


@register("O7_cluster_holdout")
def o7(spark, d):
    """Test and validation clusters with moats (an iterative choice, so no SQL)."""
    return splits.split_tracts(polygon_tracts(spark, d), "s_suppkey", "stratum", "area", 25.0, 50.0, 0.06, 11, "parts").select("s_suppkey", "type")


@register("O7_moats", "SELECT CAST(0 AS BIGINT) AS n_close, true AS shares_reached")
def o7_moats(spark, d):
    """What the split promises: no training tract within the moat of a held-out one, and each stratum's test share reached."""
    path = folder(spark, "split")
    splits.split_tracts(polygon_tracts(spark, d), "s_suppkey", "stratum", "area", 25.0, 50.0, 0.06, 11, "parts").write.parquet(path)
    t = spark.read.parquet(path)
    kind = t.select("s_suppkey", "type")
    # On the lattice, in closed form: 20 apart side by side, 28.3 along one diagonal, 63 along the other.
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [(0, 1), (1, 0), (0, -1), (-1, 0), (1, -1), (-1, 1)]])
    cells = t.select("s_suppkey", (F.col("minx") / 100).cast("int").alias("cx"), (F.col("miny") / 100).cast("int").alias("cy"))
    beside = cells.select(F.col("s_suppkey").alias("a"), "cx", "cy", F.explode(steps).alias("s")).select("a", (F.col("cx") + F.col("s.x")).alias("cx"), (F.col("cy") + F.col("s.y")).alias("cy"))
    near = beside.join(cells.withColumnRenamed("s_suppkey", "b"), ["cx", "cy"]).select("a", "b")
    close = near.join(kind.where("type = 'train'").select(F.col("s_suppkey").alias("a")), "a").join(kind.where("type IN ('test', 'val')").select(F.col("s_suppkey").alias("b")), "b")
    shares = t.groupBy("stratum").agg(F.avg((F.col("type") == "test").cast("int")).alias("share")).agg((F.min("share") >= 0.06).alias("shares_reached"))
    return close.agg(F.count("*").alias("n_close")).crossJoin(F.broadcast(shares))  # one row each


@register("O9_bootstrap")
def o9(spark, d):
    """Interval of the mean balance from 200 resamples."""
    own = spread(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    reps = stats.bootstrap_mean(own, ["c_custkey"], "c_acctbal", 200, 1)
    return stats.percentile_interval(reps, "mean")


@register(
    "O11_hybrid_batch",
    f"""WITH {PANEL_SQL}, core AS (SELECT unit_id, year FROM panel WHERE year = 1998 ORDER BY {_key(9, 'unit_id')}, unit_id LIMIT 50),
        t AS (SELECT p.unit_id, p.year FROM panel p JOIN core USING (unit_id) WHERE p.year <> 1998 QUALIFY row_number() OVER (PARTITION BY p.unit_id ORDER BY {_key(9, 'p.unit_id', 'p.year')}, p.year) <= 2)
        SELECT unit_id, year, true AS anchor FROM core UNION ALL SELECT unit_id, year, false FROM t""",
)
def o11(spark, d):
    """An anchor year's units with two other years of each."""
    p = panel(spark, d).select("unit_id", "year")
    core = seeded.sample_n(p.where("year = 1998"), 50, 9, "unit_id")
    twins = seeded.sample_per_group(p.where("year <> 1998").join(core.select("unit_id"), "unit_id", "left_semi"), ["unit_id"], 2, 9, "unit_id", "year")
    return core.withColumn("anchor", F.lit(True)).unionByName(twins.withColumn("anchor", F.lit(False)))


@register(
    "O12_shard",
    "WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS rn, count(*) OVER () AS n FROM customer) SELECT c_custkey FROM r WHERE (rn - 1400 + n) % n < 200",
)
def o12(spark, d):
    """A slice of 200 rows from row 1400 on that wraps around at the end.

    Row numbers come from counts of key ranges; only a range's rows are sorted together.
    """
    c = table(spark, d, "customer").select("c_custkey").withColumn("block", F.floor(F.col("c_custkey") / 100))
    sizes = c.groupBy("block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sizes.withColumn("before", before).crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("total"))))
    rn = F.col("before") + F.row_number().over(W.partitionBy("block").orderBy("c_custkey")) - 1
    return c.join(placed.drop("n"), "block").withColumn("rn", rn).where(F.pmod(F.col("rn") - 1400, F.col("total")) < 200).select("c_custkey")


@register("O13_capped_union", f"SELECT c_custkey FROM (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 ORDER BY {_key(2, 'c_custkey')}, c_custkey LIMIT 300) UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 2 = 1")
def o13(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    return seeded.sample_n(c.where("c_custkey % 2 = 0"), 300, 2, "c_custkey").unionByName(c.where("c_custkey % 2 = 1"))


@register("O14_group_shuffle", f"WITH {PANEL_SQL} SELECT unit_id, year FROM panel ORDER BY {_key(6, 'unit_id')}, unit_id, year")
def o14(spark, d):
    return panel(spark, d).orderBy(seeded.order_key(6, F.col("unit_id")), "unit_id", "year").select("unit_id", "year")
