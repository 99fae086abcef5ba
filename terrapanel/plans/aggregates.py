"""Aggregations (A of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.functions.bins import histogram_bin
from terrapanel.functions.moments import excess_kurtosis, r_squared, skew
from terrapanel.functions.numeric import first_at_or_after
from terrapanel.functions.quantiles import group_quantiles
from terrapanel.operators import geometry, polygons, relational, stats
from terrapanel.operators import panel as panel_ops
from terrapanel.plans.registry import PANEL_SQL, panel, register, table

YEARS = list(range(1995, 2002))


@register(
    "A1_unit_mean_std",
    "SELECT o_custkey AS unit_id, round(avg(o_totalprice), 6) AS mean_value, round(stddev_samp(o_totalprice), 6) AS std_value, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1",
)
def a1(spark, d):
    """Mean and sample standard deviation of a score per unit."""
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("unit_id")).agg(F.round(F.avg("o_totalprice"), 6).alias("mean_value"), F.round(F.stddev_samp("o_totalprice"), 6).alias("std_value"), F.count("*").alias("n"))


@register("A2_sums", "SELECT l_returnflag, l_linestatus, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1, 2")
def a2(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).cast("double").alias("quantity"))


@register("A3_change_year", f"WITH {PANEL_SQL} SELECT unit_id, CAST(coalesce(min(CASE WHEN value > 400000 THEN year END), 0) AS INT) AS change_year FROM panel GROUP BY 1")
def a3(spark, d):
    return panel_ops.first_year_over(panel(spark, d), "unit_id", "year", "value", 400000, "change_year")


@register("A4_first_panel_year", "SELECT o_orderkey, CAST(CASE WHEN y <= 1996 THEN 1996 WHEN y <= 1998 THEN 1998 WHEN y <= 2000 THEN 2000 END AS INT) AS panel_year FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)")
def a4(spark, d):
    return table(spark, d, "orders").select("o_orderkey", first_at_or_after(F.year("o_orderdate"), [1996, 1998, 2000]).alias("panel_year"))


@register("A5_counts", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS n_users FROM events GROUP BY 1")
def a5(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


@register("A6_keep_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def a6(spark, d):
    return relational.keep_first(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@register("A7_duplicates", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1")
def a7(spark, d):
    return relational.duplicates(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"])


_WIDE = ", ".join(f"round(min(CASE WHEN year = {y} THEN value END), 6) AS value_{y}" for y in YEARS)


@register("A8_pivot", f"WITH {PANEL_SQL} SELECT unit_id, {_WIDE} FROM panel GROUP BY 1")
def a8(spark, d):
    return relational.pivot_first(panel(spark, d).withColumn("value", F.round("value", 6)), ["unit_id"], "year", YEARS, "value", "value_")


@register("A9_unpivot", "SELECT p_partkey, 'size' AS name, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def a9(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return relational.unpivot(p, ["p_partkey"], ["size", "price"], "name", "value")


@register("A10_crosstab", "SELECT o_orderstatus, round(avg(CAST(o_orderpriority = '1-URGENT' AS INT)), 6) AS \"share_1-URGENT\", round(avg(CAST(o_orderpriority = '5-LOW' AS INT)), 6) AS \"share_5-LOW\" FROM orders GROUP BY 1")
def a10(spark, d):
    out = relational.crosstab_shares(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", ["1-URGENT", "5-LOW"])
    return out.select("o_orderstatus", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in out.columns[1:]])


@register("A11_quantiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS q10, round(quantile_cont(l_extendedprice, 0.9), 6) AS q90 FROM lineitem GROUP BY 1")
def a11(spark, d):
    q = group_quantiles(table(spark, d, "lineitem"), "l_extendedprice", [0.1, 0.9], ["l_returnflag"], "q")
    return q.select("l_returnflag", F.round(F.col("q")[0], 6).alias("q10"), F.round(F.col("q")[1], 6).alias("q90"))


@register(
    "A12_spread",
    """WITH m AS (SELECT o_orderpriority AS p, o_totalprice AS v, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS mean FROM orders)
       SELECT p, round(median(v), 6) AS median, round(median(abs(v - mean)), 6) AS mad, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(avg(CAST(v - mean > 0 AS INT)), 6) AS share_positive FROM m GROUP BY 1""",
)
def a12(spark, d):
    own = table(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("v"))
    mean = own.groupBy("p").agg(F.avg("v").alias("mean"))
    far = own.join(mean, "p").withColumns({"far": F.abs(F.col("v") - F.col("mean")), "up": (F.col("v") - F.col("mean") > 0).cast("int")})
    # Values and their distances from the mean are counted side by side.
    each = F.explode(F.array(F.struct(F.lit("v").alias("c"), F.col("v").alias("x")), F.struct(F.lit("far").alias("c"), F.col("far").alias("x")))).alias("e")
    q = group_quantiles(far.select("p", each).select("p", "e.c", "e.x"), "x", [0.25, 0.5, 0.75], ["p", "c"], "q")
    at = lambda c, k: F.max(F.when(F.col("c") == c, F.col("q")[k]))
    q = q.groupBy("p").agg(F.round(at("v", 1), 6).alias("median"), F.round(at("far", 1), 6).alias("mad"), F.round(at("v", 2) - at("v", 0), 6).alias("iqr"))
    share = far.groupBy("p").agg(F.round(F.avg("up"), 6).alias("share_positive"))
    return q.join(share, "p")


@register(
    "A13_moments",
    """WITH m AS (SELECT o_orderpriority AS p, o_totalprice AS v, avg(o_totalprice) OVER w AS mean, stddev_samp(o_totalprice) OVER w AS sd FROM orders WINDOW w AS (PARTITION BY o_orderpriority))
       SELECT p, round(avg(pow((v - mean) / sd, 3)), 6) AS skew, round(avg(pow((v - mean) / sd, 4)) - 3, 6) AS kurt FROM m GROUP BY 1""",
)
def a13(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.round(skew(F.col("o_totalprice")), 6).alias("skew"), F.round(excess_kurtosis(F.col("o_totalprice")), 6).alias("kurt"))


@register("A14_correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(pow(corr(l_quantity, l_extendedprice), 2), 6) AS r2 FROM lineitem GROUP BY 1")
def a14(spark, d):
    r = F.corr("l_quantity", "l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(r, 6).alias("r"), F.round(r * r, 6).alias("r2"))


@register("A15_mean_change", f"WITH {PANEL_SQL}, x AS (SELECT unit_id, value - lag(value) OVER (PARTITION BY unit_id ORDER BY year) AS diff, n > 1 AS flag FROM panel) SELECT flag, round(avg(abs(diff)), 4) AS mean_change FROM x WHERE diff IS NOT NULL GROUP BY 1")
def a15(spark, d):
    from pyspark.sql import Window as W

    diff = F.col("value") - F.lag("value").over(W.partitionBy("unit_id").orderBy("year"))
    own = panel(spark, d).select((F.col("n") > 1).alias("flag"), diff.alias("diff")).where("diff IS NOT NULL")
    return own.groupBy("flag").agg(F.round(F.avg(F.abs("diff")), 4).alias("mean_change"))


@register(
    "A16_r2",
    "SELECT c_nationkey, round(1 - sum(pow(c_acctbal - c_custkey, 2)) / nullif((count(*) - 1) * var_samp(c_acctbal), 0), 4) AS r2, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1",
)
def a16(spark, d):
    e = F.col("c_acctbal") - F.col("c_custkey")
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(r_squared(e * e, F.col("c_acctbal")), 4).alias("r2"), F.count("*").alias("n"))


@register("A17_group_transform", "SELECT c_custkey, round(avg(c_acctbal) OVER w, 6) AS m, round(stddev_samp(c_acctbal) OVER w, 6) AS s FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def a17(spark, d):
    c = table(spark, d, "customer")
    stats_ = c.groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 6).alias("m"), F.round(F.stddev_samp("c_acctbal"), 6).alias("s"))
    return c.join(stats_, "c_nationkey").select("c_custkey", "m", "s")


@register(
    "A18_dissolve",
    """WITH p AS (SELECT n_nationkey AS k, n_regionkey AS r, n_name, n_nationkey % 5 AS x, n_nationkey // 5 AS y FROM nation),
       shared AS (SELECT a.r, count(*) AS m FROM p a JOIN p b ON a.r = b.r AND (a.x + 1 = b.x AND a.y = b.y OR a.x = b.x AND a.y + 1 = b.y) GROUP BY 1)
       SELECT p.r AS n_regionkey, CAST(count(*) AS BIGINT) AS n_parts, string_agg(n_name, ',' ORDER BY n_name) AS names, CAST(count(*) AS DOUBLE) AS area, CAST(4 * count(*) - 2 * coalesce(any_value(m), 0) AS DOUBLE) AS perimeter
       FROM p LEFT JOIN shared ON shared.r = p.r GROUP BY 1""",
)
def a18(spark, d):
    """Nations as squares of a lattice: their regions' parts, area and outer boundary."""
    x, y = F.col("n_nationkey") % 5, F.floor(F.col("n_nationkey") / 5)
    n = table(spark, d, "nation").withColumn("shape", polygons.as_parts(F.array(geometry.box_ring(x, y, x + 1, y + 1))))
    names = n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))
    length = F.sqrt(F.pow(F.col("ax") - F.col("bx"), F.lit(2)) + F.pow(F.col("ay") - F.col("by_"), F.lit(2)))
    around = polygons.dissolved_edges(n, ["n_regionkey"], "shape").groupBy("n_regionkey").agg(F.sum(length).alias("perimeter"))
    whole = polygons.dissolve(n, ["n_regionkey"], "shape").select("n_regionkey", F.size("parts").cast("long").alias("n_parts"), "area")
    return whole.join(names, "n_regionkey").join(around, "n_regionkey").select("n_regionkey", "n_parts", "names", "area", "perimeter")


@register("A19_any_all", "SELECT o_custkey, bool_or(o_totalprice > 490000) AS any_big, bool_and(o_totalprice > 20000) AS all_big FROM orders GROUP BY 1")
def a19(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_totalprice") > 490000).alias("any_big"), F.bool_and(F.col("o_totalprice") > 20000).alias("all_big"))


@register(
    "A20_null_audit",
    """SELECT column_name, CAST(n_null AS BIGINT) AS n_null, CAST(n AS BIGINT) AS n_rows FROM (SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 7 = 0) AS a, count(*) FILTER (WHERE c_acctbal <= 0) AS b FROM customer),
       LATERAL (VALUES ('k', a), ('log_balance', b)) t(column_name, n_null)""",
)
def a20(spark, d):
    c = table(spark, d, "customer").select(F.nullif(F.col("c_custkey") % 7, F.lit(0)).alias("k"), F.when(F.col("c_acctbal") > 0, F.ln("c_acctbal")).otherwise(float("nan")).alias("log_balance"))
    return relational.null_counts(c)


@register("A21_coverage", "SELECT c_mktsegment, round(avg(CAST(c_acctbal > 0 AS INT)), 6) AS share FROM customer GROUP BY 1")
def a21(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(F.avg((F.col("c_acctbal") > 0).cast("double")), 6).alias("share"))


@register(
    "A22_icc",
    f"""WITH {PANEL_SQL}, u AS (SELECT avg(value) AS m, var_pop(value) AS v FROM panel GROUP BY unit_id HAVING count(*) >= 2)
        SELECT round(var_pop(m) / (var_pop(m) + avg(v)), 6) AS icc, CAST(count(*) AS BIGINT) AS n_units FROM u""",
)
def a22(spark, d):
    return stats.intraclass(panel(spark, d), "unit_id", "value").select(F.round("icc", 6).alias("icc"), "n_units")


@register("A23_arg_extremes", f"WITH {PANEL_SQL} SELECT unit_id, arg_max(year, value) AS best_year, arg_min(year, value) AS worst_year FROM panel GROUP BY 1")
def a23(spark, d):
    return panel(spark, d).groupBy("unit_id").agg(F.max_by("year", "value").alias("best_year"), F.min_by("year", "value").alias("worst_year"))


@register("A24_histogram", "SELECT CAST(least(floor((value - 0) * 20 / 500), 19) AS INT) AS bin, CAST(count(*) AS BIGINT) AS n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1")
def a24(spark, d):
    return table(spark, d, "events").withColumn("bin", histogram_bin(F.col("value"), 0, 500, 20)).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))


@register(
    "A24_density",
    """WITH s AS (SELECT stddev_samp(s_acctbal) * pow(count(*), -0.2) AS h, count(*) AS n FROM supplier)
       SELECT CAST(g * 500 - 1000 AS BIGINT) AS x, round(1e6 * avg(exp(-0.5 * pow((g * 500 - 1000 - s_acctbal) / h, 2))) / max(h * sqrt(2 * pi())), 6) AS density
       FROM generate_series(0, 23) t(g), supplier, s GROUP BY 1""",
)
def a24_density(spark, d):
    """Gaussian kernel density on a grid, with Scott's bandwidth."""
    s = table(spark, d, "supplier")
    h = s.agg((F.stddev_samp("s_acctbal") * F.pow(F.count("*"), F.lit(-0.2))).alias("h"))  # one row
    grid = F.explode(F.sequence(F.lit(-1000).cast("long"), F.lit(10500).cast("long"), F.lit(500).cast("long")))
    u = (F.col("x") - F.col("s_acctbal")) / F.col("h")
    kernel = F.avg(F.exp(u * u * -0.5)) / F.max(F.col("h") * F.sqrt(F.lit(2) * F.pi()))
    return s.crossJoin(F.broadcast(h)).withColumn("x", grid).groupBy("x").agg(F.round(kernel * 1e6, 6).alias("density"))


@register("A25_regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem GROUP BY 1")
def a25(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 3).alias("intercept"))


@register(
    "A26_polynomial",
    """WITH v AS (SELECT c_nationkey AS g, year(o_orderdate) - 1998.0::DOUBLE AS x, avg(o_totalprice) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
       a AS (SELECT *, avg(x) OVER w AS m1, avg(x * x) OVER w AS m2, avg(x * x * x) OVER w AS m3, avg(y) OVER w AS my, count(*) OVER w AS k FROM v WINDOW w AS (PARTITION BY g)),
       b AS (SELECT *, x - m1 AS p1 FROM a), c AS (SELECT *, sum(x * x * p1) OVER w / sum(p1 * p1) OVER w AS q FROM b WINDOW w AS (PARTITION BY g)),
       d AS (SELECT *, x * x - m2 - q * p1 AS p2, sum(x * x * x * p1) OVER w / sum(p1 * p1) OVER w AS c31 FROM c WINDOW w AS (PARTITION BY g)),
       e AS (SELECT *, sum(x * x * x * p2) OVER w / sum(p2 * p2) OVER w AS c32 FROM d WINDOW w AS (PARTITION BY g)), f AS (SELECT *, x * x * x - m3 - c31 * p1 - c32 * p2 AS p3 FROM e),
       h AS (SELECT g, any_value(k) AS k, any_value(m1) AS m1, any_value(m2) AS m2, any_value(m3) AS m3, any_value(my) AS my, any_value(q) AS q, any_value(c31) AS c31, any_value(c32) AS c32,
             sum(y * p1) / sum(p1 * p1) AS b1, sum(y * p2) / sum(p2 * p2) AS b2, sum(y * p3) / sum(p3 * p3) AS b3 FROM f GROUP BY 1)
       SELECT g AS c_nationkey, CASE WHEN k >= 4 THEN [round(b3, 3), round(b2 - b3 * c32, 3), round(b1 - b2 * q + b3 * (c32 * q - c31), 3), round(my - b1 * m1 + b2 * (q * m1 - m2) + b3 * (c31 * m1 + c32 * m2 - c32 * q * m1 - m3), 3)] END AS coef FROM h""",
)
def a26(spark, d):
    """Cubic through a nation's yearly means (seven points)."""
    means = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").groupBy("c_nationkey", (F.year("o_orderdate") - 1998).alias("x")).agg(F.avg("o_totalprice").alias("y"))
    return stats.polynomial_fit(means, ["c_nationkey"], "x", "y", 3).select("c_nationkey", F.transform("coef", lambda c: F.round(c, 3)).alias("coef"))


@register("A27_id_lists", f"WITH {PANEL_SQL} SELECT unit_id, string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) AS years FROM panel GROUP BY 1 HAVING count(*) >= 2")
def a27(spark, d):
    return panel(spark, d).groupBy("unit_id").agg(F.array_join(F.array_sort(F.collect_list("year")), ",").alias("years"), F.count("*").alias("n")).where("n >= 2").drop("n")


@register("A28_extent", "SELECT round(CAST(min(embedding[1]) AS DOUBLE), 6) AS minx, round(CAST(max(embedding[1]) AS DOUBLE), 6) AS maxx, round(CAST(min(embedding[2]) AS DOUBLE), 6) AS miny, round(CAST(max(embedding[2]) AS DOUBLE), 6) AS maxy FROM embeddings")
def a28(spark, d):
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return table(spark, d, "embeddings").agg(F.round(F.min(x), 6).alias("minx"), F.round(F.max(x), 6).alias("maxx"), F.round(F.min(y), 6).alias("miny"), F.round(F.max(y), 6).alias("maxy"))


@register("A29_year_bands", f"WITH {PANEL_SQL} SELECT year, round(median(value), 6) AS median, round(quantile_cont(value, 0.25), 6) AS low, round(quantile_cont(value, 0.75), 6) AS high FROM panel GROUP BY 1")
def a29(spark, d):
    q = group_quantiles(panel(spark, d), "value", [0.5, 0.25, 0.75], ["year"], "q")
    return q.select("year", *[F.round(F.col("q")[k], 6).alias(c) for k, c in enumerate(("median", "low", "high"))])


@register(
    "A30_long_difference",
    f"""WITH {PANEL_SQL}, w AS (SELECT unit_id, max(CASE WHEN year = 2000 THEN value END) - max(CASE WHEN year = 1996 THEN value END) AS dv, max(CASE WHEN year = 2000 THEN n END) - max(CASE WHEN year = 1996 THEN n END) AS dn FROM panel GROUP BY 1)
        SELECT round(regr_slope(dv, dn), 3) AS slope, round(corr(dv, dn), 6) AS r, CAST(count(*) AS BIGINT) AS n FROM w WHERE dv IS NOT NULL""",
)
def a30(spark, d):
    at = lambda c, y: F.max(F.when(F.col("year") == y, F.col(c)))
    w = panel(spark, d).groupBy("unit_id").agg((at("value", 2000) - at("value", 1996)).alias("dv"), (at("n", 2000) - at("n", 1996)).alias("dn")).where("dv IS NOT NULL")
    return w.agg(F.round(F.regr_slope("dv", "dn"), 3).alias("slope"), F.round(F.corr("dv", "dn"), 6).alias("r"), F.count("*").alias("n"))


@register(
    "A31_tract_error",
    """WITH t AS (SELECT c_nationkey, avg(c_acctbal) AS truth, avg(c_custkey) AS score FROM customer GROUP BY 1)
       SELECT round(avg(pow(truth - score, 2)), 3) AS mse, round(1 - avg(pow(truth - score, 2)) / var_samp(truth), 6) AS r2 FROM t""",
)
def a31(spark, d):
    t = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("truth"), F.avg("c_custkey").alias("score"))
    e = F.pow(F.col("truth") - F.col("score"), F.lit(2.0))
    return t.agg(F.round(F.avg(e), 3).alias("mse"), F.round(1 - F.avg(e) / F.var_samp("truth"), 6).alias("r2"))


@register(
    "A32_metric_table",
    "SELECT c_mktsegment, CAST(ntile AS INT) AS half, CAST(count(*) AS BIGINT) AS n, round(corr(c_acctbal, c_custkey), 6) AS r FROM (SELECT *, CASE WHEN c_acctbal > 4500 THEN 1 ELSE 0 END AS ntile FROM customer) GROUP BY 1, 2",
)
def a32(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment", (F.col("c_acctbal") > 4500).cast("int").alias("half")).agg(F.count("*").alias("n"), F.round(F.corr("c_acctbal", "c_custkey"), 6).alias("r"))


@register("A33_density_2d", "SELECT CAST(least(floor(l_quantity * 5 / 50), 4) AS INT) AS bx, CAST(least(floor(l_discount * 4 / 0.1), 3) AS INT) AS b_y, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_discount BETWEEN 0 AND 0.1 GROUP BY 1, 2")
def a33(spark, d):
    own = table(spark, d, "lineitem").select(histogram_bin(F.col("l_quantity"), 0, 50, 5).alias("bx"), histogram_bin(F.col("l_discount"), 0, 0.1, 4).alias("b_y"))
    return own.where("bx IS NOT NULL AND b_y IS NOT NULL").groupBy("bx", "b_y").agg(F.count("*").alias("n"))
