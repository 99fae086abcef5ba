"""Joins (J of the inventory) but the spatial ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.operators import relational, stats
from terrapanel.plans.registry import PANEL_SQL, panel, register, table


@register("J1_inner", "SELECT o_orderkey, o_totalprice, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def j1(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return table(spark, d, "orders").join(c, "o_custkey").select("o_orderkey", "o_totalprice", "c_nationkey")


@register("J2_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000")
def j2(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return table(spark, d, "customer").select("c_custkey").join(big, "c_custkey", "left")


@register(
    "J3_outer",
    """SELECT coalesce(a.k, b.k) AS k, a.n AS n_customers, b.n AS n_suppliers FROM (SELECT c_nationkey AS k, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_nationkey < 20 GROUP BY 1) a
       FULL JOIN (SELECT s_nationkey AS k, CAST(count(*) AS BIGINT) AS n FROM supplier WHERE s_nationkey > 5 GROUP BY 1) b ON a.k = b.k""",
)
def j3(spark, d):
    a = table(spark, d, "customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_customers"))
    b = table(spark, d, "supplier").where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_suppliers"))
    return a.join(b, "k", "full")


@register(
    "J4_interval",
    """WITH p AS (SELECT l_partkey AS id, CAST(year(min(l_shipdate)) AS INT) AS built, CAST(year(max(l_shipdate)) AS INT) AS gone FROM lineitem GROUP BY 1)
       SELECT id, CAST(y AS INT) AS year FROM p, generate_series(1995, 2002) t(y) WHERE built <= y AND gone > y""",
)
def j4(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.year(F.min("l_shipdate")).alias("built"), F.year(F.max("l_shipdate")).alias("gone"))
    return relational.alive_years(p, range(1995, 2003), F.col("built"), F.col("gone")).select("id", "year")


@register("J5_on_id", "SELECT d.doc_id, lang, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j5(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")


@register("J6_checked", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j6(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return relational.checked_join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), n, ["c_nationkey"], "inner", "m:1").select("c_custkey", "n_name")


@register("J16_dense_grid", "SELECT c_nationkey, CAST(y AS INT) AS year FROM (SELECT DISTINCT c_nationkey FROM customer), generate_series(2010, 2024) t(y)")
def j16(spark, d):
    return relational.dense_grid(table(spark, d, "customer"), "c_nationkey", range(2010, 2025), "year")


@register(
    "J17_two_keys",
    f"""WITH {PANEL_SQL} SELECT c_custkey, CAST(y AS INT) AS grid_year, coalesce(n, 0) AS n FROM customer CROSS JOIN generate_series(1995, 1997) t(y) LEFT JOIN panel ON c_custkey = unit_id AND y = year""",
)
def j17(spark, d):
    grid = relational.dense_grid(table(spark, d, "customer"), "c_custkey", range(1995, 1998), "grid_year")
    p = panel(spark, d)
    return grid.join(p, (grid.c_custkey == p.unit_id) & (grid.grid_year == p.year), "left").select("c_custkey", "grid_year", F.coalesce("n", F.lit(0)).alias("n"))


@register("J18_twins", f"WITH {PANEL_SQL} SELECT a.unit_id, a.year, CAST(count(*) AS BIGINT) AS n_twins FROM panel a JOIN panel b ON a.unit_id = b.unit_id AND a.year <> b.year GROUP BY 1, 2")
def j18(spark, d):
    p = panel(spark, d).select("unit_id", "year")
    return p.join(p.withColumnRenamed("year", "other"), "unit_id").where("year <> other").groupBy("unit_id", "year").agg(F.count("*").alias("n_twins"))


@register(
    "J19_pairs",
    f"WITH {PANEL_SQL} SELECT a.unit_id, CAST(count(*) AS BIGINT) AS n_pairs, round(max(abs(b.value - a.value)), 6) AS largest FROM panel a JOIN panel b ON a.unit_id = b.unit_id AND a.year < b.year GROUP BY 1",
)
def j19(spark, d):
    pairs = stats.pairs_within(panel(spark, d), "unit_id", "year", ["value"])
    return pairs.groupBy("unit_id").agg(F.count("*").alias("n_pairs"), F.round(F.max(F.abs(F.col("b_value") - F.col("a_value"))), 6).alias("largest"))


@register("J20_mapping", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def j20(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, d, "supplier").join(n, "s_nationkey", "left").select("s_suppkey", "n_name")


@register(
    "J21_suffixes",
    "SELECT a.c_nationkey, a.m AS balance_customer, b.m AS balance_supplier FROM (SELECT c_nationkey, round(avg(c_acctbal), 6) AS m FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey, round(avg(s_acctbal), 6) AS m FROM supplier GROUP BY 1) b ON c_nationkey = s_nationkey",
)
def j21(spark, d):
    a = table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 6).alias("balance_customer"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.round(F.avg("s_acctbal"), 6).alias("balance_supplier"))
    return a.join(b, "c_nationkey")


@register("J22_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j22(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(big, "c_custkey", "left_anti").select("c_custkey")


@register("J24_first_match", "SELECT c_custkey, o.k AS first_order FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def j24(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("first_order"))
    return relational.first_match(table(spark, d, "customer").select("c_custkey"), orders, ["c_custkey"], ["first_order"], ["first_order"])


@register(
    "J25_thresholds",
    f"""WITH {PANEL_SQL}, u AS (SELECT unit_id, CAST(sum(n) AS BIGINT) AS n_new FROM panel GROUP BY 1)
        SELECT unit_id, n_new, level FROM u, (VALUES ('any', 1), ('multi', 8), ('dense', 12)) t(level, least) WHERE n_new >= least""",
)
def j25(spark, d):
    u = panel(spark, d).groupBy("unit_id").agg(F.sum("n").alias("n_new"))
    return relational.fan_out(u, "n_new", {"any": 1, "multi": 8, "dense": 12})


@register(
    "J26_anchor_twin",
    f"""WITH {PANEL_SQL} SELECT p.unit_id, p.year, round(p.value - a.value, 6) AS diff FROM panel p JOIN panel a ON p.unit_id = a.unit_id AND a.year = 1998 WHERE p.year <> 1998""",
)
def j26(spark, d):
    p = panel(spark, d)
    anchor = p.where("year = 1998").select("unit_id", F.col("value").alias("anchor"))
    own = relational.first_match(p.where("year <> 1998"), anchor, ["unit_id"], ["anchor"], ["anchor"], "inner")
    return own.select("unit_id", "year", F.round(F.col("value") - F.col("anchor"), 6).alias("diff"))


@register("U1_union_all", "SELECT o_orderkey AS id, o_totalprice AS v FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey < 100")
def u1(spark, d):
    o = table(spark, d, "orders")
    pick = lambda w: o.where(w).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    return pick("o_totalprice > 400000").unionByName(pick("o_custkey < 100"))


@register("U2_union_tag", "SELECT o_orderkey, 1996 AS tag FROM orders WHERE year(o_orderdate) = 1996 UNION ALL SELECT o_orderkey, 1998 FROM orders WHERE year(o_orderdate) = 1998")
def u2(spark, d):
    o = table(spark, d, "orders")
    return relational.stack({y: o.where(F.year("o_orderdate") == y).select("o_orderkey") for y in (1996, 1998)}, "tag")


@register("U3_id_sets", "(SELECT c_custkey AS id FROM customer WHERE c_acctbal > 9000 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 490000) INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def u3(spark, d):
    o = table(spark, d, "orders")
    rich = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("id"))
    ids = lambda w: o.where(w).select(F.col("o_custkey").alias("id"))
    return rich.union(ids("o_totalprice > 490000")).distinct().intersect(ids("o_orderstatus = 'F'"))


@register("U4_masks", "SELECT c_custkey, (c_acctbal > 0 AND NOT c_custkey % 2 = 0) OR c_nationkey = 3 AS m FROM customer")
def u4(spark, d):
    return table(spark, d, "customer").select("c_custkey", (((F.col("c_acctbal") > 0) & ~(F.col("c_custkey") % 2 == 0)) | (F.col("c_nationkey") == 3)).alias("m"))


@register("U5_catalog_union", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION SELECT r_regionkey + 100, r_name FROM region")
def u5(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return n.union(table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("k"), "r_name")).distinct()


@register(
    "U7_metric_rows",
    "SELECT 'orders' AS part, round(avg(o_totalprice), 6) AS mean, CAST(NULL AS BIGINT) AS n FROM orders UNION ALL SELECT 'customers', NULL, CAST(count(*) AS BIGINT) FROM customer",
)
def u7(spark, d):
    a = table(spark, d, "orders").agg(F.round(F.avg("o_totalprice"), 6).alias("mean"))
    return relational.stack({"orders": a, "customers": table(spark, d, "customer").agg(F.count("*").alias("n"))}, "part")
