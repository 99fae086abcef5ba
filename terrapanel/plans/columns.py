"""Projections, derived columns and filters (P and F of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.functions import numeric
from terrapanel.functions.special import two_sided_p
from terrapanel.operators import relational
from terrapanel.plans.registry import PANEL_SQL, panel, register, table, two_sided_p_sql


@register("P1_prune", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def p1(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


@register("P2_suffix_rename", "SELECT c_custkey, c_name AS c_name_2024, c_nationkey AS c_nationkey_2024, c_acctbal AS c_acctbal_2024, c_mktsegment AS c_mktsegment_2024 FROM customer")
def p2(spark, d):
    return relational.suffix_columns(table(spark, d, "customer"), "_2024", ["c_custkey"])


@register("P3_rename_present", "SELECT s_suppkey AS supplier_id, s_name AS name, s_nationkey, s_acctbal FROM supplier")
def p3(spark, d):
    return relational.rename_present(table(spark, d, "supplier"), {"s_suppkey": "supplier_id", "s_name": "name", "absent": "x"})


@register(
    "P4_guarded_ratio",
    "SELECT o_orderkey, round(100.0 * o_totalprice / nullif(CAST(o_custkey % 5 AS DOUBLE), 0), 6) AS pct FROM orders",
)
def p4(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(numeric.ratio(F.col("o_totalprice"), (F.col("o_custkey") % 5).cast("double"), 100), 6).alias("pct"))


@register(
    "P5_weighted_mean",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       round((coalesce(l_quantity, 0) * 2.5 + coalesce(nullif(l_tax, 0), 0) * 7.0 + coalesce(l_discount, 0) * 12.0) / nullif(l_quantity + l_tax + l_discount, 0), 6) AS mean_age
       FROM lineitem""",
)
def p5(spark, d):
    li = table(spark, d, "lineitem")
    values = [(F.col("l_quantity"), 2.5), (F.nullif("l_tax", F.lit(0.0)), 7.0), (F.col("l_discount"), 12.0)]
    total = F.col("l_quantity") + F.col("l_tax") + F.col("l_discount")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(numeric.weighted_mean(values, total), 6).alias("mean_age"))


@register("P6_metadata", "SELECT s_suppkey, 2024 AS acs_year, '2020-2024' AS acs_span, 'nation ' || s_nationkey AS place FROM supplier")
def p6(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.lit(2024).alias("acs_year"), F.lit("2020-2024").alias("acs_span"), F.concat(F.lit("nation "), F.col("s_nationkey")).alias("place"))


@register("P7_padded_key", "SELECT c_custkey, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS geoid FROM customer")
def p7(spark, d):
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    return table(spark, d, "customer").select("c_custkey", F.concat(pad("c_nationkey", 3), pad("c_custkey", 8)).alias("geoid"))


@register(
    "P8_coerce_sentinel",
    """SELECT c_custkey, nullif(try_cast(CASE WHEN c_custkey % 7 = 0 THEN '-666666666' WHEN c_custkey % 11 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END AS DOUBLE), -666666666) AS value FROM customer""",
)
def p8(spark, d):
    raw = F.when(F.col("c_custkey") % 7 == 0, "-666666666").when(F.col("c_custkey") % 11 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    return table(spark, d, "customer").select("c_custkey", numeric.numeric_or_null(raw).alias("value"))


@register("P10_sentinel_fill", "SELECT o_orderkey, coalesce(nullif(o_custkey % 4, 0), 0) AS built, coalesce(nullif(o_custkey % 3, 0), 2999) AS gone FROM orders")
def p10(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.nullif(F.col("o_custkey") % 4, F.lit(0)), F.lit(0)).alias("built"), F.coalesce(F.nullif(F.col("o_custkey") % 3, F.lit(0)), F.lit(2999)).alias("gone"))


@register(
    "P11_nearest_year",
    """SELECT o_orderkey, CAST(CASE WHEN abs(y - 1996) <= abs(y - 1998) AND abs(y - 1996) <= abs(y - 2001) THEN 1996
       WHEN abs(y - 1998) <= abs(y - 2001) THEN 1998 ELSE 2001 END AS INT) AS vintage FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)""",
)
def p11(spark, d):
    return table(spark, d, "orders").select("o_orderkey", numeric.nearest(F.year("o_orderdate"), [1996, 1998, 2001]).alias("vintage"))


@register(
    "P12_case_label",
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS label FROM customer",
)
def p12(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "low").otherwise("high").alias("label"))


@register(
    "P13_last_label_wins",
    "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'val' WHEN c_custkey % 3 = 0 THEN 'test' WHEN c_acctbal < 0 THEN 'dead_zone' ELSE 'train' END AS type FROM customer",
)
def p13(spark, d):
    rules = [(F.col("c_acctbal") < 0, "dead_zone"), (F.col("c_custkey") % 3 == 0, "test"), (F.col("c_custkey") % 5 == 0, "val")]
    return table(spark, d, "customer").select("c_custkey", numeric.last_label_wins(rules, "train").alias("type"))


@register(
    "P14_inverse_variance",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CASE WHEN l_tax > 0 AND l_discount > 0 THEN (l_quantity / (l_tax * l_tax) + l_extendedprice / (l_discount * l_discount)) / (1 / (l_tax * l_tax) + 1 / (l_discount * l_discount))
       WHEN l_tax > 0 THEN l_quantity WHEN l_discount > 0 THEN l_extendedprice END, 4) AS label FROM lineitem""",
)
def p14(spark, d):
    wa, wb = F.try_divide(F.lit(1.0), F.col("l_tax") * F.col("l_tax")), F.try_divide(F.lit(1.0), F.col("l_discount") * F.col("l_discount"))
    both = (F.col("l_quantity") * wa + F.col("l_extendedprice") * wb) / (wa + wb)
    label = F.when((F.col("l_tax") > 0) & (F.col("l_discount") > 0), both).when(F.col("l_tax") > 0, F.col("l_quantity")).when(F.col("l_discount") > 0, F.col("l_extendedprice"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(label, 4).alias("label"))


@register("P15_errors", "SELECT p_partkey, round(pow(p_retailprice - p_size, 2), 6) AS squared, round(p_retailprice - p_size, 6) AS signed FROM part")
def p15(spark, d):
    e = F.col("p_retailprice") - F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.round(e * e, 6).alias("squared"), F.round(e, 6).alias("signed"))


@register("P16_dense_code", "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INT) AS code FROM part")
def p16(spark, d):
    part = table(spark, d, "part")
    codes = part.select("p_type").distinct().withColumn("code", F.row_number().over(_over("p_type")) - 1)  # as many rows as there are types
    return part.join(codes, "p_type").select("p_partkey", "code")


def _over(*order):
    from pyspark.sql import Window as W

    return W.orderBy(*order)


@register("P17_event_time", "SELECT o_orderkey, CAST((year(o_orderdate) - 1995) // 2 AS BIGINT) AS period FROM orders")
def p17(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.floor((F.year("o_orderdate") - 1995) / 2).alias("period"))


@register(
    "P18_parse_pair",
    """SELECT event_id, try_cast(regexp_extract(pair, '\\(([^,]+),\\s*([^)]+)\\)', 1) AS DOUBLE) AS x, try_cast(regexp_extract(pair, '\\(([^,]+),\\s*([^)]+)\\)', 2) AS DOUBLE) AS y
       FROM (SELECT event_id, '(' || value || ', ' || user_id || ')' AS pair FROM events)""".replace("\\\\", "\\"),
)
def p18(spark, d):
    pair = F.concat(F.lit("("), F.col("value").cast("string"), F.lit(", "), F.col("user_id").cast("string"), F.lit(")"))
    parts = F.split(F.regexp_replace(pair, r"[()\s]", ""), ",")
    return table(spark, d, "events").select("event_id", parts[0].try_cast("double").alias("x"), parts[1].try_cast("double").alias("y"))


@register("P19_string_prefix", "SELECT p_partkey, substr(p_name, 2, 4) AS piece, starts_with(p_brand, 'Brand#1') OR starts_with(p_brand, 'Brand#2') AS wanted FROM part")
def p19(spark, d):
    return table(spark, d, "part").select("p_partkey", F.substring("p_name", 2, 4).alias("piece"), (F.col("p_brand").startswith("Brand#1") | F.col("p_brand").startswith("Brand#2")).alias("wanted"))


@register("P20_quadkey_prefix", "SELECT left(lpad(CAST(c_custkey AS VARCHAR), 12, '0'), 9) AS tile, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1")
def p20(spark, d):
    return table(spark, d, "customer").groupBy(F.expr("left(lpad(cast(c_custkey as string), 12, '0'), 9)").alias("tile")).agg(F.count("*").alias("n"))


@register(
    "F1_alive_in_year",
    """WITH p AS (SELECT l_partkey AS id, CAST(year(min(l_shipdate)) AS INT) AS built, CAST(year(max(l_shipdate)) AS INT) AS gone FROM lineitem GROUP BY 1)
       SELECT id, built, gone FROM p WHERE built <= 1998 AND gone > 1998""",
)
def f1(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.year(F.min("l_shipdate")).alias("built"), F.year(F.max("l_shipdate")).alias("gone"))
    return p.where("built <= 1998 AND gone > 1998")


@register("F2_between", "SELECT o_orderkey, o_totalprice > 100000 AND o_totalprice <= 200000 AS half_open, o_totalprice BETWEEN 100000 AND 200000 AS closed FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999")
def f2(spark, d):
    v = F.col("o_totalprice")
    return table(spark, d, "orders").where(F.year("o_orderdate").between(1996, 1999)).select("o_orderkey", ((v > 100000) & (v <= 200000)).alias("half_open"), v.between(100000, 200000).alias("closed"))


@register("F3_gone_after", "SELECT o_orderkey, nullif(o_custkey % 9, 0) AS gone FROM orders WHERE nullif(o_custkey % 9, 0) > 4")
def f3(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 9, F.lit(0)).alias("gone")).where("gone > 4")


@register("F4_drop_sentinel_id", "SELECT c_custkey, c_name FROM customer WHERE c_custkey <> 0")
def f4(spark, d):
    return table(spark, d, "customer").where("c_custkey <> 0").select("c_custkey", "c_name")


@register("F5_semi_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def f5(spark, d):
    rich = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(rich, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@register("F6_finite", "SELECT c_custkey, nullif(c_acctbal, -994.28) AS value FROM customer WHERE nullif(c_custkey % 10, 3) IS NOT NULL AND c_acctbal > 0")
def f6(spark, d):
    own = table(spark, d, "customer").withColumn("log_value", numeric.log_positive(F.col("c_acctbal"))).withColumn("k", F.nullif(F.col("c_custkey") % 10, F.lit(3)))
    return own.where(numeric.finite(F.col("log_value"))).dropna(subset=["k"]).select("c_custkey", F.nullif("c_acctbal", F.lit(-994.28)).alias("value"))


@register(
    "F7_without_mode",
    """WITH c AS (SELECT l_quantity AS q, count(*) AS n FROM lineitem GROUP BY 1), m AS (SELECT q FROM c ORDER BY n DESC, q LIMIT 1)
       SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_quantity <> (SELECT q FROM m) GROUP BY 1""",
)
def f7(spark, d):
    kept = relational.without_mode(table(spark, d, "lineitem"), "l_quantity")
    return kept.groupBy(F.col("l_quantity").cast("double").alias("l_quantity")).agg(F.count("*").alias("n"))


@register("F8_outliers", "SELECT o_orderkey, o_totalprice FROM orders WHERE abs(o_totalprice - 250000) <= 200000")
def f8(spark, d):
    return table(spark, d, "orders").where(F.abs(F.col("o_totalprice") - 250000) <= 200000).select("o_orderkey", "o_totalprice")


@register("F9_least_years", f"WITH {PANEL_SQL} SELECT unit_id, CAST(count(*) AS BIGINT) AS n_years FROM panel GROUP BY 1 HAVING count(*) >= 5")
def f9(spark, d):
    return panel(spark, d).groupBy("unit_id").agg(F.count("*").alias("n_years")).where("n_years >= 5")


@register("F12_group_list", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2")
def f12(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@register(
    "SC_math",
    """SELECT c_custkey, round(ln(greatest(abs(c_acctbal), 1)), 6) AS l, round(sqrt(abs(c_acctbal)), 6) AS s, CAST(sign(c_acctbal) AS DOUBLE) AS g,
       round(exp(least(c_acctbal / 10000, 1)), 6) AS e, round(ln(1 + abs(c_acctbal)), 6) AS p, greatest(least(c_acctbal, 5000), 0) AS clipped FROM customer""",
)
def sc_math(spark, d):
    v = F.col("c_acctbal")
    return table(spark, d, "customer").select(
        "c_custkey",
        F.round(F.ln(F.greatest(F.abs(v), F.lit(1.0))), 6).alias("l"),
        F.round(F.sqrt(F.abs(v)), 6).alias("s"),
        F.signum(v).alias("g"),
        F.round(F.exp(F.least(v / 10000, F.lit(1.0))), 6).alias("e"),
        F.round(F.log1p(F.abs(v)), 6).alias("p"),
        numeric.clip(v, 0.0, 5000.0).alias("clipped"),
    )


@register("SC_two_sided_p", f"SELECT c_custkey, round({two_sided_p_sql('(c_acctbal / 4000)')}, 6) AS p FROM customer")
def sc_p(spark, d):
    """P-values of standardised balances."""
    return table(spark, d, "customer").select("c_custkey", F.round(two_sided_p(F.col("c_acctbal") / 4000), 6).alias("p"))


@register("SC_json_pack", "SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def sc_json(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@register("SC_hash_bucket")
def sc_hash(spark, d):
    """Stable non-negative hash of a text."""
    return table(spark, d, "part").select("p_partkey", F.pmod(F.xxhash64("p_name"), F.lit(2147483648)).alias("h"))


@register("R7_stride", "SELECT vec_id, list_transform([1, 9, 17, 25, 33, 41, 49, 57], lambda i: round(CAST(embedding[i] AS DOUBLE), 6)) AS x FROM embeddings")
def r7(spark, d):
    e = F.transform(F.sequence(F.lit(0), F.lit(56), F.lit(8)), lambda i: F.round(F.get("embedding", i).cast("double"), 6))
    return table(spark, d, "embeddings").select("vec_id", e.alias("x"))


@register("F10_not_blank", "SELECT vec_id FROM embeddings WHERE list_max(embedding) > 0.3")
def f10(spark, d):
    return table(spark, d, "embeddings").where(F.array_max("embedding") > F.lit(0.3).cast("float")).select("vec_id")


@register("F11_valid_shape", "SELECT CAST(count(*) AS BIGINT) AS n FROM embeddings WHERE len(embedding) = 64")
def f11(spark, d):
    ok = F.when(F.size("embedding") == 64, F.col("embedding").cast(T.ArrayType(T.DoubleType())))
    return table(spark, d, "embeddings").where(ok.isNotNull()).agg(F.count("*").alias("n"))
