"""Windows, bins and order-dependent operators (W of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapanel.functions import bins, ranks
from terrapanel.functions.numeric import interpolate
from terrapanel.functions.quantiles import group_quantiles
from terrapanel.operators import panel as panel_ops
from terrapanel.operators import relational
from terrapanel.plans.registry import PANEL_SQL, panel, register, table


def _edges_sql(q: int) -> str:
    return "[" + ", ".join(f"quantile_cont(value, {k}.0 / {q})" for k in range(1, q)) + "]"


_BIN = "CAST(len(list_filter(list_distinct(e), lambda x: x < value AND x > lo)) AS INT)"


@register(
    "W1_qcut_by_year",
    f"""WITH {PANEL_SQL}, g AS (SELECT year, {_edges_sql(5)} AS e, min(value) AS lo FROM panel GROUP BY 1)
        SELECT unit_id, year, {_BIN} AS bin FROM panel JOIN g USING (year)""",
)
def w1(spark, d):
    """Quintiles within each year."""
    return bins.qcut(panel(spark, d), "value", 5, ["year"]).select("unit_id", "year", "bin")


@register("W2_qcut_global", f"WITH {PANEL_SQL}, g AS (SELECT {_edges_sql(5)} AS e, min(value) AS lo FROM panel) SELECT unit_id, year, {_BIN} AS bin FROM panel, g")
def w2(spark, d):
    return bins.qcut(panel(spark, d), "value", 5).select("unit_id", "year", "bin")


@register(
    "W3_cut_stretched",
    f"""WITH {PANEL_SQL}, g AS (SELECT {_edges_sql(10)} AS e FROM panel WHERE year = 1996)
        SELECT unit_id, CAST(1 + len(list_filter(e, lambda x: x < value)) AS INT) AS decile FROM panel, g WHERE year = 2000""",
)
def w3(spark, d):
    """Deciles by the edges of another year; outer bins take what lies beyond."""
    p = panel(spark, d)
    edges = group_quantiles(p.where("year = 1996"), "value", [k / 10 for k in range(11)], name="edges")  # one row
    return p.where("year = 2000").crossJoin(F.broadcast(edges)).select("unit_id", bins.cut_stretched(F.col("value"), F.col("edges")).alias("decile"))


@register(
    "W4_digitize_means",
    f"""WITH {PANEL_SQL}, g AS (SELECT {_edges_sql(10)} AS e FROM panel)
        SELECT bin, round(avg(value), 4) AS mean, CAST(count(*) AS BIGINT) AS n FROM (SELECT value, CAST(len(list_filter(e, lambda x: x <= value)) AS INT) AS bin FROM panel, g) GROUP BY 1""",
)
def w4(spark, d):
    p = panel(spark, d)
    edges = group_quantiles(p, "value", [k / 10 for k in range(11)], name="edges")
    own = p.crossJoin(F.broadcast(edges)).withColumn("bin", bins.left_closed(F.col("value"), F.col("edges")))
    return own.groupBy("bin").agg(F.round(F.avg("value"), 4).alias("mean"), F.count("*").alias("n"))


@register("W5_cumulative", f"WITH {PANEL_SQL} SELECT unit_id, year, CAST(sum(n) OVER (PARTITION BY unit_id ORDER BY year) AS BIGINT) AS n_so_far FROM panel")
def w5(spark, d):
    return panel_ops.cumulative(panel(spark, d), "unit_id", "year", "n", "n_so_far").select("unit_id", "year", "n_so_far")


@register("W6_rank_first", f"WITH {PANEL_SQL} SELECT unit_id, year, CAST(row_number() OVER (PARTITION BY year ORDER BY value DESC, unit_id) AS INT) AS place FROM panel")
def w6(spark, d):
    p = panel(spark, d).withColumn("down", -F.col("value"))
    return ranks.with_place(p, "down", "unit_id", ["year"], "place").select("unit_id", "year", F.col("place").cast("int").alias("place"))


@register(
    "W7_hazen",
    f"""WITH {PANEL_SQL} SELECT unit_id, year, round((rank() OVER (PARTITION BY year ORDER BY n) + (count(*) OVER (PARTITION BY year, n) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY year), 6) AS position FROM panel""",
)
def w7(spark, d):
    p = ranks.with_average_rank(panel(spark, d), "n", ["year"], "rank")
    size = p.groupBy("year").agg(F.count("*").alias("size"))
    return p.join(size, "year").select("unit_id", "year", F.round(ranks.hazen(F.col("rank"), F.col("size")), 6).alias("position"))


@register("W8_latest", "SELECT l_orderkey, l_partkey, l_shipdate FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_linenumber) = 1")
def w8(spark, d):
    order = [F.desc_nulls_last("l_shipdate"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")]
    return relational.keep_first(table(spark, d, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_partkey", "l_shipdate")


@register("W9_first_seen", f"WITH {PANEL_SQL} SELECT unit_id, round(arg_min(value, year), 6) AS first_value FROM panel GROUP BY 1")
def w9(spark, d):
    return panel(spark, d).groupBy("unit_id").agg(F.round(F.min_by("value", "year"), 6).alias("first_value"))


@register("W10_differences", f"WITH {PANEL_SQL} SELECT unit_id, year, round(value - lag(value) OVER (PARTITION BY unit_id ORDER BY year), 6) AS diff FROM panel")
def w10(spark, d):
    return panel(spark, d).select("unit_id", "year", F.round(F.col("value") - F.lag("value").over(W.partitionBy("unit_id").orderBy("year")), 6).alias("diff"))


_SCORES = f"""{PANEL_SQL}, l AS (SELECT unit_id, year, ln(value) AS l, (0.1 * value / n / 1.645) / value AS e FROM panel),
  s AS (SELECT unit_id, year, (l - avg(l) OVER (PARTITION BY year)) / stddev_samp(l) OVER (PARTITION BY year) AS z, e / stddev_samp(l) OVER (PARTITION BY year) AS ez FROM l)"""

_CHANGES = f"""{_SCORES}, c AS (SELECT unit_id, lag(year) OVER w AS from_year, year AS to_year, z - lag(z) OVER w AS diff, abs(z - lag(z) OVER w) / sqrt(ez * ez + pow(lag(ez) OVER w, 2)) AS t FROM s WINDOW w AS (PARTITION BY unit_id ORDER BY year))"""


def _scores(spark, d):
    own = panel(spark, d).withColumn("margin", F.col("value") * 0.1 / F.col("n"))
    return panel_ops.relative_scores(own, "value", "margin", ["year"])


@register("P9_relative_score", f"WITH {_SCORES} SELECT unit_id, year, round(z, 6) AS rel_score, round(ez, 6) AS rel_error FROM s")
def p9(spark, d):
    """Log income relative to its year, with the standard error by the delta method."""
    return _scores(spark, d).select("unit_id", "year", F.round("rel_score", 6).alias("rel_score"), F.round("rel_error", 6).alias("rel_error"))


@register("T5_change_test", f"WITH {_CHANGES} SELECT unit_id, from_year, to_year, round(diff, 6) AS diff, round(t, 5) AS z, t > 1.959963984540054 AS significant FROM c WHERE from_year IS NOT NULL")
def t5(spark, d):
    out = panel_ops.consecutive_changes(_scores(spark, d), "unit_id", "year", "rel_score", "rel_error")
    return out.select("unit_id", "from_year", "to_year", F.round("diff", 6).alias("diff"), F.round("z", 5).alias("z"), "significant")


@register(
    "T6_structural_change",
    f"""WITH {_CHANGES}, k AS (SELECT unit_id, t > 1.959963984540054 AS sig, coalesce(t > 1.959963984540054 AND lag(t) OVER w > 1.959963984540054 AND sign(diff) <> sign(lag(diff) OVER w), false) AS turned FROM c WHERE from_year IS NOT NULL WINDOW w AS (PARTITION BY unit_id ORDER BY from_year)),
        f AS (SELECT unit_id, abs(arg_max(z, year) - arg_min(z, year)) / sqrt(pow(arg_max(ez, year), 2) + pow(arg_min(ez, year), 2)) > 1.959963984540054 AS sig FROM s GROUP BY 1 HAVING count(*) > 2),
        b AS (SELECT unit_id, sig, turned FROM k UNION ALL SELECT unit_id, sig, false FROM f)
        SELECT unit_id, bool_or(turned) AS yo_yo, bool_or(sig) AND NOT bool_or(turned) AS valid FROM b GROUP BY 1""",
)
def t6(spark, d):
    """Units with a significant change that is not taken back."""
    s = _scores(spark, d)
    args = ("unit_id", "year", "rel_score", "rel_error")
    return panel_ops.structural_change(panel_ops.consecutive_changes(s, *args), panel_ops.first_last_change(s, *args), "unit_id")


@register(
    "W12_before_after",
    f"""WITH {PANEL_SQL}, e AS (SELECT unit_id, arg_max(year, n * 10000 - year) AS event FROM panel GROUP BY 1),
        m AS (SELECT unit_id, avg(CASE WHEN year < event THEN value END) AS b, avg(CASE WHEN year >= event THEN value END) AS a FROM panel JOIN e USING (unit_id) GROUP BY 1)
        SELECT unit_id, round(b, 6) AS mean_before, round(a, 6) AS mean_after, round(a - b, 6) AS delta FROM m WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def w12(spark, d):
    p = panel(spark, d)
    event = p.groupBy("unit_id").agg(F.max_by("year", F.col("n") * 10000 - F.col("year")).alias("event"))
    out = panel_ops.before_and_after(p.join(event, "unit_id"), "unit_id", "year", "value", "event")
    return out.select("unit_id", *[F.round(c, 6).alias(c) for c in ("mean_before", "mean_after", "delta")])


@register("W13_rolling_sum", "SELECT event_id, round(CASE WHEN count(*) OVER w = 5 THEN sum(value) OVER w END, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def w13(spark, d):
    out = panel_ops.rolling_sum(table(spark, d, "events"), ["ts", "event_id"], ["user_id"], "value", 5, "total")
    return out.select("event_id", F.round("total", 4).alias("total"))


@register(
    "W14_exponential_mean",
    f"""WITH {PANEL_SQL}, k AS (SELECT unit_id, value, row_number() OVER (PARTITION BY unit_id ORDER BY year DESC) - 1 AS k, count(*) OVER (PARTITION BY unit_id) AS m FROM panel)
        SELECT unit_id, round(sum(value * pow(2.0 / 3, k) * CASE WHEN k = m - 1 THEN 1 ELSE 1.0 / 3 END), 4) AS ewm FROM k GROUP BY 1""",
)
def w14(spark, d):
    return panel_ops.exponential_mean(panel(spark, d), ["unit_id"], "year", "value", 5, "ewm").select("unit_id", F.round("ewm", 4).alias("ewm"))


@register("W15_reference_time", f"WITH {PANEL_SQL}, y AS (SELECT year - 1998 AS k, avg(value) AS m FROM panel GROUP BY 1) SELECT k, round(m - (SELECT m FROM y WHERE k = -1), 4) AS effect FROM y")
def w15(spark, d):
    y = panel(spark, d).groupBy((F.col("year") - 1998).alias("k")).agg(F.avg("value").alias("m"))
    ref = y.where("k = -1").agg(F.max("m").alias("ref"))  # one row
    return y.crossJoin(F.broadcast(ref)).select("k", F.round(F.col("m") - F.col("ref"), 4).alias("effect"))


@register(
    "W16_interpolate",
    """SELECT c_custkey, round(CASE WHEN c_acctbal <= 0 THEN 1 WHEN c_acctbal >= 10000 THEN 5 WHEN c_acctbal < 2500 THEN 1 + c_acctbal / 2500 WHEN c_acctbal < 5000 THEN 2 + (c_acctbal - 2500) / 1250 ELSE 4 + (c_acctbal - 5000) / 5000 END, 6) AS y FROM customer""",
)
def w16(spark, d):
    xs, ys = F.array(*map(F.lit, (0.0, 2500.0, 5000.0, 10000.0))), F.array(*map(F.lit, (1.0, 2.0, 4.0, 5.0)))
    return table(spark, d, "customer").select("c_custkey", F.round(interpolate(F.col("c_acctbal"), xs, ys), 6).alias("y"))


@register("W17_winsorise", f"WITH {PANEL_SQL}, q AS (SELECT year, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS z FROM panel GROUP BY 1) SELECT unit_id, year, round(greatest(least(value, z), a), 5) AS value FROM panel JOIN q USING (year)")
def w17(spark, d):
    return panel_ops.winsorise(panel(spark, d), "value", ["year"]).select("unit_id", "year", F.round("value", 5).alias("value"))


@register("W19_percentile_of_score", "SELECT o_orderpriority, round(100 * (avg(CAST(o_totalprice < 250000 AS INT)) + avg(CAST(o_totalprice <= 250000 AS INT))) / 2, 6) AS pct FROM orders GROUP BY 1")
def w19(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(ranks.percentile_of_score(F.col("o_totalprice"), F.lit(250000)), 6).alias("pct"))
