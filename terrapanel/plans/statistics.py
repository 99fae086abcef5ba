"""Statistics (T of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.functions.moments import excess_kurtosis, skew
from terrapanel.functions.numeric import interpolate
from terrapanel.functions.quantiles import group_quantiles
from terrapanel.functions.seeded import uniform
from terrapanel.operators import distributions, stats
from terrapanel.plans.registry import PANEL_SQL, panel, register, student_two_sided_p_sql, table, two_sided_p_sql

_RANKS = "rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0"


@register(
    "T1_spearman",
    f"""WITH {PANEL_SQL}, r AS (SELECT year, {_RANKS.format(by='year', c='value')} AS a, {_RANKS.format(by='year', c='n')} AS b FROM panel),
        c AS (SELECT year, corr(a, b) AS rho, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1), t AS (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t, n - 2.0 AS df FROM c)
        SELECT year, round(rho, 6) AS rho, n, round({student_two_sided_p_sql('t', 'df')}, 5) AS p FROM t""",
)
def t1(spark, d):
    p = panel(spark, d).withColumnRenamed("n", "orders")
    return stats.spearman(p, "value", "orders", ["year"]).select("year", F.round("rho", 6).alias("rho"), "n", F.round("p", 5).alias("p"))


_KENDALL = f"""WITH s AS (SELECT s_acctbal AS x, s_nationkey AS y, s_suppkey AS k FROM supplier),
       c AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s, sum(abs(sign(a.x - b.x))) / 2 AS nx, sum(abs(sign(a.y - b.y))) / 2 AS ny FROM s a JOIN s b ON a.k <> b.k),
       gx AS (SELECT CAST(count(*) AS DOUBLE) AS t FROM s GROUP BY x), gy AS (SELECT CAST(count(*) AS DOUBLE) AS t FROM s GROUP BY y),
       x AS (SELECT sum(t * (t - 1) / 2) AS x2, sum(t * (t - 1) * (t - 2)) AS x0, sum(t * (t - 1) * (2 * t + 5)) AS x1, sum(t) AS n FROM gx),
       y AS (SELECT sum(t * (t - 1) / 2) AS y2, sum(t * (t - 1) * (t - 2)) AS y0, sum(t * (t - 1) * (2 * t + 5)) AS y1 FROM gy),
       v AS (SELECT *, s / sqrt((n * (n - 1) * (2 * n + 5) - x1 - y1) / 18 + 2 * x2 * y2 / (n * (n - 1)) + x0 * y0 / (9 * n * (n - 1) * (n - 2))) AS z FROM c, x, y)
       SELECT round(s / sqrt(CAST(nx AS DOUBLE) * ny), 6) AS tau, CAST(n AS BIGINT) AS n, round({two_sided_p_sql('z')}, 6) AS p FROM v"""


@register("T2_kendall", _KENDALL)
def t2(spark, d):
    return stats.kendall(table(spark, d, "supplier"), "s_acctbal", "s_nationkey").select(F.round("tau", 6).alias("tau"), "n", F.round("p", 6).alias("p"))


@register("T3_rank_intervals")
def t3(spark, d):
    """Percentile intervals of both rank correlations in 200 resamples (random draws, so no SQL)."""
    return stats.rank_intervals(panel(spark, d).where("year = 1998").withColumnRenamed("n", "orders"), ["unit_id"], "value", "orders", 200, 42)


@register(
    "T4_rank_autocorrelation",
    f"""WITH {PANEL_SQL}, w AS (SELECT a.value AS x, b.value AS y FROM panel a JOIN panel b ON a.unit_id = b.unit_id AND a.year = 1996 AND b.year = 2000), r AS (SELECT rank() OVER (ORDER BY x) AS a, rank() OVER (ORDER BY y) AS b FROM w)
        SELECT round(corr(a, b), 6) AS rho, CAST(count(*) AS BIGINT) AS n FROM r""",
)
def t4(spark, d):
    return stats.rank_autocorrelation(panel(spark, d), "unit_id", "year", "value", 1996, 2000).select(F.round("rho", 6).alias("rho"), "n")


def _fits(spark, d):
    return distributions.fit_gb2_by(panel(spark, d), "value", ["year"])


def _smooth_fits(spark, d):
    return stats.smooth_parameters(_fits(spark, d), "year", list(distributions.PARAMETERS))


@register("T7_gb2_fit")
def t7(spark, d):
    """Parameters of each year's distribution by maximum likelihood over all its rows (an iterative fit, so no SQL)."""
    return _fits(spark, d)


@register("T8_smooth_parameters")
def t8(spark, d):
    """The years' parameters, smoothed by a cubic of their logarithms."""
    return _smooth_fits(spark, d)


@register("T9_gb2_map")
def t9(spark, d):
    """Scores mapped to the year's fitted and smoothed distribution by rank."""
    return distributions.map_by_rank(panel(spark, d), "value", ["year"], _smooth_fits(spark, d)).select("unit_id", "year", "mapped")


_KNOTS = ", ".join(f"quantile_cont(value, {k / 20})" for k in range(21))


@register(
    "T10_empirical_map",
    f"""WITH {PANEL_SQL}, k AS (SELECT [{_KNOTS}] AS xs FROM panel WHERE year = 1996), t AS (SELECT [{_KNOTS}] AS ys FROM panel WHERE year = 2000),
        m AS (SELECT unit_id, value, xs, ys, greatest(1, least(20, len(list_filter(xs, lambda x: x <= value)))) AS i FROM panel, k, t WHERE year = 1996)
        SELECT unit_id, round(ys[i] + (value - xs[i]) * (ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]), 3) AS mapped FROM m""",
)
def t10(spark, d):
    """Quantile-to-quantile map on 21 knots."""
    p = panel(spark, d)
    knots = lambda y, name: group_quantiles(p.where(f"year = {y}"), "value", [k / 20 for k in range(21)], name=name)
    both = knots(1996, "xs").crossJoin(F.broadcast(knots(2000, "ys")))  # one row each
    own = p.where("year = 1996").crossJoin(F.broadcast(both))
    return own.select("unit_id", F.round(interpolate(F.col("value"), F.col("xs"), F.col("ys")), 3).alias("mapped"))


@register(
    "T12_temporal_consistency",
    f"""WITH {PANEL_SQL}, c AS (SELECT unit_id, max(n) >= 4 AS changed FROM panel GROUP BY 1), p AS (SELECT panel.*, changed FROM panel JOIN c USING (unit_id)),
        q AS (SELECT a.changed, abs(b.value - a.value) AS diff, sign(b.value - a.value) = sign(b.n - a.n) AS ok FROM p a JOIN p b ON a.unit_id = b.unit_id AND a.year < b.year)
        SELECT round(avg(CASE WHEN NOT changed THEN diff END), 3) AS masd_stable, round(avg(CASE WHEN changed THEN diff END), 3) AS masd_changed, round(avg(CASE WHEN changed THEN CAST(ok AS INT) END), 6) AS directional_accuracy, CAST(count(*) AS BIGINT) AS n_pairs FROM q""",
)
def t12(spark, d):
    """Also W18."""
    p = panel(spark, d)
    own = p.join(p.groupBy("unit_id").agg((F.max("n") >= 4).alias("changed")), "unit_id")
    out = stats.temporal_consistency(own, "unit_id", "year", "n", "value", "changed")
    return out.select(F.round("masd_stable", 3).alias("masd_stable"), F.round("masd_changed", 3).alias("masd_changed"), F.round("directional_accuracy", 6).alias("directional_accuracy"), "n_pairs")


_TRACTS = f"{PANEL_SQL}, q AS (SELECT unit_id, year, value, n, c_nationkey AS tract FROM panel JOIN customer ON unit_id = c_custkey)"


def _tracts(spark, d):
    """The panel with each unit's tract (its nation)."""
    return panel(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("unit_id"), F.col("c_nationkey").alias("tract")), "unit_id")


@register(
    "T13_concordance",
    f"""WITH {_TRACTS} SELECT a.year, round(avg(CAST(sign(a.value - b.value) = sign(a.n - b.n) AS INT)), 6) AS concordance, CAST(count(*) AS BIGINT) AS n
        FROM q a JOIN q b ON a.year = b.year AND a.unit_id < b.unit_id AND a.tract <> b.tract GROUP BY 1""",
)
def t13(spark, d):
    """Pairs of units of different tracts in one year, counted without making them."""
    found = stats.concordance(_tracts(spark, d), "n", "value", ["year"], "tract")
    return found.select("year", F.round("concordance", 6).alias("concordance"), "n")


_SOFT = "(greatest(-({0}), 0) + ln(1 + exp(-abs({0}))))"
#: The least difference of levels in each stage of the training, and a batch's rows.
STAGES, BATCH = ((1, 3), (2, 2), (3, 1)), 256


@register(
    "T14_ranking_loss",
    f"""WITH {_TRACTS}, m AS (SELECT unit_id, max(n) >= 4 AS changed FROM panel GROUP BY 1), k AS (SELECT year, 1 + count(*) // {BATCH} AS batches FROM panel GROUP BY 1),
        r AS (SELECT year, CAST(floor((CAST(CAST('0x' || substr(md5('14|' || unit_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296 * batches) AS BIGINT) AS batch, unit_id, tract, n, value / 100000 AS s, least(n, 5) AS lev FROM q JOIN k USING (year)), st(stage, least_diff) AS (VALUES {", ".join(map(str, STAGES))}),
        c AS (SELECT a.year, a.batch, stage, count(*) AS n_pairs, avg({_SOFT.format('sign(b.n - a.n) * (b.s - a.s)')}) AS cross_part FROM r a JOIN r b ON a.year = b.year AND a.batch = b.batch AND a.unit_id < b.unit_id AND a.tract <> b.tract JOIN st ON abs(a.lev - b.lev) >= least_diff GROUP BY 1, 2, 3),
        w AS (SELECT r.year, r.batch, avg(CASE WHEN NOT changed THEN pow(t.value / 100000 - r.s, 2) END) AS stable, avg(CASE WHEN changed THEN {_SOFT.format('sign(t.n - r.n) * (t.value / 100000 - r.s)')} END) AS change FROM r JOIN panel t ON t.unit_id = r.unit_id AND t.year = r.year + 1 JOIN m ON m.unit_id = r.unit_id GROUP BY 1, 2),
        v AS (SELECT year, batch, pow(stddev_samp(s) - 1, 2) AS spread FROM r GROUP BY 1, 2),
        j AS (SELECT v.year, st.stage, coalesce(cross_part, 0) AS cross_part, coalesce(stable, 0) AS stable, coalesce(change, 0) AS change, coalesce(spread, 0) AS spread, coalesce(n_pairs, 0) AS n_pairs FROM v JOIN st ON true LEFT JOIN c ON c.year = v.year AND c.batch = v.batch AND c.stage = st.stage LEFT JOIN w ON w.year = v.year AND w.batch = v.batch)
        SELECT year, CAST(stage AS INT) AS stage, round(avg(cross_part), 6) AS l_cross, round(avg(stable), 6) AS l_stable, round(avg(change), 6) AS l_change, round(avg(spread), 6) AS l_variance, round(avg(cross_part + stable + change + spread), 6) AS loss, CAST(sum(n_pairs) AS BIGINT) AS n_pairs FROM j GROUP BY 1, 2""",
)
def t14(spark, d):
    """The loss of an anchor year's batches in the three stages of its curriculum, with twins from the next year."""
    p = _tracts(spark, d)
    batches = p.groupBy("year").agg((1 + F.floor(F.count("*") / BATCH)).alias("batches"))
    rows = p.join(F.broadcast(batches), "year").withColumn("batch", F.floor(uniform(14, F.col("unit_id")) * F.col("batches"))).withColumns({"score": F.col("value") / 100000, "level": F.least("n", F.lit(5))})
    changed = p.groupBy("unit_id").agg((F.max("n") >= 4).alias("changed"))
    later = p.select("unit_id", (F.col("year") - 1).alias("year"), (F.col("value") / 100000).alias("score"), "n").join(changed, "unit_id")
    twins = later.join(rows.select("year", "batch", "unit_id"), ["year", "unit_id"])
    least = spark.createDataFrame(list(STAGES), "stage int, least_diff int")
    found = stats.ranking_loss(rows, ["year", "batch"], "unit_id", "tract", "score", "n", "level", least, twins, "changed")
    parts = {"l_cross": "cross", "l_stable": "stable", "l_change": "change", "l_variance": "variance", "loss": "loss"}
    return found.groupBy("year", "stage").agg(*[F.round(F.avg(c), 6).alias(k) for k, c in parts.items()], F.sum("n_pairs").alias("n_pairs"))


@register(
    "T15_metrics_by_epoch",
    f"""WITH {_TRACTS}, e(epoch) AS (VALUES (0), (1), (2)), s AS (SELECT epoch, tract, value, avg(value) OVER () + (value - avg(value) OVER ()) * epoch / 2.0 + 1000.0 * (unit_id % 3 - 1) AS score FROM q, e),
        t AS (SELECT epoch, tract, avg(value) AS v, avg(score) AS s FROM s GROUP BY 1, 2), tm AS (SELECT epoch, avg(pow(v - s, 2)) AS tract_mse FROM t GROUP BY 1)
        SELECT CAST(epoch AS INT) AS epoch, round(avg(pow(value - score, 2)) / 1e6, 5) AS mse, round(any_value(tract_mse) / 1e6, 5) AS tract_mse, round(1 - avg(pow(value - score, 2)) / var_pop(value), 6) AS r2 FROM s JOIN tm USING (epoch) GROUP BY 1""",
)
def t15(spark, d):
    """Squared errors of rows and of tract means, and the share of variance explained, by epoch."""
    q = _tracts(spark, d)
    mean = q.agg(F.avg("value").alias("mean"))
    s = q.crossJoin(F.broadcast(mean)).withColumn("epoch", F.explode(F.array(*map(F.lit, range(3)))))
    s = s.withColumn("score", F.col("mean") + (F.col("value") - F.col("mean")) * F.col("epoch") / 2 + 1000.0 * (F.col("unit_id") % 3 - 1))
    return stats.metrics_by(s, ["epoch"], "tract", "value", "score").select("epoch", F.round(F.col("mse") / 1e6, 5).alias("mse"), F.round(F.col("tract_mse") / 1e6, 5).alias("tract_mse"), F.round("r2", 6).alias("r2"))


@register("T17_qq_frame")
def t17(spark, d):
    """Sorted data against the quantiles of the year's own fit, at Hazen positions, both ends cut."""
    return distributions.qq_frame(panel(spark, d), "value", "unit_id", ["year"], _fits(spark, d))


@register("T18_tail_stability")
def t18(spark, d):
    """Spread of the 90th, 95th and 99th percentile of mapped scores over resamples: GB2 against 21 quantiles (random draws, so no SQL)."""
    p = panel(spark, d).where("year = 1998")
    scores = p.select(F.col("n").cast("double") + F.col("value") / 1e6)
    return distributions.tail_stability(p, "value", "unit_id", scores.toDF("score"), "score", 40, seed=3)


@register(
    "T19_city_moments",
    f"""WITH {PANEL_SQL}, m AS (SELECT year, value AS v, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS sd FROM panel WINDOW w AS (PARTITION BY year))
        SELECT year, CAST(count(*) AS BIGINT) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, round(avg(pow((v - mean) / sd, 3)), 6) AS skew, round(avg(pow((v - mean) / sd, 4)) - 3, 6) AS kurt, round(quantile_cont(v, 0.9), 4) AS p90, round(quantile_cont(v, 0.95), 4) AS p95 FROM m GROUP BY 1""",
)
def t19(spark, d):
    v = F.col("value")
    p = panel(spark, d)
    q = group_quantiles(p, "value", [0.9, 0.95], ["year"], "q").select("year", F.round(F.col("q")[0], 4).alias("p90"), F.round(F.col("q")[1], 4).alias("p95"))
    moments = p.groupBy("year").agg(
        F.count("*").alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("sd"), F.round(skew(v), 6).alias("skew"), F.round(excess_kurtosis(v), 6).alias("kurt")
    )
    return moments.join(q, "year")


@register(
    "ST_stability",
    f"""WITH {PANEL_SQL}, m AS (SELECT unit_id, value, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sd, count(*) OVER w AS k FROM panel WINDOW w AS (PARTITION BY unit_id))
        SELECT unit_id, round(median(abs(value - mean)), 6) AS mad, round(max(sd), 6) AS sd FROM m WHERE k >= 2 GROUP BY 1""",
)
def st(spark, d):
    return stats.stability(panel(spark, d), "unit_id", "value").select("unit_id", F.round("mad", 6).alias("mad"), F.round("sd", 6).alias("sd"))


_DID = f"""{PANEL_SQL}, y AS (SELECT unit_id, (year - 1995) // 2 AS t, avg(value) AS v FROM panel GROUP BY 1, 2), g AS (SELECT unit_id, CASE unit_id % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS g FROM panel GROUP BY 1),
  x AS (SELECT y.unit_id, t, v, g FROM y JOIN g USING (unit_id)),
  c AS (SELECT g, t, CASE WHEN t >= g THEN g - 1 ELSE t - 1 END AS base FROM (SELECT DISTINCT g FROM x WHERE g > 0), (SELECT DISTINCT t FROM x WHERE t > 0)),
  d AS (SELECT n.t, b.t AS base, n.g, avg(n.v - b.v) AS d, count(*) AS k FROM x n JOIN x b ON n.unit_id = b.unit_id GROUP BY 1, 2, 3),
  a AS (SELECT c.g, c.t, p.d - q.d AS att, p.k AS n_treated, q.k AS n_control FROM c JOIN d p ON p.t = c.t AND p.base = c.base AND p.g = c.g JOIN d q ON q.t = c.t AND q.base = c.base AND q.g = 0)"""


def _did_panel(spark, d):
    group = F.when(F.col("unit_id") % 4 == 1, 1).when(F.col("unit_id") % 4 == 2, 2).otherwise(0)
    y = panel(spark, d).groupBy("unit_id", F.floor((F.col("year") - 1995) / 2).alias("t")).agg(F.avg("value").alias("v")).withColumn("g", group)
    return y, "unit_id", "t", "v", "g"


def _did(spark, d):
    return stats.group_time_effects(*_did_panel(spark, d))


@register("T11_group_time_effects", f"WITH {_DID} SELECT CAST(g AS INT) AS g, CAST(t AS BIGINT) AS t, round(att, 3) AS att, CAST(n_treated AS BIGINT) AS n_treated, CAST(n_control AS BIGINT) AS n_control FROM a")
def t11(spark, d):
    return _did(spark, d).select("g", "t", F.round("att", 3).alias("att"), "n_treated", "n_control")


@register("T11_event_study", f"WITH {_DID} SELECT CAST(t - g AS BIGINT) AS k, round(sum(att * n_treated) / sum(n_treated), 3) AS att, CAST(sum(n_treated) AS BIGINT) AS n FROM a GROUP BY 1")
def t11_event(spark, d):
    return stats.event_time_effects(_did(spark, d)).select("k", F.round("att", 3).alias("att"), "n")


@register("T11_simple", f"WITH {_DID} SELECT round(sum(att * n_treated) / sum(n_treated), 3) AS att, CAST(sum(n_treated) AS BIGINT) AS n FROM a WHERE t >= g")
def t11_simple(spark, d):
    return stats.simple_effect(_did(spark, d)).select(F.round("att", 3).alias("att"), "n")


_SE = f"""{_DID}, ks AS (SELECT t - g AS k, sum(n_treated) AS kn FROM a GROUP BY 1), cells AS (SELECT a.g, a.t, c.base, a.t - a.g AS k, n_treated, n_control, n_treated / kn AS share FROM a JOIN c ON a.g = c.g AND a.t = c.t JOIN ks ON ks.k = a.t - a.g),
  ch AS (SELECT n.unit_id, n.g AS grp, cells.g, cells.t, k, share, n_treated, n_control, n.v - b.v AS d FROM cells JOIN x n ON n.t = cells.t AND (n.g = cells.g OR n.g = 0) JOIN x b ON b.unit_id = n.unit_id AND b.t = cells.base),
  far AS (SELECT *, d - avg(d) OVER (PARTITION BY g, t, grp) AS f FROM ch), psi AS (SELECT unit_id, k, sum(share * CASE WHEN grp = g THEN f / n_treated ELSE -f / n_control END) AS psi FROM far GROUP BY 1, 2)"""


@register("T11_event_errors", f"WITH {_SE} SELECT CAST(k AS BIGINT) AS k, round(sqrt(sum(psi * psi)), 4) AS se FROM psi GROUP BY 1")
def t11_errors(spark, d):
    """Standard errors by event time, from the units' influences."""
    return stats.event_time_errors(stats.influences(*_did_panel(spark, d))).select("k", F.round("se", 4).alias("se"))


@register("T11_event_bands")
def t11_bands(spark, d):
    """Simultaneous bands by the multiplier bootstrap (random draws, so no SQL)."""
    return stats.event_time_bands(*_did_panel(spark, d), replicates=1000, seed=5)
