"""Rank statistics, distribution fits and intervals against plain numpy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.functions.quantiles import group_quantiles
from terrapanel.functions.ranks import with_average_rank, with_place
from terrapanel.functions.special import fit_gb2, gb2_logpdf, gb2_ppf
from terrapanel.operators import distributions, stats


def values(spark, rng, n=3000, heavy=True):
    """Groups with one far outlier, many ties, and a spread of many orders of magnitude."""
    rows = []
    for i in range(n):
        rows.append((i, "a", float(rng.normal()), float(rng.integers(0, 9))))
        rows.append((i, "b", float(np.exp(rng.normal() * 9)), float(rng.normal())))
        rows.append((i, "c", float(rng.choice([0.0, 0.0, 0.0, 1.0, 2.5])), float(rng.choice([1.0, 2.0]))))
    rows += [(n, "a", 1e300, 1.0), (n + 1, "a", None, 1.0), (0, "one", 5.0, 5.0)]
    return rows, spark.createDataFrame(rows, "id long, g string, x double, y double")


def test_quantiles_and_ranks_with_outliers_and_ties(spark):
    rows, df = values(spark, np.random.default_rng(1))
    shares = [0.0, 0.013, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {r.g: r.quantiles for r in group_quantiles(df, "x", shares, ["g"]).collect()}
    ranks = {(r.g, r.id): r.rank for r in with_average_rank(df, "x", ["g"], "rank").collect()}
    places = {(r.g, r.id): r.place for r in with_place(df, "x", "id", ["g"], "place").collect()}
    for g in ("a", "b", "c", "one"):
        own = [(x, i) for i, k, x, _ in rows if k == g and x is not None]
        np.testing.assert_allclose(got[g], np.quantile([x for x, _ in own], shares), rtol=1e-12)
        xs = np.array([x for x, _ in own])
        for n, (_, i) in enumerate(sorted(own)):
            assert places[g, i] == n + 1
        for x, i in own[:: max(1, len(own) // 50)]:
            assert ranks[g, i] == (xs < x).sum() + ((xs == x).sum() + 1) / 2
    assert ranks["a", 3001] is None


def test_weighted_quantiles(spark):
    rng = np.random.default_rng(2)
    rows = [(float(rng.normal()), int(rng.integers(0, 4))) for _ in range(500)]
    got = group_quantiles(spark.createDataFrame(rows, "x double, w int"), "x", [0.1, 0.5, 0.77], weight=F.col("w")).first()[0]
    np.testing.assert_allclose(got, np.quantile(np.repeat([x for x, _ in rows], [w for _, w in rows]), [0.1, 0.5, 0.77]))


def test_no_window_sorts_raw_rows_of_a_group(spark):
    """Every window is dealt out by a part as well, or runs over the parts' sums."""
    df = spark.range(100).selectExpr("id", "id % 3 AS g", "rand() AS x")
    plan = with_place(df, "x", "id", ["g"], "place")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if line.lstrip("+- :").startswith("Window")]
    assert windows and all("__part" in w for w in windows)


def slow_counts(x, y, w=None):
    con = dis = both = tx = ty = 0
    w = [1] * len(x) if w is None else w
    for i, j in itertools.combinations(range(len(x)), 2):
        a, b, k = np.sign(x[i] - x[j]), np.sign(y[i] - y[j]), w[i] * w[j]
        con, dis, both = con + k * (a * b > 0), dis + k * (a * b < 0), both + k * (a == 0 and b == 0)
        tx, ty = tx + k * (a == 0), ty + k * (b == 0)
    return con, dis, tx, ty, both


def test_pairs_are_counted_without_being_made(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(rng.integers(0, k)), float(rng.integers(0, m))) for g, n, k, m in (("a", 90, 5, 7), ("b", 120, 10**6, 10**6), ("c", 1, 2, 2), ("d", 70, 1, 9)) for _ in range(n)]
    got = {r.g: r for r in stats.pair_counts(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"]).collect()}
    for g in "abcd":
        x, y = zip(*[(a, b) for k, a, b in rows if k == g], strict=True)
        r = got[g]
        assert (r.concordant, r.discordant, r.ties_x, r.ties_y, r.ties_both) == slow_counts(x, y)
        assert r.pairs == len(x) * (len(x) - 1) / 2


def test_rank_correlations_with_p_values(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=60)
    y = 0.3 * x + rng.normal(size=60)
    df = spark.createDataFrame([(float(a), float(b), i % 3) for i, (a, b) in enumerate(zip(x, y, strict=True))], "x double, y double, w int")
    rank = lambda v: np.argsort(np.argsort(v)) + 1.0
    rho = np.corrcoef(rank(x), rank(y))[0, 1]
    r = stats.spearman(df, "x", "y").first()
    t = abs(rho) * math.sqrt(58 / (1 - rho**2))
    # Student's density, integrated by small steps.
    grid = np.linspace(t, t + 60, 400_001)
    density = math.exp(math.lgamma(29.5) - math.lgamma(29)) / math.sqrt(58 * math.pi) * (1 + grid**2 / 58) ** -29.5
    assert r.n == 60 and r.rho == pytest.approx(rho) and r.p == pytest.approx(2 * np.trapezoid(density, grid), rel=1e-5)
    con, dis, *_ = slow_counts(x, y)
    k = stats.kendall(df, "x", "y").first()
    z = (con - dis) / math.sqrt(60 * 59 * 125 / 18)
    assert k.tau == pytest.approx((con - dis) / 1770) and k.p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    again = np.repeat(np.arange(60), np.arange(60) % 3)
    full = spark.createDataFrame([(float(x[i]), float(y[i])) for i in again], "x double, y double")
    for f, name in ((stats.spearman, "rho"), (stats.kendall, "tau")):
        assert f(df, "x", "y", weight=F.col("w")).first()[name] == pytest.approx(f(full, "x", "y").first()[name])


def test_intervals_of_rank_correlations(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=200)
    y = x + rng.normal(size=200)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x double, y double")
    found = {r.statistic: r for r in stats.rank_intervals(df, ["id"], "x", "y", 150, 7).collect()}
    for name, f, c in (("spearman", stats.spearman, "rho"), ("kendall", stats.kendall, "tau")):
        r, point = found[name], f(df, "x", "y").first()[c]
        assert r.n == 150 and r.low < point < r.high and 0.03 < r.high - r.low < 0.3


def test_draws_have_no_cut(spark):
    drawn = stats.resampled(spark.range(20_000).selectExpr("id", "1 AS v"), ["id"], 10, 1)
    n, most = drawn.agg(F.sum("draws"), F.max("draws")).first()
    assert abs(n - 200_000) < 2_000 and most >= 7
    counts = {r.draws: r["count"] for r in drawn.groupBy("draws").count().collect()}
    for k in (1, 2, 3, 4):
        assert counts[k] == pytest.approx(200_000 * math.exp(-1) / math.factorial(k), rel=0.06)


def incomes(rng, n):
    return gb2_ppf(rng.uniform(1e-6, 1 - 1e-6, n), 2.5, 1.2, 0.9, 50_000.0)


def test_fit_is_that_of_all_rows(spark):
    rng = np.random.default_rng(6)
    groups = {1: incomes(rng, 4000), 2: incomes(rng, 600) * 3, 3: np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [(1, -5.0), (2, None)]
    got = {r.year: r for r in distributions.fit_gb2_by(spark.createDataFrame(rows, "year int, value double"), "value", ["year"]).collect()}
    assert got[3].c is None
    for k in (1, 2):
        r, x = got[k], groups[k]
        assert r.nll == pytest.approx(-gb2_logpdf(x, r.c, r.p, r.q, r.b).sum(), rel=1e-9)
        assert r.nll <= fit_gb2(x)[4] + 1e-3
        at = np.log([r.c, r.p, r.q, r.b])
        for j in range(4):  # the likelihood is flat there
            w = at.copy()
            w[j] += 1e-4
            assert abs(gb2_logpdf(x, *np.exp(w)).sum() + r.nll) < 1e-3


def test_map_by_rank_and_qq_frame(spark):
    rng = np.random.default_rng(8)
    x = np.round(incomes(rng, 300), -3)  # with ties
    df = spark.createDataFrame([(i, 1, float(v)) for i, v in enumerate(x)], "id long, year int, value double")
    fits = spark.createDataFrame([(1, 2.0, 1.1, 1.3, 40_000.0)], "year int, c double, p double, q double, b double")
    got = {r.id: r.mapped for r in distributions.map_by_rank(df, "value", ["year"], fits).collect()}
    rank = np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    np.testing.assert_allclose([got[i] for i in range(300)], gb2_ppf((rank - 0.5) / 300, 2.0, 1.1, 1.3, 40_000.0), rtol=1e-9)
    frame = sorted((r.u, r.value, r.fitted) for r in distributions.qq_frame(df, "value", "id", ["year"], fits).collect())
    u = (np.arange(1, 301) - 0.5) / 300
    np.testing.assert_allclose(frame, np.stack([u, np.sort(x), gb2_ppf(u, 2.0, 1.1, 1.3, 40_000.0)], axis=1)[5:-5], rtol=1e-9)


def test_tail_stability_by_mapping_all_scores(spark):
    rng = np.random.default_rng(9)
    truth, scores = incomes(rng, 400), rng.normal(size=150)
    t = spark.createDataFrame([(i, float(v)) for i, v in enumerate(truth)], "id long, value double")
    found = {r.percentile: r for r in distributions.tail_stability(t, "value", "id", spark.createDataFrame([(float(s),) for s in scores], "s double"), "s", 12, seed=2).collect()}
    draws = {}
    for r in stats.resampled(t, ["id"], 12, 2).collect():
        draws.setdefault(r.replicate, []).extend([r.value] * r.draws)
    shares = np.arange(21) / 20
    u = (np.argsort(np.argsort(scores)) + 0.5) / 150
    gb2, qm = [], []
    for own in draws.values():
        c, p, q, b, _ = fit_gb2(np.array(own))
        gb2.append(np.percentile(gb2_ppf(u, c, p, q, b), [90, 95, 99]))
        qm.append(np.percentile(np.interp(scores, np.quantile(scores, shares), np.quantile(own, shares)), [90, 95, 99]))
    for k, p in enumerate((90, 95, 99)):
        r = found[p]
        assert r.qm20_std == pytest.approx(np.std(np.array(qm)[:, k])) and r.qm20_mean == pytest.approx(np.mean(np.array(qm)[:, k]))
        assert r.gb2_mean == pytest.approx(np.mean(np.array(gb2)[:, k]), rel=0.01) and r.gb2_std == pytest.approx(np.std(np.array(gb2)[:, k]), rel=0.1)


def test_bands_of_an_event_study(spark):
    rng = np.random.default_rng(10)
    rows = []
    for u in range(600):
        g = (0, 2, 3)[u % 3]
        own = rng.normal()
        rows += [(u, t, float(own + 0.2 * t + (1.5 if g and t >= g else 0) + rng.normal()), g) for t in range(5)]
    df = spark.createDataFrame(rows, "u long, t int, y double, g int")
    args = (df, "u", "t", "y", "g")
    bands = {r.k: r for r in stats.event_time_bands(*args, replicates=400, seed=1).collect()}
    assert all(r.low <= (1.5 if k >= 0 else 0.0) <= r.high for k, r in bands.items())
    assert all(2.0 < r.critical < 3.2 for r in bands.values())
    psi = stats.influences(*args)
    assert all(abs(r.s) < 1e-6 for r in psi.groupBy("k").agg(F.sum("psi").alias("s")).collect())
    # The deviation of effects over panels with other noise is about the standard error.
    own = []
    for seed in range(12):
        noise = np.random.default_rng(100 + seed)
        other = [(u, t, float(0.2 * t + (1.5 if g and t >= g else 0) + noise.normal()), g) for u, t, _, g in rows]
        own.append({r.k: r.att for r in stats.event_time_effects(stats.group_time_effects(spark.createDataFrame(other, df.schema), "u", "t", "y", "g")).collect()})
    assert np.std([x[0] for x in own]) == pytest.approx(bands[0].se, rel=0.6)


def test_metrics_by_epoch(spark):
    rows = [(e, i % 4, float(i), float(i + e)) for e in range(3) for i in range(20)]
    got = {r.epoch: r for r in stats.metrics_by(spark.createDataFrame(rows, "epoch int, tract int, y double, s double"), ["epoch"], "tract", "y", "s").collect()}
    assert [(got[e].mse, got[e].tract_mse) for e in range(3)] == [(0.0, 0.0), (1.0, 1.0), (4.0, 4.0)]
    assert got[2].r2 == pytest.approx(1 - 4 / np.var(range(20)))
