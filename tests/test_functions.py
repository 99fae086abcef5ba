import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrapanel.functions import bins, numeric, ranks, seeded, special
from terrapanel.functions.moments import excess_kurtosis, skew


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("__one"))
    return row.select(column.alias("out")).first().out


def test_guarded_arithmetic(spark):
    df = spark.createDataFrame([(1.0, 0.0, "-666666666"), (None, 2.0, "x"), (float("nan"), 4.0, "7.5")], "a double, b double, c string")
    got = numeric.normalise(df).select(
        numeric.ratio(F.col("a"), F.col("b"), 100).alias("r"),
        numeric.sum_or_zero([F.col("a"), F.col("b")]).alias("s"),
        numeric.numeric_or_null(F.col("c")).alias("n"),
        numeric.clip(F.col("b"), 1.0, 3.0).alias("k"),
        numeric.log_positive(F.col("b")).alias("l"),
        numeric.finite(F.col("a")).alias("f"),
    ).collect()
    assert [r.r for r in got] == [None, None, None]
    assert [r.s for r in got] == [1.0, 2.0, 4.0]
    assert [r.n for r in got] == [None, None, 7.5]
    assert [r.k for r in got] == [1.0, 2.0, 3.0]
    assert got[0].l is None and got[1].l == pytest.approx(math.log(2))
    assert [r.f for r in got] == [True, False, False]


def test_years_and_labels(spark):
    df = spark.createDataFrame([(2010,), (2012,), (2025,), (None,)], "y int")
    got = df.select(numeric.nearest(F.col("y"), [2024, 2014, 2009]).alias("n"), numeric.first_at_or_after(F.col("y"), [2010, 2014]).alias("f")).collect()
    assert [tuple(r) for r in got] == [(2009, 2010), (2014, 2014), (2024, None), (None, None)]
    tie = spark.createDataFrame([(2012,)], "y int").select(numeric.nearest(F.col("y"), [2014, 2010]).alias("n")).first()
    assert tie.n == 2010
    label = numeric.last_label_wins([(F.col("y") > 2000, "a"), (F.col("y") > 2011, "b")], "none")
    assert [r.l for r in df.select(label.alias("l")).collect()] == ["a", "b", "b", "none"]


def test_interpolation_matches_numpy(spark):
    xs, ys = [0.0, 1.0, 1.0, 4.0], [1.0, 2.0, 5.0, 0.0]
    points = [-1.0, 0.0, 0.5, 1.5, 4.0, 9.0]
    df = spark.createDataFrame([(p,) for p in points], "x double")
    out = df.select(numeric.interpolate(F.col("x"), F.array(*map(F.lit, xs)), F.array(*map(F.lit, ys))).alias("y")).collect()
    assert [r.y for r in out] == pytest.approx(np.interp(points, xs, ys).tolist())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=40), st.integers(2, 6))
def test_qcut_matches_its_definition(spark, values, q):
    df = spark.createDataFrame([(float(v), 1) for v in values], "v double, g int")
    edges = sorted(set(np.quantile(values, np.linspace(0, 1, q + 1)).tolist()))
    want = sorted((float(v), sum(e < v for e in edges[1:-1])) for v in values)
    for out in (bins.qcut(df, "v", q), bins.qcut(df, "v", q, ["g"])):
        assert sorted((r.v, r.bin) for r in out.collect()) == want


def test_exact_quantiles_match_numpy(spark):
    from terrapanel.functions.quantiles import group_quantiles

    rng = np.random.default_rng(9)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 900), np.round(rng.exponential(5, 900), 1), strict=True)] + [(7, 2.0), (8, None), (0, 1e9)]
    df, shares = spark.createDataFrame(rows, "g int, v double"), [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r.g: r.q for r in group_quantiles(df, "v", shares, ["g"], "q").collect()}
    assert set(got) == {0, 1, 2, 7}
    for g, q in got.items():
        assert q == pytest.approx(np.quantile([v for k, v in rows if k == g], shares).tolist())
    whole = group_quantiles(df, "v", shares).first().quantiles
    assert whole == pytest.approx(np.quantile([v for _, v in rows if v is not None], shares).tolist())
    assert group_quantiles(df.limit(0), "v", shares).count() == 0


def test_ranks(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 1.0), (1, 3.0), (1, None), (2, 5.0)], "g int, v double")
    want = {(1, 3.0): 2.5, (1, 1.0): 1.0, (1, None): None, (2, 5.0): 1.0}
    assert {(r.g, r.v): r.r for r in ranks.with_average_rank(df, "v", ["g"], "r").collect()} == want


def test_moments(spark):
    x = np.random.default_rng(1).gamma(2, size=50)
    z = (x - x.mean()) / x.std(ddof=1)
    row = spark.createDataFrame([(float(v),) for v in x], "v double").agg(skew(F.col("v")).alias("s"), excess_kurtosis(F.col("v")).alias("k")).first()
    assert (row.s, row.k) == (pytest.approx((z**3).mean()), pytest.approx((z**4).mean() - 3))
    few = spark.createDataFrame([(1.0,), (1.0,)], "v double").agg(skew(F.col("v")).alias("s"), excess_kurtosis(F.col("v")).alias("k")).first()
    flat = spark.createDataFrame([(1.0,)] * 5, "v double").agg(skew(F.col("v")).alias("s"), excess_kurtosis(F.col("v")).alias("k")).first()
    assert tuple(few) == (None, None) and tuple(flat) == (0.0, 0.0)


def test_samples_don_t_depend_on_partitions(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    for sample in (lambda x: seeded.sample_n(x, 20, 4, "id"), lambda x: seeded.sample_per_group(x, ["g"], 5, 4, "id")):
        assert {r.id for r in sample(df).collect()} == {r.id for r in sample(df.repartition(7)).collect()}
    u = [r.u for r in df.select(seeded.uniform(1, F.col("id")).alias("u")).collect()]
    assert 0 < min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.05
    heavy = df.withColumn("w", F.when(F.col("id") < 50, 100.0).otherwise(1.0)).orderBy(seeded.weighted_key(F.col("w"), 2, F.col("id"))).limit(40)
    assert heavy.where("id < 50").count() > 25


def test_special_functions(spark):
    assert special.beta_inc(2, 3, 0.4) == pytest.approx(0.5248)
    assert special.beta_inc(1, 1, 0.3) == pytest.approx(0.3)
    u = np.array([1e-6, 0.01, 0.3, 0.5, 0.9, 0.999])
    for args in ((2.0, 1.5, 0.7, 3.0), (6.0, 0.3, 5.0, 50.0)):
        assert special.gb2_cdf(special.gb2_ppf(u, *args), *args) == pytest.approx(u, rel=1e-8)
        assert special.gb2_cdf(2.0, *args) + special.gb2_sf(2.0, *args) == pytest.approx(1)
    # p = q = 1 is the log-logistic case, which has a closed form.
    assert special.gb2_ppf(u, 3.0, 1.0, 1.0, 7.0) == pytest.approx(7 * (u / (1 - u)) ** (1 / 3), rel=1e-9)
    x = np.linspace(0.01, 40, 40_000)
    assert np.trapezoid(np.exp(special.gb2_logpdf(x, 2.0, 1.5, 3.0, 2.0)), x) == pytest.approx(1, abs=1e-3)
    grid = (np.arange(1, 401) - 0.5) / 400
    c, p, q, b, _ = special.fit_gb2(50 * (grid / (1 - grid)) ** (1 / 3))
    assert special.gb2_ppf(np.array([0.1, 0.5, 0.9]), c, p, q, b) == pytest.approx(50 * (np.array([1 / 9, 1, 9])) ** (1 / 3), rel=0.01)
    special.register(spark)
    row = spark.sql("select two_sided_p(1.959963984540054) as p, gb2_cdf(7D, 3D, 1D, 1D, 7D) as c, two_sided_p(cast(null as double)) as n").first()
    assert (row.p, row.c, row.n) == (pytest.approx(0.05), pytest.approx(0.5), None)
