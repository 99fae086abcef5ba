"""Order statistics read their source twice at most, and agree with numpy on values that are alike."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.functions import quantiles, ranks
from terrapanel.plans import registry


def scans(df, table):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Relation [") if table is None else sum(table in line for line in plan.split("\n") if "Relation [" in line)


@pytest.fixture
def tables(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [("hot", float(v), i) for i, v in enumerate(np.where(rng.random(3000) < 0.5, 0.0, rng.lognormal(size=3000)))]
    rows += [(f"g{i % 7}", float(rng.integers(0, 5)), 10_000 + i) for i in range(200)] + [("hot", None, -1), ("none", None, -2), (None, 1.0, -3)]
    spark.createDataFrame(rows, "g string, v double, k long").write.parquet(f"{tmp_path}/source")
    return rows, spark.read.parquet(f"{tmp_path}/source")


def test_counts_places_and_quantiles(tables):
    rows, df = tables
    groups = {g: sorted(v for h, v, _ in rows if h == g and v is not None) for g in {r[0] for r in rows} - {None}}
    counts = quantiles.ordered_counts(df, "v", ["g"])
    for r in counts.collect():
        own = np.array(groups[r.g])
        assert (r["__n"], r["__before"], r["__total"]) == ((own == r.v).sum(), (own < r.v).sum(), len(own))
    placed = ranks.with_place(df, "v", "k", ["g"], "place")
    assert placed.columns == ["g", "v", "k", "place"]
    want = {}
    for g in groups:
        for n, (_, k) in enumerate(sorted((v, k) for h, v, k in rows if h == g and v is not None), 1):
            want[g, k] = n
    got = {(r.g, r.k): r.place for r in placed.where("g IS NOT NULL").collect()}
    assert got == want
    q = {r.g: r.q for r in quantiles.group_quantiles(df, "v", [0.1, 0.5, 0.99], ["g"], "q").collect()}
    for g, own in groups.items():
        if own:
            assert np.allclose(q[g], np.quantile(own, [0.1, 0.5, 0.99]))


@pytest.mark.parametrize("name", ["T1_spearman", "T2_kendall", "T4_rank_autocorrelation", "T13_concordance", "W1_qcut_by_year", "W6_rank_first", "W7_hazen", "A12_spread", "T10_empirical_map", "W2_qcut_global"])
def test_sources_are_read_twice_at_most(spark, name):
    df = registry.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    given = [line for line in plan.split("\n") if "Relation [" in line and ("o_" in line or "s_acctbal" in line)]
    assert len(given) <= 2, len(given)


def test_one_frequent_value_is_dealt_out(spark, tmp_path):
    """Half of the rows have one value; no part of the numbering holds them all."""
    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"), "id").withColumn("g", F.lit(1))
    parts = quantiles.in_parts(df, ["g", "v", "id"]).groupBy("__part").count().collect()
    assert len(parts) >= 4 and max(r["count"] for r in parts) < 20_000
