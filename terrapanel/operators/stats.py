"""Statistics as aggregates and joins: rank correlations, agreement, stability, bootstrap, event studies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapanel.functions.quantiles import in_parts, ordered_counts, written
from terrapanel.functions.seeded import uniform
from terrapanel.functions.special import student_two_sided_p, two_sided_p
from terrapanel.operators import resamples


def _grouped(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, by) if by else (df.withColumn("__all", F.lit(1)), ["__all"])


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """Correlation of average ranks within groups (rho, n, p); NULL below three rows.

    ``p`` is two-sided, from Student's t.  With a whole-number ``weight`` each
    row counts as so many.
    """
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__w", (F.lit(1) if weight is None else weight).cast("long")).where("__w > 0")
    own, keys = _grouped(own, by or [])
    kind = df.schema[x].dataType.simpleString() if df.schema[x].dataType == df.schema[y].dataType else "double"
    own = written(own.groupBy(*keys, F.col(x).cast(kind).alias("__x"), F.col(y).cast(kind).alias("__y")).agg(F.sum("__w").alias("__w")), "pairs")
    # Both columns' values are counted together, side by side.
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col(k).alias("v")) for k in ("__x", "__y")])).alias("e")
    counts = ordered_counts(own.select(*keys, "__w", each).select(*keys, "__w", "e.c", "e.v"), "v", [*keys, "c"], F.col("__w"))
    for c in ("__x", "__y"):
        # Ranks average (n + 1) / 2; deviations from it keep the sums small.
        off = counts.where(F.col("c") == c).select(*keys, F.col("v").alias(c), (F.col("__before") + (F.col("__n") - F.col("__total")) / 2).alias(f"__d{c}"))
        own = own.join(off, [*keys, c])
    w, dx, dy = F.col("__w"), F.col("__d__x"), F.col("__d__y")
    rho = F.try_divide(F.sum(w * dx * dy), F.nullif(F.sqrt(F.sum(w * dx * dx) * F.sum(w * dy * dy)), F.lit(0.0)))
    out = own.groupBy(*keys).agg(F.when(F.sum("__w") >= 3, rho).alias("rho"), F.sum("__w").alias("n"))
    n = F.col("n").cast("double")
    t = F.col("rho") * F.sqrt(F.try_divide(n - 2, F.nullif(F.greatest(1 - F.col("rho") * F.col("rho"), F.lit(0.0)), F.lit(0.0))))
    out = out.withColumn("p", F.when(F.col("rho").isNotNull(), F.coalesce(student_two_sided_p(t, n - 2), F.lit(0.0))))
    return out if by else out.drop("__all")


def pair_counts(df: DataFrame, x: str, y: str, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """Of all pairs of rows within groups: rows (by..., n, pairs, concordant, discordant, ties_x, ties_y, ties_both, ...).

    No pair is made.  The places of y are written in binary; two rows with
    different y agree in the bits above some bit and differ there.  So for each
    bit, rows with equal bits above it are swept in the order of x, counting
    ones and zeros so far: n log n rows in all, dealt out by bit, bits above
    and range of x.  Also returned are the sums over tie groups that the
    variance of Kendall's statistic needs.
    """
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__w", (F.lit(1) if weight is None else weight).cast("long")).where("__w > 0")
    own, keys = _grouped(own, by or [])
    own = written(own.groupBy(*keys, F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.sum("__w").alias("__w")), "pairs")
    places = ordered_counts(own, "__y", keys, F.col("__w"))
    own = in_parts(own.join(places.select(*keys, "__y", "__before", "__total"), [*keys, "__y"]), [*keys, "__x"], "__bucket").drop("__at")
    # A group's places have as many bits as its size.
    bits = F.length(F.bin(F.col("__total")))
    rows = own.withColumn("__bit", F.explode(F.sequence(F.lit(0), bits - 1)))
    at = lambda n: F.call_function("shiftright", F.col("__before"), n)
    rows = rows.withColumn("__above", at(F.col("__bit") + 1)).withColumn("__one", F.pmod(at(F.col("__bit")), F.lit(2)))
    part = [*keys, "__bit", "__above"]
    w, one = F.col("__w"), F.col("__one")
    cells = rows.groupBy(*part, "__bucket", "__x").agg(F.sum(w * one).alias("__ones"), F.sum(w * (1 - one)).alias("__zeros"))
    buckets = cells.groupBy(*part, "__bucket").agg(F.sum("__ones").alias("__o"), F.sum("__zeros").alias("__z"))
    earlier = W.partitionBy(*part).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    buckets = buckets.select(*part, "__bucket", F.coalesce(F.sum("__o").over(earlier), none).alias("__o"), F.coalesce(F.sum("__z").over(earlier), none).alias("__z"))
    inside = W.partitionBy(*part, "__bucket").orderBy("__x").rowsBetween(W.unboundedPreceding, -1)
    swept = cells.withColumns({"__bo": F.coalesce(F.sum("__ones").over(inside), none), "__bz": F.coalesce(F.sum("__zeros").over(inside), none)})
    swept = swept.join(buckets, [*part, "__bucket"])
    big = lambda c: c.cast("decimal(38,0)")
    counted = swept.groupBy(*keys).agg(
        F.sum(big(F.col("__ones")) * (F.col("__z") + F.col("__bz"))).cast("double").alias("concordant"),
        F.sum(big(F.col("__zeros")) * (F.col("__o") + F.col("__bo"))).cast("double").alias("discordant"),
    )

    def ties(columns: list[str], name: str) -> DataFrame:
        t = F.col("t").cast("double")
        groups = own.groupBy(*keys, *columns).agg(F.sum("__w").alias("t"))
        return groups.groupBy(*keys).agg(
            F.sum(t * (t - 1) / 2).alias(f"ties_{name}"), F.sum(t * (t - 1) * (t - 2)).alias(f"{name}_0"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{name}_1")
        )

    size = F.sum("__w").cast("double")
    out = own.groupBy(*keys).agg(F.sum("__w").alias("n"), (size * (size - 1) / 2).alias("pairs"))
    for other in (counted, ties(["__x"], "x"), ties(["__y"], "y"), ties(["__x", "__y"], "both").drop("both_0", "both_1")):
        out = out.join(other, keys)
    return out if by else out.drop("__all")


def kendall(df: DataFrame, x: str, y: str, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """Kendall's tau-b within groups (tau, n, p), from ``pair_counts``; p is two-sided, by the normal approximation with ties."""
    c = F.col
    n, pairs = c("n").cast("double"), c("pairs")
    s = c("concordant") - c("discordant")
    m = n * (n - 1)
    variance = (m * (2 * n + 5) - c("x_1") - c("y_1")) / 18 + F.try_divide(2 * c("ties_x") * c("ties_y"), m) + F.coalesce(F.try_divide(c("x_0") * c("y_0"), 9 * m * (n - 2)), F.lit(0.0))
    tau = F.try_divide(s, F.nullif(F.sqrt((pairs - c("ties_x")) * (pairs - c("ties_y"))), F.lit(0.0)))
    found = pair_counts(df, x, y, by, weight)
    return found.select(*(by or []), tau.alias("tau"), "n", two_sided_p(F.try_divide(s, F.nullif(F.sqrt(variance), F.lit(0.0)))).alias("p"))


def concordance(df: DataFrame, truth: str, score: str, by: list[str], apart: str) -> DataFrame:
    """Rows (by..., concordance, n): of pairs within groups that differ in ``apart``, the share whose truth and score differ alike.

    Pairs with equal truth and equal score count as alike, pairs that are equal
    in one only do not.
    """
    counts = lambda keys: pair_counts(df, truth, score, keys).select(*keys, "pairs", (F.col("concordant") + F.col("ties_both")).alias("alike"))
    same = counts([*by, apart]).groupBy(*by).agg(F.sum("pairs").alias("same_pairs"), F.sum("alike").alias("same_alike"))
    left = counts(by).join(same, by).select(*by, (F.col("alike") - F.col("same_alike")).alias("alike"), (F.col("pairs") - F.col("same_pairs")).cast("long").alias("n"))
    return left.select(*by, F.try_divide(F.col("alike"), F.nullif(F.col("n"), F.lit(0))).alias("concordance"), "n")


def metrics_by(df: DataFrame, by: list[str], tract: str, truth: str, score: str) -> DataFrame:
    """Rows (by..., mse, tract_mse, r2, n): squared errors of rows and of tract means, and 1 - SSE / SST."""
    error = F.col(truth) - F.col(score)
    tracts = df.groupBy(*by, tract).agg(F.avg(truth).alias("__t"), F.avg(score).alias("__s"))
    far = F.col("__t") - F.col("__s")
    means = tracts.groupBy(*by).agg(F.avg(far * far).alias("tract_mse"))
    rows = df.groupBy(*by).agg(F.avg(error * error).alias("mse"), (1 - F.try_divide(F.avg(error * error), F.nullif(F.var_pop(truth), F.lit(0.0)))).alias("r2"), F.count("*").alias("n"))
    return rows.join(means, by).select(*by, "mse", "tract_mse", "r2", "n")


def ranking_loss(rows: DataFrame, batch: list[str], unit: str, tract: str, score: str, label: str, level: str, least: DataFrame, twins: DataFrame, changed: str) -> DataFrame:
    """Pairwise logistic ranking loss of each batch, as a metric: rows (batch..., stage, cross, stable, change, variance, loss, n_pairs).

    rows: the anchor year's rows, dealt into batches of bounded size, which
    alone are paired.  ``least``: stages with the least difference of ``level``
    (columns stage, least_diff).  twins: other years' rows of a batch's units
    (batch..., unit, score, label, changed).  The parts: softplus of minus the
    signed score difference, over pairs of different tracts; squared difference
    of scores of stable twins; softplus for changed twins; squared distance of
    the scores' deviation from 1.
    """
    side = lambda n: rows.select(*batch, *[F.col(c).alias(f"{n}_{k}") for k, c in (("u", unit), ("t", tract), ("s", score), ("z", label), ("v", level))])
    softplus = lambda d: F.greatest(-d, F.lit(0.0)) + F.log1p(F.exp(-F.abs(d)))
    c = F.col
    pairs = side("a").join(side("b"), batch).where((c("a_u") < c("b_u")) & (c("a_t") != c("b_t"))).join(F.broadcast(least), F.abs(c("a_v") - c("b_v")) >= c("least_diff"))
    delta = F.signum((c("b_z") - c("a_z")).cast("double")) * (c("b_s") - c("a_s"))
    cross = pairs.groupBy(*batch, "stage").agg(F.avg(softplus(delta)).alias("cross"), F.count("*").alias("n_pairs"))
    anchor = rows.select(*batch, F.col(unit).alias("u"), F.col(score).alias("s"), F.col(label).alias("z"))
    met = twins.select(*batch, F.col(unit).alias("u"), F.col(score).alias("ts"), F.col(label).alias("tz"), F.col(changed).alias("ch")).join(anchor, [*batch, "u"])
    moved = F.signum((c("tz") - c("z")).cast("double")) * (c("ts") - c("s"))
    stable = F.avg(F.when(~c("ch"), (c("ts") - c("s")) * (c("ts") - c("s"))))
    temporal = met.groupBy(*batch).agg(stable.alias("stable"), F.avg(F.when(c("ch"), softplus(moved))).alias("change"))
    spread = rows.groupBy(*batch).agg(F.stddev_samp(score).alias("sd")).select(*batch, ((c("sd") - 1) * (c("sd") - 1)).alias("variance"))
    none = F.lit(0.0)
    all_ = spread.crossJoin(F.broadcast(least.select("stage"))).join(cross, [*batch, "stage"], "left").join(temporal, batch, "left")
    parts = {k: F.coalesce(c(k), none) for k in ("cross", "stable", "change", "variance")}
    return all_.select(*batch, "stage", *[v.alias(k) for k, v in parts.items()], sum(parts.values(), none).alias("loss"), F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"))


def rank_autocorrelation(df: DataFrame, unit: str, year: str, value: str, first: int, last: int) -> DataFrame:
    """Spearman correlation between two years, over units that have both."""
    wide = df.where(F.col(year).isin(first, last)).groupBy(unit).agg(
        F.min(F.when(F.col(year) == first, F.col(value))).alias("a"), F.min(F.when(F.col(year) == last, F.col(value))).alias("b")
    )
    return spearman(wide, "a", "b").select("rho", "n")


def intraclass(df: DataFrame, unit: str, value: str) -> DataFrame:
    """Variance between units over that plus the mean variance within; population variances, units of two rows and more."""
    units = df.where(F.col(value).isNotNull()).groupBy(unit).agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"), F.count("*").alias("n")).where("n >= 2")
    return units.agg(F.var_pop("m").alias("between"), F.avg("v").alias("within"), F.count("*").alias("n_units")).withColumn(
        "icc", F.try_divide(F.col("between"), F.nullif(F.col("between") + F.col("within"), F.lit(0.0)))
    )


def stability(df: DataFrame, unit: str, value: str) -> DataFrame:
    """For each unit of two rows and more: deviation, and the median distance from the unit's mean."""
    own = df.select(unit, value).where(F.col(value).isNotNull())
    means = own.groupBy(unit).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("sd"), F.count("*").alias("n")).where("n >= 2")
    # A unit has a row a year: a handful, so its median may be taken in one task.
    far = own.join(means, unit).groupBy(unit).agg(F.median(F.abs(F.col(value) - F.col("__mean"))).alias("mad"), F.first("sd").alias("sd"), F.first("n").alias("n"))
    return far


def pairs_within(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Pairs of rows of one key, the earlier as a, the later as b.  For keys of few rows, such as a unit's years."""
    a = df.select(key, *[F.col(c).alias(f"a_{c}") for c in {order, *columns}])
    b = df.select(key, *[F.col(c).alias(f"b_{c}") for c in {order, *columns}])
    return a.join(b, key).where(F.col(f"a_{order}") < F.col(f"b_{order}"))


def temporal_consistency(df: DataFrame, unit: str, year: str, truth: str, score: str, changed: str) -> DataFrame:
    """Mean absolute score difference of pairs of years, for stable and changed units, and the share of right directions."""
    pairs = pairs_within(df, unit, year, [truth, score, changed])
    diff = F.abs(F.col(f"b_{score}") - F.col(f"a_{score}"))
    right = F.signum(F.col(f"b_{score}") - F.col(f"a_{score}")) == F.signum(F.col(f"b_{truth}") - F.col(f"a_{truth}"))
    return pairs.agg(
        F.avg(F.when(~F.col(f"a_{changed}"), diff)).alias("masd_stable"),
        F.avg(F.when(F.col(f"a_{changed}"), diff)).alias("masd_changed"),
        F.avg(F.when(F.col(f"a_{changed}"), right.cast("double"))).alias("directional_accuracy"),
        F.count("*").alias("n_pairs"),
    )


def resampled(df: DataFrame, keys: list[str], replicates: int, seed: int = 0) -> DataFrame:
    """df once for each replicate that draws it, with ``replicate`` and ``draws`` (Poisson with mean 1, from 1 on).

    Every row draws its own counts from a hash of its key, so resamples need no
    index over all rows and don't depend on partitioning.
    """
    reps = F.explode(F.sequence(F.lit(1), F.lit(replicates)))
    drawn = df.withColumn("replicate", reps).withColumn("__u", uniform(seed, F.col("replicate"), *map(F.col, keys)))
    bounds = resamples.draw_bounds()
    # The first bound decides who is drawn; a condition on all of them would be pushed down with a hash in each.
    drawn = drawn.where(F.col("__u") > bounds[0])
    counts = sum([(F.col("__u") > b).cast("int") for b in bounds[1:]], F.lit(1))  # by inversion
    return drawn.withColumn("draws", counts).drop("__u")


def bootstrap_mean(df: DataFrame, keys: list[str], value: str, replicates: int, seed: int = 0) -> DataFrame:
    """Means of a value in resamples: rows (replicate, mean).

    Tasks add up their rows' draws for all replicates; rows are not repeated.
    """
    sums = resamples.mean_sums(df, keys, value, replicates, seed).groupBy("replicate").agg(F.sum("total").alias("total"), F.sum("known").alias("known"), F.sum("draws").alias("draws"))
    return sums.where("draws > 0").select("replicate", F.when(F.col("known") > 0, F.try_divide("total", "draws")).alias("mean"))


def percentile_interval(df: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """One row: low, high and median of a statistic's replicates, and their number."""
    tail = (1 - level) / 2
    q = F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail), F.lit(0.5)))  # a few thousand replicates
    return df.agg(q[0].alias("low"), q[1].alias("high"), q[2].alias("median"), F.count(value).alias("n"))


def rank_intervals(df: DataFrame, keys: list[str], x: str, y: str, replicates: int, seed: int = 0) -> DataFrame:
    """Bootstrap intervals of both rank correlations: rows (statistic, low, high, median, n)."""
    found = written(resamples.rank_correlations(df, keys, x, y, replicates, seed), "correlations")  # a row a replicate
    rho, tau = (percentile_interval(found, c).withColumn("statistic", F.lit(name)) for c, name in (("rho", "spearman"), ("tau", "kendall")))
    return rho.unionByName(tau).select("statistic", "low", "high", "median", "n")


def group_time_effects(df: DataFrame, unit: str, time: str, outcome: str, group: str) -> DataFrame:
    """ATT(g, t) against never-treated units: rows (g, t, att, n_treated, n_control).

    For t >= g the base period is the last one before g, for t < g the one
    before t.  Groups that are treated in the first period are dropped (group
    0 is never treated).
    """
    periods = df.select(time).distinct()
    before = periods.alias("p").join(periods.alias("q"), F.col(f"q.{time}") < F.col(f"p.{time}")).groupBy(F.col(f"p.{time}").alias("t")).agg(F.max(f"q.{time}").alias("prev"))
    groups = df.where(F.col(group) > 0).select(F.col(group).alias("g")).distinct()
    # Periods and groups are the few distinct values of two columns; Spark picks the join by their size.
    g_base = groups.join(periods, F.col(time) < F.col("g")).groupBy("g").agg(F.max(time).alias("g_base"))
    cells = g_base.crossJoin(before).withColumn("base", F.when(F.col("t") >= F.col("g"), F.col("g_base")).otherwise(F.col("prev"))).select("g", "t", "base")
    own = df.select(F.col(unit).alias("u"), F.col(time).alias("time"), F.col(outcome).alias("y"), F.col(group).alias("grp"))
    now, then = own.alias("n"), own.alias("b")
    steps = cells.select("t", "base").distinct()
    change = (
        now.join(steps, F.col("n.time") == F.col("t"))
        .join(then, (F.col("n.u") == F.col("b.u")) & (F.col("b.time") == F.col("base")))
        .groupBy("t", "base", F.col("n.grp").alias("grp"))
        .agg(F.avg(F.col("n.y") - F.col("b.y")).alias("d"), F.count("*").alias("n"))
    )
    treated, control = change.alias("x"), change.where("grp = 0").alias("c")
    return (
        cells.alias("k")
        .join(treated, (F.col("k.t") == F.col("x.t")) & (F.col("k.base") == F.col("x.base")) & (F.col("k.g") == F.col("x.grp")))
        .join(control, (F.col("k.t") == F.col("c.t")) & (F.col("k.base") == F.col("c.base")))
        .select("g", F.col("k.t").alias("t"), (F.col("x.d") - F.col("c.d")).alias("att"), F.col("x.n").alias("n_treated"), F.col("c.n").alias("n_control"))
    )


def influences(df: DataFrame, unit: str, time: str, outcome: str, group: str) -> DataFrame:
    """Rows (unit, k, psi): each unit's influence on the effect at event time k, as a deviation from it times the number of units.

    An effect's sum of influences is 0; the mean of their squares over the
    number of units is its variance.  Groups' sizes are taken as given.
    """
    att = group_time_effects(df, unit, time, outcome, group)
    base = F.when(F.col("t") >= F.col("g"), F.col("__g_base")).otherwise(F.col("__prev"))
    periods = df.select(time).distinct()
    before = periods.alias("p").join(periods.alias("q"), F.col(f"q.{time}") < F.col(f"p.{time}")).groupBy(F.col(f"p.{time}").alias("t")).agg(F.max(f"q.{time}").alias("__prev"))
    g_base = att.select("g").distinct().join(periods, F.col(time) < F.col("g")).groupBy("g").agg(F.max(time).alias("__g_base"))
    k_total = att.groupBy((F.col("t") - F.col("g")).alias("k")).agg(F.sum("n_treated").alias("__k_n"))
    cells = att.join(before, "t").join(g_base, "g").withColumn("base", base).withColumn("k", F.col("t") - F.col("g")).join(k_total, "k")
    cells = cells.select("g", "t", "k", "base", "n_treated", "n_control", (F.col("n_treated") / F.col("__k_n")).alias("share"))  # a handful of rows
    own = df.select(F.col(unit).alias("u"), F.col(time).alias("time"), F.col(outcome).alias("y"), F.col(group).alias("grp"))
    now, then = own.alias("n"), own.alias("b")
    change = (
        now.join(F.broadcast(cells), (F.col("n.time") == F.col("t")) & ((F.col("n.grp") == F.col("g")) | (F.col("n.grp") == 0)))
        .join(then, (F.col("n.u") == F.col("b.u")) & (F.col("b.time") == F.col("base")))
        .select(F.col("n.u").alias("u"), F.col("n.grp").alias("grp"), "g", "t", "k", "share", "n_treated", "n_control", (F.col("n.y") - F.col("b.y")).alias("d"))
    )
    means = change.groupBy("g", "t", "grp").agg(F.avg("d").alias("__mean"))
    size = df.select(unit).distinct().agg(F.count("*").alias("__units"))
    far = change.join(F.broadcast(means), ["g", "t", "grp"]).crossJoin(F.broadcast(size)).withColumn("far", F.col("d") - F.col("__mean"))
    part = F.when(F.col("grp") == F.col("g"), F.col("far") / F.col("n_treated")).otherwise(-F.col("far") / F.col("n_control"))
    return far.groupBy(F.col("u").alias(unit), "k").agg(F.sum(F.col("share") * part * F.col("__units")).alias("psi"), F.first("__units").alias("units"))


#: Groups of units that share a multiplier, so that a replicate is a sum over as many rows however many units there are.
MULTIPLIER_GROUPS = 4096


def event_time_errors(psi: DataFrame) -> DataFrame:
    """Rows (k, se): standard errors of the effects by event time."""
    return psi.groupBy("k").agg((F.sqrt(F.sum(F.col("psi") * F.col("psi"))) / F.first("units")).alias("se"))


def event_time_bands(df: DataFrame, unit: str, time: str, outcome: str, group: str, replicates: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Effects by event time with standard errors and simultaneous bands: rows (k, att, n, se, critical, low, high).

    Multiplier bootstrap: each replicate flips the influences' signs at random
    (by a hash of replicate and unit group) and adds them up for all event
    times alike; the critical value is the quantile of the largest deviation,
    in standard errors, over the event times.
    """
    psi = influences(df, unit, time, outcome, group)
    errors = event_time_errors(psi)
    salted = psi.groupBy(F.pmod(F.xxhash64(F.col(unit), F.lit(seed)), F.lit(MULTIPLIER_GROUPS)).alias("salt"), "k").agg(F.sum("psi").alias("psi"), F.first("units").alias("units"))
    drawn = salted.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    sign = F.when(uniform(seed, F.col("replicate"), F.col("salt")) < 0.5, -1.0).otherwise(1.0)
    sums = drawn.groupBy("replicate", "k").agg((F.sum(sign * F.col("psi")) / F.first("units")).alias("off"))
    largest = sums.join(F.broadcast(errors), "k").groupBy("replicate").agg(F.max(F.try_divide(F.abs("off"), F.nullif(F.col("se"), F.lit(0.0)))).alias("t"))
    critical = largest.agg(F.percentile("t", F.lit(level)).alias("critical"))  # one value a replicate
    effects = event_time_effects(group_time_effects(df, unit, time, outcome, group)).join(errors, "k").crossJoin(F.broadcast(critical))
    wide = F.col("critical") * F.col("se")
    return effects.select("k", "att", "n", "se", "critical", (F.col("att") - wide).alias("low"), (F.col("att") + wide).alias("high"))


def event_time_effects(att: DataFrame) -> DataFrame:
    """Effects by time since treatment, groups weighted by size."""
    return att.groupBy((F.col("t") - F.col("g")).alias("k")).agg((F.sum(F.col("att") * F.col("n_treated")) / F.sum("n_treated")).alias("att"), F.sum("n_treated").alias("n"))


def simple_effect(att: DataFrame) -> DataFrame:
    """One effect over all periods from treatment on, weighted by size."""
    return att.where("t >= g").agg((F.sum(F.col("att") * F.col("n_treated")) / F.sum("n_treated")).alias("att"), F.sum("n_treated").alias("n"))


def polynomial_fit(df: DataFrame, by: list[str], x: str, y: str, degree: int) -> DataFrame:
    """Least-squares coefficients of each group (coef, highest power first); NULL where there are too few points.

    Powers are added up by aggregates around the groups' means of x; only the
    small systems of equations are solved in Python.
    """
    own = df.select(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).where("__x IS NOT NULL AND __y IS NOT NULL")
    scale = own.groupBy(*by).agg(F.avg("__x").alias("__mean"), F.coalesce(F.nullif(F.max(F.abs("__x")), F.lit(0.0)), F.lit(1.0)).alias("__scale"), F.count_distinct("__x").alias("__k"))
    z = (F.col("__x") - F.col("__mean")) / F.col("__scale")
    power = lambda k: F.lit(1.0) if not k else F.pow(z, F.lit(float(k)))
    sums = own.join(scale, by).groupBy(*by).agg(
        F.array(*[F.sum(power(k)) for k in range(2 * degree + 1)]).alias("left"), F.array(*[F.sum(power(k) * F.col("__y")) for k in range(degree + 1)]).alias("right"),
        *[F.first(c).alias(c) for c in ("__mean", "__scale", "__k")],
    )

    @F.pandas_udf("array<double>")
    def solve(left: pd.Series, right: pd.Series, mean: pd.Series, scale: pd.Series, k: pd.Series) -> pd.Series:
        out = []
        for p, q, m, s, n in zip(left, right, mean, scale, k, strict=True):
            if n <= degree:
                out.append(None)
                continue
            own = np.linalg.solve(np.array([[p[i + j] for j in range(degree + 1)] for i in range(degree + 1)]), np.asarray(q))
            shifted = np.poly1d(own[::-1])(np.poly1d([1 / s, -m / s]))
            out.append(np.r_[np.zeros(degree + 1 - len(shifted.c)), shifted.c].tolist())
        return pd.Series(out)

    return sums.select(*by, solve("left", "right", "__mean", "__scale", "__k").alias("coef"))


def smooth_parameters(df: DataFrame, year: str, names: list[str], degree: int = 3) -> DataFrame:
    """Positive parameters by year, smoothed by a polynomial of their logarithms.

    There is one row for each year, a handful, so one small group.  Fewer than
    three years stay as they are.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[year] - pdf[year].mean()
        for c in names:
            ok = pdf[c] > 0
            if ok.sum() < 3:
                continue
            k = min(degree, int(ok.sum()) - 1)
            pdf[c] = np.exp(np.polyval(np.polyfit(x[ok], np.log(pdf.loc[ok, c]), k), x))
        return pdf[[year, *names]]

    kinds = f"`{year}` {df.schema[year].dataType.simpleString()}, " + ", ".join(f"`{c}` double" for c in names)
    return df.select(year, *names).withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(run, kinds)
