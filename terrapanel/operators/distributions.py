"""The GB2 distribution by groups: maximum-likelihood fits over all rows, maps, and the stability of their tails."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions import ranks
from terrapanel.functions.numeric import interpolate
from terrapanel.functions.quantiles import group_quantiles, ordered_counts, written
from terrapanel.functions.special import fit_gb2, gb2_ppf_udf, gb2_slopes
from terrapanel.operators.stats import resampled

#: Width of the bins of log(value) in which the search for a start is made; at most 150,000 of them for doubles.
BIN = 0.01
#: Groups that may be fitted at once: their parameters go to the driver and back.
MOST_GROUPS = 10_000
PARAMETERS = ("c", "p", "q", "b")


def _started(df: DataFrame, value: str, by: list[str], weight: Column) -> DataFrame:
    """Fits from counts and means in narrow bins of log(value)."""
    log = F.ln(value)
    bins = df.where(F.col(value) > 0).groupBy(*by, F.floor(log / BIN).alias("__bin"))
    bins = bins.agg(F.sum(weight).cast("double").alias("__w"), (F.sum(weight * log) / F.sum(weight)).alias("__log")).where("__w > 0")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("__bin")
        found = fit_gb2(np.exp(own["__log"].to_numpy()), own["__w"].to_numpy())
        return pd.DataFrame([{**{k: own[k].iloc[0] for k in by}, **dict(zip((*PARAMETERS, "nll"), found, strict=True))}])

    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in by)
    return bins.groupBy(*by).applyInPandas(fit, kinds + "c double, p double, q double, b double, nll double")


def _sums(df: DataFrame, value: str, by: list[str], weight: Column, at: DataFrame) -> DataFrame:
    """What likelihood and derivatives need of each group at the given parameters, over all its rows."""
    own = df.where(F.col(value) > 0).join(F.broadcast(at), by)
    z = F.ln(value) - F.col("w_b")
    t = F.exp("w_c") * z
    s = 1 / (1 + F.exp(-t))
    v = s * (1 - s)
    soft = F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t)))
    terms = {"n": F.lit(1.0), "z": z, "soft": soft, "s": s, "zs": z * s, "v": v, "zv": z * v, "zzv": z * z * v}
    return own.groupBy(*by).agg(*[F.sum(weight * x).alias(name) for name, x in terms.items()])


def fit_gb2_by(df: DataFrame, value: str, by: Sequence[str], weight: Column | None = None, steps: int = 15) -> DataFrame:
    """Rows (by..., c, p, q, b, nll): maximum-likelihood parameters of the positive values of each group.

    A start comes from four simplex searches on bin counts.  It is refined by
    damped Newton steps: each adds up likelihood and derivatives over all rows
    of all groups, in one aggregate; the driver holds four numbers for each
    group, and refuses more than MOST_GROUPS.  ``steps=0`` leaves the start.
    Groups of fewer than five positive values have NULL parameters.
    """
    by, weight = list(by), F.lit(1) if weight is None else weight
    if steps:
        # Each step reads all rows, so what they come from is computed once.
        df = written(df.where(F.col(value) > 0).groupBy(*by, value).agg(F.sum(weight).alias("__weight")), "fitted")
        weight = F.col("__weight")
    start = _started(df, value, by, weight)
    if not steps:
        return start.select(*by, *[F.nanvl(F.col(k), F.lit(None).cast("double")).alias(k) for k in (*PARAMETERS, "nll")])
    found = start.limit(MOST_GROUPS + 1).collect()
    if len(found) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    known = lambda r: r["c"] is not None and not math.isnan(r["c"])
    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by]
    spark, own = df.sparkSession, df.select(*by, value, weight.alias("__weight"))
    state = {tuple(r[k] for k in by): {"w": np.log([r[k] for k in PARAMETERS]), "damp": 1e-3, "best": None} for r in found if known(r)}
    trial = {k: v["w"] for k, v in state.items()}
    for _ in range(steps + 1):
        if not trial:
            break
        at = spark.createDataFrame([(*k, *map(float, w)) for k, w in trial.items()], ", ".join([*kinds, *[f"w_{k} double" for k in PARAMETERS]]))
        seen = {tuple(r[k] for k in by): r.asDict() for r in _sums(own, value, by, F.col("__weight"), at).collect()}
        ahead = {}
        for k, w in trial.items():
            own_state = state[k]
            result = gb2_slopes(w, seen[k])
            better = own_state["best"] is None or result[0] >= own_state["best"][0]
            if better:
                gain = math.inf if own_state["best"] is None else result[0] - own_state["best"][0]
                own_state.update(w=w, best=result, damp=max(own_state["damp"] / 10, 1e-12))
                if gain < 1e-9 * (1 + abs(result[0])):
                    continue
            else:
                own_state["damp"] *= 10
                if own_state["damp"] > 1e6:
                    continue
            _, gradient, curve = own_state["best"]
            scale = np.diag(np.maximum(np.abs(np.diag(curve)), 1e-9))
            step = np.linalg.solve(own_state["damp"] * scale - curve, gradient)
            longest = np.abs(step).max()
            if not np.isfinite(longest) or float(gradient @ step) < 0:
                own_state["damp"] = max(own_state["damp"], 1e-3) * 100
                step = np.linalg.solve(own_state["damp"] * scale + np.abs(np.diag(np.diag(curve))), gradient)
                longest = np.abs(step).max()
            ahead[k] = own_state["w"] + step / max(1.0, longest)
        trial = ahead
    rows = [(*k, *map(float, np.exp(v["w"])), -float(v["best"][0])) for k, v in state.items()]
    rows += [(*(r[k] for k in by), *[None] * 5) for r in found if not known(r)]
    return spark.createDataFrame(rows, ", ".join([*kinds, *[f"{k} double" for k in (*PARAMETERS, "nll")]]))


def _ppf(u: Column) -> Column:
    return gb2_ppf_udf(u, *[F.col(k) for k in PARAMETERS])


def map_by_rank(df: DataFrame, value: str, by: list[str], fits: DataFrame, name: str = "mapped") -> DataFrame:
    """df with values mapped to each group's distribution, their order kept: the quantile at the Hazen position of the average rank."""
    before = ordered_counts(df, value, by)
    u = ranks.hazen(F.col("__before") + (F.col("__n") + 1) / 2, F.col("__total"))
    mapped = before.select(*by, value, u.alias("__u")).join(F.broadcast(fits.select(*by, *PARAMETERS)), by)
    return df.join(mapped.select(*by, value, _ppf(F.col("__u")).alias(name)), [*by, value], "left")


def qq_frame(df: DataFrame, value: str, key: str, by: list[str], fits: DataFrame) -> DataFrame:
    """Rows (by..., key, value, u, fitted): sorted positive data against the fitted quantiles, the outer 5 (or 1 in 200) of each end cut."""
    size = df.where(F.col(value) > 0).groupBy(*by).agg(F.count("*").alias("__size"))
    placed = ranks.with_place(df.where(F.col(value) > 0), value, key, by, "__place").join(size, by)
    trim = F.greatest(F.lit(5), F.floor(F.col("__size") / 200))
    inner = placed.where((F.col("__place") > trim) & (F.col("__place") <= F.col("__size") - trim)).withColumn("u", (F.col("__place") - 0.5) / F.col("__size"))
    inner = inner.join(F.broadcast(fits.select(*by, *PARAMETERS)), by)
    return inner.select(*by, key, value, "u", _ppf(F.col("u")).alias("fitted"))


def tail_stability(truth: DataFrame, value: str, key: str, scores: DataFrame, score: str, replicates: int, percentiles: Sequence[int] = (90, 95, 99), seed: int = 0) -> DataFrame:
    """Rows (percentile, gb2_std, qm20_std, gb2_mean, qm20_mean) over bootstrap resamples of the truth.

    Each resample gives a GB2 fit and 21 quantiles; the fixed scores are mapped
    to both.  Both maps keep the scores' order, so a percentile of the mapped
    scores lies between the maps of the two scores around it; only these are
    mapped.  Fits are made on bins of log(value), which differ from all rows by
    far less than resamples do.
    """
    drawn = resampled(truth.select(key, value).where(F.col(value) > 0), [key], replicates, seed)
    w = F.col("draws")
    fits = fit_gb2_by(drawn, value, ["replicate"], w, steps=0)
    shares = [k / 20 for k in range(21)]
    knots = group_quantiles(drawn, value, shares, ["replicate"], "ys", w)
    source = group_quantiles(scores, score, shares, name="xs")  # one row
    ordered = ordered_counts(scores.where(F.col(score).isNotNull()).withColumn("__all", F.lit(1)), score, ["__all"])
    h = lambda p: F.lit(p / 100) * (F.col("__total") - 1)
    wanted = F.array(*[F.struct(F.lit(p).alias("percentile"), (h(p) - F.floor(h(p))).alias("part"), side.alias("r"), F.lit(k).alias("side")) for p in percentiles for k, side in ((0, F.floor(h(p))), (1, F.ceil(h(p))))])
    near = lambda x: (x["r"] >= F.col("__before")) & (x["r"] < F.col("__before") + F.col("__n"))
    u = ranks.hazen(F.col("__before") + (F.col("__n") + 1) / 2, F.col("__total"))
    around = ordered.withColumn("x", F.explode(F.filter(wanted, near))).select("x.percentile", "x.part", "x.side", F.col(score).alias("v"), u.alias("u"))  # two rows a percentile
    both = knots.join(fits, "replicate").crossJoin(F.broadcast(source)).crossJoin(F.broadcast(around))
    mapped = both.select("replicate", "percentile", "part", "side", _ppf(F.col("u")).alias("gb2"), interpolate(F.col("v"), F.col("xs"), F.col("ys")).alias("qm20"))
    at = lambda c, k: F.max(F.when(F.col("side") == k, F.col(c)))
    between = lambda c: at(c, 0) + F.first("part") * (at(c, 1) - at(c, 0))
    each = mapped.groupBy("replicate", "percentile").agg(between("gb2").alias("gb2"), between("qm20").alias("qm20"))
    return each.groupBy("percentile").agg(
        F.stddev_pop("gb2").alias("gb2_std"), F.stddev_pop("qm20").alias("qm20_std"), F.avg("gb2").alias("gb2_mean"), F.avg("qm20").alias("qm20_mean"), F.count("gb2").alias("replicates")
    )
