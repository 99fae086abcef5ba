"""Normal tail, log-gamma, incomplete beta and the GB2 distribution, in numpy, for Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Two-sided 5 % point of the normal distribution.
Z_95 = 1.959963984540054

_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """P(|N| > |z|); null for null."""
    value = z.to_numpy(float, na_value=np.nan)
    known = ~np.isnan(value)
    return pd.Series(_erfc(np.abs(np.where(known, value, 0.0)) / math.sqrt(2))).where(known)


@F.pandas_udf(T.DoubleType())
def student_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| > |t|) of Student's t with ``df`` degrees of freedom; null for null or df <= 0."""
    x, k = t.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan)
    known = ~np.isnan(x) & (k > 0)
    x, k = np.where(known, x, 0.0), np.where(known, k, 1.0)
    return pd.Series(beta_inc(k / 2, np.full(len(k), 0.5), k / (k + x * x))).where(known)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 300) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    d = 1 / safe(1 - (a + b) * x / (a + 1))
    c, out = np.ones_like(x), d
    for m in range(1, steps):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / safe(1 + term * d)
            c = safe(1 + term / c)
            out = out * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return out


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    swap = inside > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - inside, inside)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + p * np.log(y) + q * np.log1p(-y)) / p
    part = front * _fraction(p, q, y)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(swap, 1 - part, part)))


def beta_inv(a, b, p, steps: int = 200) -> np.ndarray:
    """The x with beta_inc(a, b, x) = p, by bisection."""
    a, b, p = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, p)))
    low, high = np.zeros(p.shape), np.ones(p.shape)
    for _ in range(steps):
        mid = (low + high) / 2
        below = beta_inc(a, b, mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
        if np.all(high - low <= 1e-16 * np.maximum(mid, 1e-300) + 1e-18):
            break
    return (low + high) / 2


def gb2_logpdf(x, c, p, q, b) -> np.ndarray:
    """Log density of the generalised beta distribution of the second kind; -inf for x <= 0."""
    x = np.asarray(x, float)
    z = np.log(np.maximum(x, 1e-300) / b)
    const = np.log(c) - np.log(b) - (_lgamma(p) + _lgamma(q) - _lgamma(p + q))
    return np.where(x > 0, const + (c * p - 1) * z - (p + q) * np.logaddexp(0, c * z), -np.inf)


def gb2_cdf(x, c, p, q, b) -> np.ndarray:
    x = np.asarray(x, float)
    z = c * np.log(np.maximum(x, 1e-300) / b)
    return np.where(x > 0, beta_inc(p, q, 1 / (1 + np.exp(-z))), 0.0)


def gb2_sf(x, c, p, q, b) -> np.ndarray:
    """Upper tail, without cancellation."""
    x = np.asarray(x, float)
    z = c * np.log(np.maximum(x, 1e-300) / b)
    return np.where(x > 0, beta_inc(q, p, 1 / (1 + np.exp(z))), 1.0)


def gb2_ppf(u, c, p, q, b) -> np.ndarray:
    v = beta_inv(p, q, u)
    return b * (v / np.maximum(1 - v, 1e-300)) ** (1 / np.asarray(c, float))


def _udf(f):
    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series, c: pd.Series, p: pd.Series, q: pd.Series, b: pd.Series) -> pd.Series:
        args = [s.to_numpy(float, na_value=np.nan) for s in (x, c, p, q, b)]
        ok = ~np.isnan(np.stack(args)).any(axis=0)
        out = np.full(len(x), np.nan)
        if ok.any():
            out[ok] = f(*(a[ok] for a in args))
        return pd.Series(out).where(ok)

    return run


gb2_logpdf_udf, gb2_cdf_udf, gb2_sf_udf, gb2_ppf_udf = map(_udf, (gb2_logpdf, gb2_cdf, gb2_sf, gb2_ppf))


def register(spark) -> None:
    """The distribution as SQL functions gb2_logpdf, gb2_cdf, gb2_sf, gb2_ppf(x, c, p, q, b) two_sided_p(z), student_two_sided_p(t, df)."""
    for name, f in (("gb2_logpdf", gb2_logpdf_udf), ("gb2_cdf", gb2_cdf_udf), ("gb2_sf", gb2_sf_udf), ("gb2_ppf", gb2_ppf_udf), ("two_sided_p", two_sided_p), ("student_two_sided_p", student_two_sided_p)):
        spark.udf.register(name, f)


#: Starts of the fit: shapes c, p, q and the scale in medians.
STARTS = ((2.0, 1.0, 1.0, 1.0), (1.0, 2.0, 2.0, 1.0), (3.0, 0.5, 0.5, 1.0), (1.5, 1.0, 3.0, 2.0))


def fit_gb2(x: np.ndarray, weight: np.ndarray | None = None, rounds: int = 600) -> tuple[float, float, float, float, float]:
    """(c, p, q, b, negative log-likelihood) by maximum likelihood from four starts (Nelder-Mead on logs)."""
    x = np.asarray(x, float)
    weight = np.ones(len(x)) if weight is None else np.asarray(weight, float)
    ok = np.isfinite(x) & (x > 0) & (weight > 0)
    x, weight = x[ok], weight[ok]
    if weight.sum() < 5:
        return (math.nan,) * 5
    order = np.argsort(x)
    scale = float(x[order][np.searchsorted(np.cumsum(weight[order]), weight.sum() / 2)])

    def loss(w: np.ndarray) -> float:
        if np.abs(w).max() > 25:
            return math.inf
        c, p, q, b = np.exp(w)
        value = -float((weight * gb2_logpdf(x, c, p, q, b * scale)).sum())
        return value if math.isfinite(value) else math.inf

    best = min((_nelder_mead(loss, np.log(s), rounds) for s in STARTS), key=lambda r: r[1])
    c, p, q, b = np.exp(best[0])
    return float(c), float(p), float(q), float(b * scale), best[1]


def _digamma(x: float) -> tuple[float, float]:
    """First and second derivative of log-gamma: recurrence up to 10, then the asymptotic series."""
    first = second = 0.0
    while x < 10:
        first -= 1 / x
        second += 1 / x**2
        x += 1
    r = 1 / x**2
    first += math.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    second += 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * 5 / 66))))
    return first, second


def gb2_slopes(w: np.ndarray, sums: dict[str, float]) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and second derivatives in w = log(c, p, q, b), from a group's sums.

    With z = log(x / b), s = logistic(c z), v = s (1 - s): sums of 1 (n), z, the
    softplus of c z (soft), s, z s (zs), v, z v (zv), z z v (zzv).
    """
    c, p, q, _ = np.exp(w)
    n, z, soft, s, zs, v, zv, zzv = (sums[k] for k in ("n", "z", "soft", "s", "zs", "v", "zv", "zzv"))
    (dp, tp), (dq, tq), (d, t) = _digamma(p), _digamma(q), _digamma(p + q)
    value = n * (math.log(c) - w[3] - math.lgamma(p) - math.lgamma(q) + math.lgamma(p + q)) + (c * p - 1) * z - (p + q) * soft
    gradient = np.array([n + c * p * z - (p + q) * c * zs, p * (n * (d - dp) + c * z - soft), q * (n * (d - dq) - soft), -n * c * p + (p + q) * c * s])
    h = np.zeros((4, 4))
    h[0, 0] = c * p * z - (p + q) * c * (zs + c * zzv)
    h[1, 1] = gradient[1] + p * p * n * (t - tp)
    h[2, 2] = gradient[2] + q * q * n * (t - tq)
    h[3, 3] = -(p + q) * c * c * v
    h[0, 1] = p * c * (z - zs)
    h[0, 2] = -q * c * zs
    h[0, 3] = -n * c * p + (p + q) * c * (s + c * zv)
    h[1, 2] = p * q * n * t
    h[1, 3] = p * c * (s - n)
    h[2, 3] = q * c * s
    return value, gradient, h + np.triu(h, 1).T


def _nelder_mead(loss, start: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Simplex search with reflection, expansion, contraction and shrinking."""
    points = np.vstack([start, start + 0.3 * np.eye(len(start))])
    values = np.array([loss(p) for p in points])
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = points[order], values[order]
        if values[-1] - values[0] < 1e-9 * (1 + abs(values[0])):
            break
        centre = points[:-1].mean(axis=0)
        away = centre + (centre - points[-1])
        v = loss(away)
        if v < values[0]:
            further = centre + 2 * (centre - points[-1])
            w = loss(further)
            points[-1], values[-1] = (further, w) if w < v else (away, v)
        elif v < values[-2]:
            points[-1], values[-1] = away, v
        else:
            nearer = centre + 0.5 * ((away if v < values[-1] else points[-1]) - centre)
            w = loss(nearer)
            if w < min(v, values[-1]):
                points[-1], values[-1] = nearer, w
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [loss(p) for p in points[1:]]
    at = int(values.argmin())
    return points[at], float(values[at])
