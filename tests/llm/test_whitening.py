import math

import numpy as np
import pytest

from terrapanel.llm import queries, whitening
from terrapanel.llm.whitening import fit_whitening, identity_error, jacobi, whiten

SCHEMA = "vec_id long, embedding array<float>, n string, component int, place int"
PATH = "/root/testdata/sf0.001"


def brute(vectors, most=32):
    """Whole numbers, exact deviations, eigenvectors of the covariance."""
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s, strict=True)) for row in x]
    centred = (n * x - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(most, int((e > e[0] * 1e-12).sum()))
    return deviation, centred @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check(rows, vectors, ids):
    deviation, white, explained = brute(vectors)
    k = white.shape[1]
    by = {(r.vec_id, r.component): r for r in rows}
    assert len(by) == len(rows) == len(ids) * k
    got = np.array([[by[i, c + 1].whitened for c in range(k)] for i in ids])
    sign = np.sign((got * white).sum(axis=0))
    assert np.allclose(got * sign, white, atol=1e-7)
    for i, d in zip(ids, deviation, strict=True):
        for c in range(k):
            assert int(by[i, c + 1].deviation) == d and math.isclose(by[i, c + 1].explained, explained[c], rel_tol=1e-9)


def test_query_against_eigenvectors(spark):
    table = spark.read.parquet(f"{PATH}/embeddings.parquet").collect()
    rows = queries.queries()["op12_whitening"](spark, PATH).collect()
    check(rows, [r.embedding for r in table], [r.vec_id for r in table])
    assert {r.n for r in rows} == {len(table)} and len({r.identity_error for r in rows}) == 1
    assert 0 <= rows[0].identity_error < 1e-10


@pytest.mark.parametrize("fan_in", [2, 16])
def test_nulls_ragged_and_repeated_rows(spark, monkeypatch, fan_in):
    monkeypatch.setattr(whitening, "FAN_IN", fan_in)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(3)
    good = [(i, [float(np.float32(v)) for v in rng.normal(size=5) * [3, 1, 0.5, 1, 1]]) for i in range(90)]
    good = [(i, [*v[:3], v[1], 0.25]) for i, v in good]  # two equal dimensions and a constant one
    bad = [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0]), (502, [1.0, float("nan"), 0.0, 0.0, 0.0]), (503, [float("inf")] * 5), (504, []), (505, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x", 7, 1) for r in good + bad], SCHEMA).repartition(9)
    model = fit_whitening(df)
    assert model.n == 90 and model.components.shape == (5, 3)
    check(whiten(df, model).collect(), [v for _, v in good], [i for i, _ in good])
    assert identity_error(df, model) < 1e-10
    twice = whiten(df.unionAll(df), fit_whitening(df.unionAll(df)))
    assert twice.count() == 2 * 90 * 3


def test_tables_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (None, [1.0, 2.0])], [(1, None)]):
        df = spark.createDataFrame([(*r, "", 0, 0) for r in rows], SCHEMA)
        assert fit_whitening(df) is None and whiten(df, None).count() == 0


def test_large_entries_keep_exact_deviations(spark):
    df = spark.createDataFrame([(None, [1e300]), (1, [-3e9]), (2, [0.5])], "vec_id long, embedding array<double>")
    x = [(1 << 55) + 1_000_000, -64 * 3 * 10**9 + 1_000_000, 1_000_032]
    rows = whiten(df, fit_whitening(df)).collect()
    assert {r.vec_id: int(r.deviation) if r.deviation is not None else None for r in rows} == {
        i: d if (d := (3 * v - sum(x)) ** 2) < 10**38 else None for i, v in zip((None, 1, 2), x, strict=True)
    }


def test_jacobi_keeps_small_values_accurate():
    rng = np.random.default_rng(5)
    for d in (1, 2, 5, 64):
        v, _ = np.linalg.qr(rng.normal(size=(d, d)))
        u, _ = np.linalg.qr(rng.normal(size=(d, d)))
        length = 2.0 ** -np.arange(d)
        found, right = jacobi((u * length) @ v.T)
        assert np.allclose(right.T @ right, np.eye(d), atol=1e-13)
        assert np.allclose(found, length, rtol=1e-6, atol=1e-15)
    a = rng.normal(size=(9, 6)) * 10.0 ** -np.arange(0, 24, 4)  # columns of very different lengths
    exact = np.array([1.0] * 6)
    for k in range(6):
        exact[k] = np.linalg.norm(a[:, k] - (np.linalg.lstsq(a[:, :k], a[:, k], rcond=None)[0] @ a[:, :k].T if k else 0))
    assert np.allclose(jacobi(a)[0], exact, rtol=1e-5)
