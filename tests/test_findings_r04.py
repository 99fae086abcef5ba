"""Cases that a second review found: means that tie as decimals only, pairs of many polygons."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from terrapanel.functions.numeric import exact_mean
from terrapanel.operators import polygons
from terrapanel.plans import registry
from test_findings_r03 import embeddings, rows_and_sql, suppliers


def test_means_that_tie_as_decimals_only(spark, tmp_path):
    """two units whose prices add up to the same decimal number, but not to the same double."""
    rows = [(5695, 80671.46), (5695, 91764.01), (6356, 20095.58), (6356, 152339.89)]
    columns = {"o_orderkey": pa.array(range(len(rows)), pa.int64()), "o_custkey": pa.array([u for u, _ in rows], pa.int64()), "o_totalprice": pa.array([v for _, v in rows], pa.float64())}
    columns["o_orderdate"] = pa.array([np.datetime64("1999-05-01", "us")] * len(rows), pa.timestamp("us"))
    pq.write_table(pa.table(columns), f"{tmp_path}/orders.parquet")
    got, want = rows_and_sql(spark, tmp_path, "W6_rank_first", ["orders"])
    assert got == want == [(5695, 1999, 2), (6356, 1999, 1)]


def test_exact_means_are_rounded_once(spark):
    """the mean is that of the exact sum of the doubles, for large, small and negative ones."""
    rng = np.random.default_rng(5)
    groups = [(rng.uniform(-1, 1, n) * 10.0 ** rng.integers(-6, 14, n)).tolist() for n in range(1, 60)] + [[1e14] * 9, [None], [1e300, 2.0]]
    df = spark.createDataFrame([(i, v) for i, own in enumerate(groups) for v in own], "g int, v double")
    got = {r.g: r.m for r in df.groupBy("g").agg(exact_mean(registry.F.col("v")).alias("m")).collect()}
    assert got.pop(60) is None and got.pop(61) == 5e299
    assert all(math.isclose(got[i], math.fsum(groups[i]) / len(groups[i]), rel_tol=4e-16, abs_tol=1e-20) for i in got)


def some_shapes(spark, n):
    """Boxes with a hole or a second part on a small grid, whose edges often touch, larger ones, spikes, lines, and shapes with slanting edges."""
    rng = np.random.default_rng(6)
    ring = lambda *at: [(float(x), float(y)) for x, y in [*at, at[0]]]
    square = lambda x, y, w, h: ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))
    rows = []
    for k in range(n):
        x, y = rng.integers(0, 60, 2)
        w, h = rng.integers(3, 40 if k % 10 == 0 else 8, 2)
        shape = {
            0: [[square(x, y, w, h), square(x + 1, y + 1, 1, 1)]],
            1: [[square(x, y, w, h)], [square(x + w + 1, y, 2, 2)]],
            2: [[ring((x, y), (x + w, y), (x + w, y + 1), (x + 1, y + 1), (x + 1, y + h), (x, y + h))]],
            3: [[ring((x, y), (x + w, y), (x + w, y + h), (x + w + 5, y + h), (x + w, y + h), (x, y + h))]],
            4: [[ring((x, y), (x + w, y))]],
            5: [[ring((x, y), (x + w, y + 1), (x, y + h))]],
            6: [],
        }[k % 7 if k % 3 else k % 3]
        rows.append((k, shape))
    kind = "id long, parts array<array<array<struct<x: double, y: double>>>>"
    return spark.createDataFrame([*rows, (n, None)], kind).localCheckpoint()


def test_polygons_of_upright_and_level_edges_are_unions_of_boxes():
    """the boxes of a shape, what bounds nothing, and what is no such shape."""
    ring = lambda *at: [{"x": float(x), "y": float(y)} for x, y in [*at, at[0]]]
    square = lambda x, y, w, h: ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))
    boxes = lambda value: [tuple(found[k : k + 4]) for k in range(0, len(found), 4)] if (found := polygons._boxes(value)) else found
    assert boxes([[square(0, 0, 4, 4), square(1, 1, 2, 2)], [square(6, 0, 1, 1)]]) == [(0, 0, 4, 1), (0, 1, 1, 3), (0, 3, 4, 4), (3, 1, 4, 3), (6, 0, 7, 1)]
    assert boxes([[ring((0, 0), (2, 0), (2, 1), (5, 1), (2, 1), (2, 2), (0, 2))]]) == [(0, 0, 2, 2), (2, 1, 5, 1)]
    assert boxes([[ring((1, 1), (1, 4))]]) == [(1, 1, 1, 4)] and boxes([[ring((1, 1), (4, 1))]]) == [(1, 1, 4, 1)]
    assert boxes([[ring((0, 0), (1, 1), (0, 2))]]) is None and boxes([]) is None and boxes(None) is None
    assert boxes([[square(0, 0, 2, 2)], [square(1, 1, 2, 2)]]) is None  # parts that overlap


@pytest.mark.parametrize("radius", [0.0, 2.5])
def test_pairs_of_boxes_in_blocks(spark, monkeypatch, radius):
    """distances, areas and the best partner by blocks, with slanting shapes among them, as by edges."""
    monkeypatch.setattr(polygons, "BLOCK", 9)
    F, s = registry.F, some_shapes(spark, 120)
    side = lambda k: s.select(F.col("id").alias(k), F.col("parts").alias(f"p{k}"))
    args = (side("a"), side("b"), "a", "b", "pa", "pb", radius)
    far = {(r.a, r.b): r.distance for r in polygons.near_pairs(*args).collect()}
    areas = polygons.near_shapes(*args).select("a", "b", polygons.intersection_area(F.col("pa"), F.col("pb")).alias("common"))
    area = {(r.a, r.b): r.common for r in areas.collect()}
    assert len(far) > 500 and far.keys() == area.keys()
    for same in (True, False):
        rows = polygons.shape_pairs(*args, same=same).collect()
        got = {(r.a, r.b): r.distance for r in rows}
        assert len(rows) == len(got) and got == pytest.approx(far, abs=1e-9)
        rows = polygons.shape_pairs(*args, common=True, same=same, itself=False).collect()
        got = {(r.a, r.b): r.common for r in rows}
        assert len(rows) == len(got) and got == pytest.approx({k: v for k, v in area.items() if k[0] != k[1]}, abs=1e-9)
        boxed = args[0].where(~F.col("a").isin([k for k in range(121) if k % 7 == 5 or k == 120]))
        best = {}
        for r in polygons.shape_pairs(boxed, boxed.toDF("b", "pb"), *args[2:], common=True, digits=3, same=same, itself=False, best=True).collect():
            best[r.a] = min(best.get(r.a, (1.0, 0)), (-r.common, r.b))
        kept = {r.a for r in boxed.collect()}
        want = {a: min((-round(v, 3), y) for (x, y), v in area.items() if x == a and y != a and y in kept) for a in kept if any(x == a and y != a and y in kept for x, y in area)}
        assert best == want


@pytest.mark.parametrize("name", ["G7_within_distance", "J7_polygon_intersects", "J12_max_overlap"])
def test_pairs_of_polygons_do_not_carry_their_geometry(spark, tmp_path, monkeypatch, name):
    """as the SQL over crowded places in many blocks, and no function is called on rows of pairs with both shapes."""
    suppliers(tmp_path, [*range(300), 1100, 2200, 300300, 300301])
    monkeypatch.setattr(polygons, "BLOCK", 5)
    got, want = rows_and_sql(spark, tmp_path, name, ["supplier"])
    assert got == want and len(got) > 300
    plan = registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" in plan


def test_predicates_by_blocks(spark, tmp_path, monkeypatch):
    """intersects and within by blocks, with slanting shapes among them, as pair by pair; the query carries no geometry in its pairs."""
    monkeypatch.setattr(polygons, "BLOCK", 9)
    F, s = registry.F, some_shapes(spark, 100)
    side = lambda k: s.select(F.col("id").alias(k), F.col("parts").alias(f"p{k}"))
    rows = polygons.shape_predicates(side("a"), side("b"), "a", "b", "pa", "pb").collect()
    got = {(r.a, r.b): (r.intersects, r.within) for r in rows}
    box = lambda k: side(k).where(F.size(f"p{k}") > 0).select("*", *[c.alias(f"{k}_{n}") for n, c in polygons.bounds(F.col(f"p{k}")).items()])
    meet = "a_minx <= b_maxx AND b_minx <= a_maxx AND a_miny <= b_maxy AND b_miny <= a_maxy"
    pairs = box("a").crossJoin(box("b")).where(meet)
    pa_, pb_ = F.col("pa"), F.col("pb")
    want = pairs.select("a", "b", polygons.distance(pa_, pb_).alias("d"), polygons.within(polygons.intersection_area(pa_, pb_), pa_).alias("w"))
    assert len(got) == len(rows) and got == {(r.a, r.b): (r.d == 0, r.w) for r in want.collect()}
    assert {v for v in got.values()} == {(True, True), (True, False), (False, False)}
    suppliers(tmp_path, range(300))
    embeddings(tmp_path, np.random.default_rng(7).uniform(-0.5, 0.5, (200, 64)).tolist())
    got, want = rows_and_sql(spark, tmp_path, "G9_predicates", ["supplier", "embeddings"])
    assert got == want and len(got) > 300
    plan = registry.queries()["G9_predicates"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" in plan
