import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrapanel.operators import geometry, overlay, panel, polygons, raster, relational, scoring, splits, stats

SQUARE = [[{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}, {"x": 2.0, "y": 2.0}, {"x": 0.0, "y": 2.0}, {"x": 0.0, "y": 0.0}]]
L = [[{"x": x, "y": y} for x, y in ((0.0, 0.0), (3.0, 0.0), (3.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0), (0.0, 0.0))]]
HOLED = [
    [{"x": x, "y": y} for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0))],
    [{"x": x, "y": y} for x, y in ((1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0), (1.0, 1.0))],
]


def common_areas(a, b):
    return polygons.common_areas(pa.array(a, polygons._PARTS), pa.array(b, polygons._PARTS))


def test_intersection_areas():
    common = lambda a, b: common_areas([[a]], [[b]])[0]
    assert common(L, SQUARE) == pytest.approx(3.0)
    assert common(HOLED, SQUARE) == pytest.approx(3.0)
    assert common(L, HOLED) == pytest.approx(5.0)
    far = [[{"x": p["x"] + 9, "y": p["y"]} for p in SQUARE[0]]]
    assert common(far, SQUARE) == 0
    assert common([SQUARE[0][::-1]], SQUARE) == pytest.approx(4.0)
    two = common_areas([[SQUARE, far], [SQUARE, far]], [[HOLED], [far]])
    assert two == pytest.approx([3.0, 4.0])


def test_common_areas_by_counting_points(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(polygons, "TRIANGLE_PAIRS", 5)
    blob = lambda n: (lambda t, r: [[{"x": float(x), "y": float(y)} for x, y in zip(np.r_[r * np.cos(t), r[0] * np.cos(t[0])], np.r_[r * np.sin(t), r[0] * np.sin(t[0])], strict=True)]])(np.sort(rng.uniform(0, 6.28, n)), rng.uniform(0.3, 1, n))
    a, b = [[blob(9)] for _ in range(6)], [[blob(7)] for _ in range(6)]
    p = rng.uniform(-1, 1, (40_000, 2))

    def inside(rings):
        c = np.array([(q["x"], q["y"]) for q in rings[0]])
        u, v = c[:-1], c[1:]
        spans = (u[None, :, 1] > p[:, None, 1]) != (v[None, :, 1] > p[:, None, 1])
        x = u[None, :, 0] + (p[:, None, 1] - u[None, :, 1]) * (v[:, 0] - u[:, 0]) / (v[:, 1] - u[:, 1])
        return ((p[:, None, 0] < x) & spans).sum(axis=1) % 2 == 1

    for x, y, area in zip(a, b, common_areas(a, b), strict=True):
        assert area == pytest.approx(4 * (inside(x[0]) & inside(y[0])).mean(), abs=0.03)


def test_predicates_of_polygons(spark):
    move = lambda rings, dx, dy: [[{"x": p["x"] + dx, "y": p["y"] + dy} for p in r] for r in rings]
    small = [[{"x": x * 0.2 + 1.2, "y": y * 0.2 + 1.2} for x, y in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]]
    cases = [  # a, b, intersects, a within b
        ([SQUARE], [L], True, False),
        ([small], [HOLED], False, False),  # in the hole
        ([small], [SQUARE], True, True),
        ([SQUARE], [small], True, False),
        ([small], [L], False, False),  # in the notch
        ([move(SQUARE, 2, 2)], [SQUARE], True, False),  # corners touch
        ([move(SQUARE, 2.5, 0)], [SQUARE], False, False),
        ([SQUARE, move(SQUARE, 9, 9)], [move(SQUARE, 9.5, 9.5)], True, False),
        ([small, move(small, 9, 9)], [SQUARE, move(SQUARE, 9, 9)], True, True),
        ([HOLED], [HOLED], True, True),
    ]
    df = spark.createDataFrame([(n, a, b) for n, (a, b, *_) in enumerate(cases)], f"id int, a {polygons.PARTS}, b {polygons.PARTS}")
    found = df.withColumn("common", polygons.intersection_area(F.col("a"), F.col("b"))).select("id", polygons.intersects(F.col("a"), F.col("b")).alias("i"), polygons.within(F.col("common"), F.col("a")).alias("w"))
    assert {r.id: (r.i, r.w) for r in found.collect()} == {n: c[2:] for n, c in enumerate(cases)}


def test_valid_hull_and_simplify(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    bow = [[ring((0, 0), (2, 2), (2, 0), (0, 2))]]
    dotted = [[ring((0, 0), (1, 0.001), (2, 0), (2, 1), (2, 2), (0, 2), (0, 0), (0, 0))]]
    df = spark.createDataFrame([(1, bow), (2, dotted), (3, [HOLED]), (4, None), (5, [[ring((0, 0), (1, 1))]])], f"id int, p {polygons.PARTS}")
    p = F.col("p")
    rows = {r.id: r for r in df.select("id", overlay.make_valid(p).alias("v"), polygons.simplify(p, 0.01).alias("s"), polygons.hull(p).alias("h"), polygons.area(overlay.make_valid(p)).alias("a")).collect()}
    assert len(rows[1].v) == 2 and rows[1].a == pytest.approx(2.0)
    assert [len(r) for r in rows[2].s[0]] == [5] and rows[2].a == pytest.approx(4 - 0.001)
    assert rows[3].a == 15.0 and len(rows[3].h) == 5
    assert rows[4].v is None and rows[5].v == [] and rows[5].h is None


def test_spatial_join_of_boxes_of_all_sizes(spark):
    rng = np.random.default_rng(2)
    box = lambda: (lambda x, y, s: (x, y, x + s * rng.uniform(), y + s * rng.uniform()))(*rng.uniform(-50, 50, 2), 10 ** rng.uniform(-2, 3))
    a, b = [tuple(map(float, box())) for _ in range(120)], [tuple(map(float, box())) for _ in range(120)]
    left = spark.createDataFrame([(i, *x) for i, x in enumerate(a)], "i int, a0 double, a1 double, a2 double, a3 double")
    right = spark.createDataFrame([(j, *x) for j, x in enumerate(b)], "j int, b0 double, b1 double, b2 double, b3 double")
    got = sorted((r.i, r.j) for r in geometry.spatial_join(left, right, "i", "j", ("a0", "a1", "a2", "a3"), ("b0", "b1", "b2", "b3"), 0.5).collect())
    meet = lambda x, y: x[0] <= y[2] and y[0] <= x[2] and x[1] <= y[3] and y[1] <= x[3]
    assert got == sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if meet(x, y))


def test_polygon_measures(spark):
    df = spark.createDataFrame([(1, L), (2, HOLED), (3, SQUARE)], f"id int, rings {geometry.RINGS}")
    inside = lambda x, y: geometry.point_in_rings(F.lit(x), F.lit(y), F.col("rings"))
    cx, cy = geometry.centroid(F.col("rings")[0])
    got = {
        r.id: r
        for r in df.select(
            "id", geometry.area(F.col("rings")).alias("a"), inside(1.5, 1.5).alias("i"), inside(0.5, 2.5).alias("j"), cx.alias("cx"), cy.alias("cy"),
            geometry.distance_to_rings(F.lit(5.0), F.lit(0.5), F.col("rings")).alias("d"), geometry.bounds(F.col("rings"))["maxx"].alias("mx"),
            polygons.intersection_area(polygons.as_parts(F.col("rings")), polygons.as_parts(F.col("rings"))).alias("self"),
        ).collect()
    }
    assert [got[k].a for k in (1, 2, 3)] == [5.0, 15.0, 4.0] and [got[k].self for k in (1, 2, 3)] == pytest.approx([5.0, 15.0, 4.0])
    assert [got[k].i for k in (1, 2, 3)] == [False, False, True]
    assert [got[k].j for k in (1, 2, 3)] == [True, True, False]
    assert (got[3].cx, got[3].cy) == (1.0, 1.0) and [got[k].d for k in (1, 2, 3)] == [2.0, 1.0, 3.0] and got[1].mx == 3.0


def test_hull_and_units():
    assert geometry.convex_hull([(0, 0), (1, 0), (2, 0), (2, 2), (1, 1), (0, 2)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    with pytest.raises(ValueError):
        geometry.metres_per_unit(4326)


def test_projection_of_its_origin(spark):
    crs = geometry.ConformalConic(**geometry.LONG_ISLAND_FEET)
    x, y = crs.project(F.lit(-74.0), F.lit(40 + 10 / 60))
    row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (row.x, row.y) == (pytest.approx(984250.0), pytest.approx(0.0, abs=1e-6))


def test_spatial_join_finds_each_pair_once(spark):
    rng = np.random.default_rng(5)
    box = lambda n: [(i, *map(float, (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(rng.uniform(-50, 50, (n, 4)) * [1, 1, 0.1, 0.1] + [0, 0, 6, 6])]
    a, b = box(120), box(90)
    left = spark.createDataFrame(a, "i int, ax double, ay double, aX2 double, aY2 double")
    right = spark.createDataFrame(b, "j int, bx double, by double, bX2 double, bY2 double")
    out = geometry.spatial_join(left, right, "i", "j", ("ax", "ay", "aX2", "aY2"), ("bx", "by", "bX2", "bY2"), 7.0)
    got = sorted((r.i, r.j) for r in out.collect())
    assert got == sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])


def test_max_overlap_breaks_ties_by_id(spark):
    pairs = spark.createDataFrame([(1, 7, 2.0), (1, 5, 2.0), (1, 9, 1.0)], "a int, b int, o double")
    assert geometry.max_overlap(pairs, "a", "b", "o").first().b == 5


def test_pixel_windows_match_a_search(spark):
    grid = raster.Grid(0.0, 0.5, 40, 20.0, -0.5, 40)
    xs, ys = np.arange(40) * 0.5, 20.0 - np.arange(40) * 0.5
    rng = np.random.default_rng(6)
    rows = [tuple(map(float, r)) for r in np.round(rng.uniform(-3, 23, (200, 4)) * 4) / 4]
    rows = [(min(a, c), min(b, d), max(a, c), max(b, d)) for a, b, c, d in rows]
    df = spark.createDataFrame(rows, "minx double, miny double, maxx double, maxy double")
    w = raster.pixel_window(grid, *map(F.col, ("minx", "miny", "maxx", "maxy")))
    for r in df.select("*", *[c.alias(k) for k, c in w.items()]).collect():
        assert (r.col_start, r.col_stop, r.row_start, r.row_stop) == ((xs < r.minx).sum(), (xs <= r.maxx).sum(), (ys > r.maxy).sum(), (ys >= r.miny).sum())


def test_tiles_from_chunks(spark):
    image = (np.arange(10 * 9 * 2) % 251).astype(np.uint8).reshape(10, 9, 2)
    chunks = [("d", r, c, *p.shape, p.tobytes()) for r in range(3) for c in range(3) for p in [np.ascontiguousarray(image[r * 4 : r * 4 + 4, c * 4 : c * 4 + 4])]]
    table = spark.createDataFrame(chunks, "dataset string, chunk_row long, chunk_col long, h int, w int, bands int, data binary")
    windows = spark.createDataFrame([(1, "d", 2, 7, 1, 9), (2, "d", 0, 10, 0, 9), (3, "d", 5, 5, 1, 2), (4, "d", 20, 24, 30, 33), (5, "none", 0, 2, 0, 2)], "id int, dataset string, row_start int, row_stop int, col_start int, col_stop int")
    for stride in (1, 2):
        got = {r.id: np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, r.bands) for r in raster.assemble_tiles(windows, table, 4, "id", stride).collect()}
        assert set(got) == {1, 2, 3, 4, 5} and got[3].size == 0
        assert got[4].shape == (-(-4 // stride), -(-3 // stride), 2) and not got[4].any()  # no chunk there: zeros
        assert got[5].shape == (-(-2 // stride), -(-2 // stride), 1) and not got[5].any()  # a dataset that is not there
        np.testing.assert_array_equal(got[1], image[2:7:stride, 1:9:stride])
        np.testing.assert_array_equal(got[2], image[::stride, ::stride])
    row = table.limit(1).select(raster.not_blank(F.col("data")).alias("n"), raster.mask_low_bits(F.col("data")).alias("m"), raster.stretch(F.col("data"), F.col("bands"), 0.0, 100.0).alias("s")).first()
    assert row.n and all(b % 4 == 0 for b in row.m) and max(row.s) == 255
    back = table.select(raster.undelta_bytes(raster.delta_bytes(F.col("data"))).alias("b"), "data").collect()
    assert all(r.b == r.data for r in back)
    thin = {(r.chunk_row, r.chunk_col): np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, 2) for r in raster.overview(table, 4, 3).collect()}
    whole = np.concatenate([np.concatenate([thin[r, c] for c in range(3) if (r, c) in thin], axis=1) for r in range(3) if (r, 0) in thin])
    np.testing.assert_array_equal(whole, image[::3, ::3])


def test_stretch_by_band_and_overlaps(spark):
    pixels = np.stack([np.arange(100), np.arange(100) // 2 + 50], axis=1).astype(np.uint8)
    df = spark.createDataFrame([(bytearray(pixels.tobytes()), 2)], "data binary, bands int")
    got = np.frombuffer(df.select(raster.stretch(F.col("data"), F.col("bands"), 2.0, 98.0).alias("s")).first().s, np.uint8).reshape(-1, 2)
    for k in (0, 1):
        lo, hi = np.percentile(pixels[:, k], [2, 98])
        np.testing.assert_array_equal(got[:, k], np.clip((pixels[:, k] - lo) / (hi - lo) * 255, 0, 255).astype(np.uint8))
    image = np.arange(80, dtype=np.uint8).reshape(8, 10)
    tiles = [(r, c, float(x), float(100 - y), 5, 6, 1, bytearray(image[y : y + 5, x : x + 6].tobytes())) for r, y in enumerate((0, 3)) for c, x in enumerate((0, 4))]
    out = {(t.tile_row, t.tile_col): np.frombuffer(t.data, np.uint8).reshape(t.h, t.w) for t in raster.crop_overlap(spark.createDataFrame(tiles, "tile_row int, tile_col int, x0 double, y0 double, h int, w int, bands int, data binary"), 1.0, -1.0).collect()}
    np.testing.assert_array_equal(np.block([[out[0, 0], out[0, 1]], [out[1, 0], out[1, 1]]]), image)


def test_linked_points_are_all_kept(spark):
    catalog = spark.createDataFrame([("a", 0, 2010, 0.0, 0.0, 10.0, 10.0), ("b", 1, 2010, 5.0, 5.0, 10.0, 10.0)], "name string, position int, year int, minx double, miny double, maxx double, maxy double")
    points = spark.createDataFrame([(1, 2010, 1.0, 1.0), (1, 2010, 1.0, 1.0), (2, 2010, 5.0, 5.0), (3, 2010, 99.0, 1.0), (4, 1999, 1.0, 1.0)], "id int, year int, x double, y double")
    assert sorted((r.id, r.dataset or "") for r in raster.link_datasets(points, catalog, "x", "y", "year").collect()) == [(1, "a"), (1, "a"), (2, "b"), (3, ""), (4, "")]


def test_random_point_in_a_sliver(spark):
    sliver = [[{"x": x, "y": y} for x, y in ((0.0, 0.0), (1000.0, 1000.0), (1000.0, 1000.001), (0.0, 0.0))]]
    df = spark.createDataFrame([(i, sliver) for i in range(20)], f"id int, rings {geometry.RINGS}")
    p = geometry.random_point(F.col("rings"), F.col("id"), 3)
    assert all(r.inside for r in df.select(geometry.point_in_rings(p["x"], p["y"], F.col("rings")).alias("inside")).collect())


def test_bicubic_weights():
    def kernel(d):
        d = abs(d)
        return 1.25 * d**3 - 2.25 * d**2 + 1 if d <= 1 else -0.75 * (d**3 - 5 * d**2 + 8 * d - 4) if d < 2 else 0.0

    for size, wanted in ((7, 13), (10, 4), (5, 5)):
        index, weight = raster._cubic(size, wanted)
        image = np.random.default_rng(1).uniform(size=size)
        for k in range(wanted):
            at = (k + 0.5) * size / wanted - 0.5
            want = sum(image[min(max(i, 0), size - 1)] * kernel(at - i) for i in range(-3, size + 3))
            assert (image[index[k]] * weight[k]).sum() == pytest.approx(want)


def test_splits_keep_their_distance(spark):
    rows = [(i, float(i % 25) * 100, float(i // 25) * 100, float(i % 25) * 100 + 100, float(i // 25) * 100 + 100, i % 5, 1.0) for i in range(625)]
    tracts = spark.createDataFrame(rows, "id int, minx double, miny double, maxx double, maxy double, stratum int, area double")
    out = {r.id: r.type for r in splits.split_tracts(tracts, "id", "stratum", "area", 150.0, 90.0, 0.06, 3).collect()}
    assert len(out) == 625 and set(out.values()) == {"train", "val", "test", "dead_zone"}
    place = lambda i: (i % 25, i // 25)
    gap = lambda i, j: max(abs(place(i)[0] - place(j)[0]), abs(place(i)[1] - place(j)[1])) - 1
    held = [i for i, t in out.items() if t in ("val", "test")]
    for i, t in out.items():
        if t == "train":
            assert all(gap(i, j) >= 1 for j in held)  # no neighbour, with a moat of 90
    assert all(gap(i, j) >= 1 for i, t in out.items() if t == "val" for j, s in out.items() if s == "test")
    for s in range(5):
        assert sum(out[i] == "test" for i in range(625) if i % 5 == s) >= 0.06 * 125
    again = {r.id: r.type for r in splits.split_tracts(tracts.repartition(5), "id", "stratum", "area", 150.0, 90.0, 0.06, 3).collect()}
    assert again == out


def test_building_types(spark):
    df = spark.createDataFrame([(a, b, c, t) for a in (True, False) for b in (True, False) for c in (True, False) for t in (True, False)], "s boolean, v boolean, drop boolean, t boolean")
    kind = lambda legacy: splits.building_type(F.col("s"), F.col("v"), F.col("drop"), F.col("t"), legacy=legacy)
    for r in df.select("*", kind(False).alias("k"), kind(True).alias("o")).collect():
        want = ("val_time" if r.t else "val_spatial") if r.v else "test" if r.s or r.t else "dead_zone" if r.drop else "train"
        assert r.k == want and r.o == ("dead_zone" if want == "train" else want)


def test_effects_of_a_constant_treatment(spark):
    rows = [(u, t, float(u % 7 + 3 * t + (10 if g and t >= g else 0)), g) for u in range(60) for t in range(1, 7) for g in [{0: 0, 1: 3, 2: 5}[u % 3]]]
    rows = [r for r in rows if r[0] != 59 or r[1] != 4]  # unbalanced
    rows += [(100, t, 1.0 * t, 1) for t in range(1, 7)]  # treated from the first period on
    att = stats.group_time_effects(spark.createDataFrame(rows, "u int, t int, y double, g int"), "u", "t", "y", "g").collect()
    assert {r.g for r in att} == {3, 5}
    for r in att:
        assert r.att == pytest.approx(10.0 if r.t >= r.g else 0.0)
    again = spark.createDataFrame(att)
    assert stats.simple_effect(again).first().att == pytest.approx(10)
    assert {r.k: round(r.att, 9) for r in stats.event_time_effects(again).collect()}[-1] == 0


def test_rank_statistics(spark):
    rng = np.random.default_rng(7)
    rows = [(int(a), int(a * 0.5 + b)) for a, b in rng.integers(0, 12, (80, 2))] + [(None, 3)]
    df = spark.createDataFrame(rows, "x int, y int")
    x, y = np.array(rows[:-1], float).T
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(80) for j in range(80))
    n = lambda v: sum(v[i] != v[j] for i in range(80) for j in range(80))
    assert stats.kendall(df, "x", "y").first().tau == pytest.approx(s / np.sqrt(n(x) * n(y)))
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert stats.spearman(df, "x", "y").first().rho == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    assert stats.spearman(df.limit(2), "x", "y").first().rho is None


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.range(400).withColumn("v", (F.col("id") % 20).cast("double"))
    row = stats.percentile_interval(stats.bootstrap_mean(df, ["id"], "v", 200, 5), "mean").first()
    assert row.low < 9.5 < row.high and row.high - row.low < 2.5 and row.n == 200


def test_changes_and_yo_yo(spark):
    rows = [(1, 1, 0.0), (1, 2, 5.0), (1, 3, 0.0), (2, 1, 0.0), (2, 2, 5.0), (2, 3, 9.0), (3, 1, 0.0), (3, 2, 0.15), (3, 3, 0.3), (4, 1, 0.0), (4, 2, None), (4, 3, 0.1)]
    df = spark.createDataFrame([(u, y, s, 0.1) for u, y, s in rows], "u int, y int, s double, e double")
    changes, ends = panel.consecutive_changes(df, "u", "y", "s", "e"), panel.first_last_change(df, "u", "y", "s", "e")
    out = {r.u: (r.yo_yo, r.valid) for r in panel.structural_change(changes, ends, "u").collect()}
    assert out == {1: (True, False), 2: (False, True), 3: (False, True), 4: (False, False)}


def test_exponential_mean_matches_a_fold(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0]
    want = values[0]
    for v in values[1:]:
        want = want + (v - want) / 3
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)] + [(2, 0, 7.0)], "g int, t int, v double")
    got = {r.g: r.m for r in panel.exponential_mean(df, ["g"], "t", "v", 5, "m").collect()}
    assert got == {1: pytest.approx(want), 2: pytest.approx(7.0)}


def test_checked_join_and_audit(spark):
    a, b = spark.createDataFrame([(1, 1.0), (1, float("nan"))], "k int, v double"), spark.createDataFrame([(1,)], "k int")
    assert relational.checked_join(a, b, ["k"], "inner", "m:1").count() == 2
    with pytest.raises(ValueError):
        relational.checked_join(a, b, ["k"], "inner", "1:1")
    assert {r.column_name: r.n_null for r in relational.null_counts(a).collect()} == {"k": 0, "v": 1}
    assert relational.null_counts(a.limit(0)).first().n_rows == 0


def test_scoring(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0], 5), (2, None, 5), (3, [1.0, 1.0], None)], "id int, x array<double>, m int")
    got = {r.id: r.predicted_value for r in scoring.score_batches(df, "x", ["m"], scoring.scorer("linear")).collect()}
    assert got == {1: pytest.approx(2.05), 2: None, 3: None}
    rng = np.random.default_rng(1)
    head = scoring.late_fusion({"w1": rng.normal(size=(2, 4)), "b1": np.zeros(4), "w2": rng.normal(size=5), "b2": 0.5})
    assert head(rng.normal(size=(3, 2)), np.ones((3, 1))).shape == (3,)
    with pytest.raises(KeyError):
        scoring.scorer("absent")


def test_points_squares_and_box_hold_outs(spark):
    df = spark.createDataFrame([(i, L) for i in range(40)], f"id int, rings {geometry.RINGS}")
    p = geometry.random_point(F.col("rings"), F.col("id"), 3)
    rows = df.select(p.alias("p"), geometry.point_in_rings(p["x"], p["y"], F.col("rings")).alias("inside")).collect()
    assert all(r.inside for r in rows) and len({r.p.x for r in rows}) == 40
    box, other = dict(zip(("minx", "miny", "maxx", "maxy"), map(F.lit, (0.0, 0.0, 4.0, 2.0)), strict=True)), dict(zip(("minx", "miny", "maxx", "maxy"), map(F.lit, (3.0, 0.0, 9.0, 9.0)), strict=True))
    sq = geometry.square_around(box)
    row = spark.range(1).select(sq["miny"].alias("a"), sq["maxy"].alias("b"), geometry.box_difference_area(box, other).alias("d")).first()
    assert tuple(row) == (-1.0, 3.0, 6.0)
    tracts = spark.createDataFrame([(i, i % 20 * 1.0, i // 20 * 1.0, i % 20 + 0.9, i // 20 + 0.9) for i in range(400)], "id int, minx double, miny double, maxx double, maxy double")
    boxes = spark.createDataFrame([(k, float(k * 7 % 18), float(k * 5 % 18), k * 7 % 18 + 2.0, k * 5 % 18 + 2.0) for k in range(60)], "box_id int, minx double, miny double, maxx double, maxy double")
    held = splits.box_hold_out(tracts, "id", boxes, 0.2, 1)
    assert 80 <= held.count() <= 95 and held.distinct().count() == held.count()


def test_tile_names_scales_and_sizes(spark):
    row, col = raster.tile_position(F.col("n"))
    assert [tuple(r) for r in spark.createDataFrame([("a_R3_C12.tif",), ("b",)], "n string").select(row, col).collect()] == [(3, 12), (None, None)]
    tile = lambda v, b: spark.createDataFrame([(1, 2, 2, b, bytearray([v] * 4 * b))], "id int, h int, w int, bands int, data binary")
    out = raster.multi_scale([tile(5, 1), tile(7, 2)], "id").first()
    assert out.bands == 3 and list(out.data) == [5, 7, 7] * 4
    grown = raster.resize_bicubic(spark.createDataFrame([(1, 1, 2, 1, bytearray([1, 2]))], "id int, h int, w int, bands int, data binary"), 2, 4).first()
    assert (grown.h, grown.w) == (2, 4) and list(grown.data) == [1, 1, 2, 2] * 2


def test_smoothed_parameters(spark):
    rows = [(y, float(np.exp(0.1 * (y - 2015))), 2.0) for y in range(2010, 2020)]
    out = stats.smooth_parameters(spark.createDataFrame(rows, "year int, a double, b double"), "year", ["a", "b"])
    for r in out.collect():
        assert r.a == pytest.approx(np.exp(0.1 * (r.year - 2015))) and r.b == pytest.approx(2.0)
