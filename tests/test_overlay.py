import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrapanel.operators import overlay, polygons
from terrapanel.operators.overlay import arrange, repaired, united


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def box(x0, y0, x1, y1):
    return [[ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))]]


def arrays(parts):
    return [[np.array([(q["x"], q["y"]) for q in r]) for r in rings] for rings in parts]


def area(parts):
    return sum(abs(polygons._signed(r)) * (1 if n == 0 else -1) for rings in arrays(parts) for n, r in enumerate(rings))


def inside(points, rings):
    odd = np.zeros(len(points), bool)
    for r in rings:
        a, b = r[:-1], r[1:]
        spans = (a[None, :, 1] > points[:, None, 1]) != (b[None, :, 1] > points[:, None, 1])
        with np.errstate(divide="ignore", invalid="ignore"):
            x = a[None, :, 0] + (points[:, None, 1] - a[None, :, 1]) * (b[None, :, 0] - a[None, :, 0]) / (b[None, :, 1] - a[None, :, 1])
        odd ^= (spans & (points[:, None, 0] < x)).sum(axis=1) % 2 > 0
    return odd


def in_parts(points, parts):
    return np.any([inside(points, rings) for rings in arrays(parts)], axis=0) if parts else np.zeros(len(points), bool)


def star(rng, n, centre, size):
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    far = rng.uniform(0.2, 1, n) * size
    return ring(*zip(centre[0] + far * np.cos(angle), centre[1] + far * np.sin(angle), strict=True))


def well_formed(parts):
    for rings in arrays(parts):
        for n, r in enumerate(rings):
            assert (r[0] == r[-1]).all() and len(r) > 3
            assert (polygons._signed(r) > 0) == (n == 0)
        for hole in rings[1:]:
            assert polygons._inside((hole[0] + hole[1]) / 2, rings[0])


@pytest.mark.parametrize("seed", range(12))
def test_rules_hold_at_random_points(seed):
    rng = np.random.default_rng(seed)
    a = [[star(rng, rng.integers(3, 40), rng.uniform(3, 7, 2), 4)]]
    b = [[star(rng, rng.integers(3, 40), rng.uniform(3, 7, 2), 4)], *box(11, 11, 12, 12)]
    points = rng.uniform(-2, 13, (4000, 2))
    p, q = in_parts(points, a), in_parts(points, b)
    found = {how: arrange([a, b], rule) for how, rule in overlay._RULES.items()}
    for how, want in (("union", p | q), ("intersection", p & q), ("difference", p & ~q), ("symmetric difference", p ^ q)):
        well_formed(found[how])
        assert (in_parts(points, found[how]) == want).all(), how
    assert np.isclose(area(found["union"]) + area(found["intersection"]), area(a) + area(b), rtol=1e-9)
    assert np.isclose(area(found["intersection"]), polygons.common_areas(pa.array([a], polygons._PARTS), pa.array([b], polygons._PARTS))[0], rtol=1e-9, atol=1e-9)


def test_many_shapes_at_once_and_shared_edges():
    grid = [box(i, j, i + 1, j + 1) for i in range(9) for j in range(9) if (i, j) != (4, 4)]
    found = united(grid)
    assert len(found) == 1 and [len(r) for r in found[0]] == [5, 5] and area(found) == 80  # straight corners go, one hole is left
    rng = np.random.default_rng(1)
    stars = [[[star(rng, 12, rng.uniform(0, 9, 2), 2)]] for _ in range(40)]
    points = rng.uniform(-2, 11, (4000, 2))
    found = united(stars)
    well_formed(found)
    assert (in_parts(points, found) == np.any([in_parts(points, s) for s in stars], axis=0)).all()


def test_touching_corners_and_equal_shapes():
    assert len(united([box(0, 0, 1, 1), box(1, 1, 2, 2)])) == 2  # they meet in one point
    assert area(united([box(0, 0, 1, 1), box(0, 0, 1, 1)])) == 1
    assert arrange([box(0, 0, 1, 1), box(0, 0, 1, 1)], overlay._RULES["difference"]) == []
    assert arrange([box(0, 0, 1, 1), box(5, 5, 6, 6)], overlay._RULES["intersection"]) == []
    clip = arrange([box(0, 0, 4, 4), box(1, 1, 2, 2)], overlay._RULES["difference"])
    assert [len(r) for r in clip[0]] == [5, 5] and area(clip) == 15
    assert united([]) == [] and united([[], [[]]]) == []


def test_repair():
    bow = [[ring((0, 0), (2, 2), (2, 0), (0, 2))]]
    assert len(repaired(bow)) == 2 and area(repaired(bow)) == 2
    leaving = [[*box(0, 0, 4, 4)[0], ring((3, 1), (6, 1), (6, 2), (3, 2))]]  # the hole leaves the outer ring
    assert area(repaired(leaving)) == 15 and len(repaired(leaving)[0]) == 1
    crossing = [[*box(0, 0, 8, 8)[0], *box(1, 1, 4, 4)[0], *box(3, 3, 6, 6)[0]]]  # two holes that cross
    assert area(repaired(crossing)) == 64 - 9 - 9 + 1 and len(repaired(crossing)[0]) == 2
    twice = [[ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (4, 0))]]  # an edge there and again
    assert area(repaired(twice)) == 16
    over = [*box(0, 0, 2, 2), *box(1, 1, 3, 3)]
    assert area(repaired(over)) == 7 and len(repaired(over)) == 1
    for seed in range(6):  # loops that cross many times
        rng = np.random.default_rng(seed)
        wild = [[ring(*rng.uniform(0, 10, (9, 2)))]]
        points = rng.uniform(0, 10, (3000, 2))
        found = repaired(wild)
        well_formed(found)
        assert (in_parts(points, found) == inside(points, arrays(wild)[0])).all()
    spike = [[ring((0, 0), (4, 0), (4, 4), (4, 9), (4, 4), (0, 4))]]  # an edge out and back
    assert area(repaired(spike)) == 16 and len(repaired(spike)[0][0]) == 5
    assert repaired([]) == [] and repaired([[ring((0, 0), (1, 1), (2, 2))]]) == []


def test_columns_and_the_tree_of_unions(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):
        x, y = rng.uniform(0, 30, 2)
        rows.append((i % 3 if i % 50 else None, box(x, y, x + 3, y + 2) if i % 41 else None, i))
    rows += [(1, box(5, 5, 8, 7), 1000 + i) for i in range(150)]  # many in one place
    df = spark.createDataFrame(rows, f"g int, shape {polygons.PARTS}, parts int")
    got = {r.g: r for r in overlay.unite(df, ["g"], "shape").collect()}
    points = rng.uniform(-1, 34, (3000, 2))
    for g in (0, 1, 2, None):
        own = [s for k, s, _ in rows if k == g and s is not None]
        assert got[g].n == len(own)
        assert (in_parts(points, got[g].parts) == np.any([in_parts(points, s) for s in own], axis=0)).all()
    assert overlay.unite(df.limit(0), ["g"], "shape").count() == 0
    assert overlay.unite(df, [], "shape").count() == 1
    two = spark.createDataFrame([(box(0, 0, 2, 2), box(1, 0, 3, 2)), (None, box(0, 0, 1, 1))], f"a {polygons.PARTS}, b {polygons.PARTS}")
    out = two.select(*[polygons.area(overlay.overlay(F.col("a"), F.col("b"), how)).alias(how.split()[0]) for how in overlay._RULES]).collect()
    assert tuple(out[0]) == (6.0, 2.0, 2.0, 4.0) and out[1].union is None


def test_distances_of_polygons_by_brute_force(spark):
    rng = np.random.default_rng(11)
    shapes = [[[star(rng, rng.integers(4, 12), rng.uniform(0, 30, 2), 3)]] for _ in range(40)]
    shapes += [box(0, 0, 30, 30), [[*box(40, 40, 50, 50)[0], ring((42, 42), (48, 42), (48, 48), (42, 48))]], box(44, 44, 46, 46), box(30, 0, 31, 5), box(53, 40, 54, 50)]
    segments = [np.concatenate([np.hstack([r[:-1], r[1:]]) for rings in arrays(s) for r in rings]) for s in shapes]
    want = {}
    for i, p in enumerate(segments):
        for j, q in enumerate(segments):
            far = polygons.segment_distances(np.repeat(p, len(q), axis=0), np.tile(q, (len(p), 1))).min()
            corner = lambda k, m: in_parts(np.array([arrays(shapes[k])[0][0][0]]), shapes[m])[0]
            far = 0.0 if corner(i, j) or corner(j, i) else far
            if far <= 4:
                want[i, j] = far
    df = spark.createDataFrame(list(enumerate(shapes)), f"id int, shape {polygons.PARTS}")
    left, right = df.select(F.col("id").alias("a"), F.col("shape").alias("pa")), df.select(F.col("id").alias("b"), F.col("shape").alias("pb"))
    got = {(r.a, r.b): r.distance for r in polygons.near_pairs(left, right, "a", "b", "pa", "pb", 4.0).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert got[41, 42] == 2.0 and got[40, 43] == 0.0 and got[41, 44] == 3.0
    touching = {(r.a, r.b) for r in polygons.near_pairs(left, right, "a", "b", "pa", "pb").collect()}
    assert touching == {k for k, v in want.items() if v == 0}
    assert polygons.near_pairs(left.limit(0), right.limit(0), "a", "b", "pa", "pb").count() == 0
