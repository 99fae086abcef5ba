"""Geometry without a geometry library.

A polygon is an array of rings, a ring an array of points {x, y}; the first
ring is the outer one, the others are holes; orientation doesn't matter.  A box
is four doubles.  All measures are column expressions; polygons of several
parts, predicates between polygons and clipping are in ``polygons``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.seeded import uniform

RINGS = "array<array<struct<x: double, y: double>>>"


def ring(points: Column) -> Column:
    """A closed ring: the first point once more at the end unless it is there already."""
    closed = F.element_at(points, 1) == F.element_at(points, -1)
    return F.when(closed, points).otherwise(F.concat(points, F.slice(points, F.lit(1), F.lit(1))))


def edges(points: Column) -> Column:
    """Segments {a, b} of a closed ring."""
    shifted = F.slice(points, F.lit(2), F.greatest(F.lit(0), F.size(points) - 1))
    return F.filter(F.arrays_zip(points.alias("a"), shifted.alias("b")), lambda e: e["b"].isNotNull())


def signed_area(points: Column) -> Column:
    return F.aggregate(edges(points), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def area(rings: Column) -> Column:
    """Area of the outer ring less that of the holes."""
    parts = F.transform(rings, lambda r, i: F.when(i == 0, F.abs(signed_area(r))).otherwise(-F.abs(signed_area(r))))
    return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)


def bounds(rings: Column) -> dict[str, Column]:
    outer = F.element_at(rings, 1)
    xs, ys = F.transform(outer, lambda p: p["x"]), F.transform(outer, lambda p: p["y"])
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def centroid(points: Column) -> tuple[Column, Column]:
    """Centre of mass of a ring; NULL for one without area."""
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    moment = lambda k: F.aggregate(edges(points), F.lit(0.0), lambda s, e: s + (e["a"][k] + e["b"][k]) * cross(e))
    six = F.nullif(signed_area(points) * 6, F.lit(0.0))
    return F.try_divide(moment("x"), six), F.try_divide(moment("y"), six)


def box_ring(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(minx, miny), corner(maxx, miny), corner(maxx, maxy), corner(minx, maxy), corner(minx, miny))


def point_in_rings(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd rule over all rings; points on a left or lower edge are inside, on a right or upper one outside."""
    crossings = F.transform(
        rings,
        lambda r: F.size(
            F.filter(
                edges(r),
                lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < e["a"]["x"] + (y - e["a"]["y"]) * F.try_divide(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])),
            )
        ),
    )
    return F.aggregate(crossings, F.lit(0), lambda a, b: a + b) % 2 == 1


def point_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def box_distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """0 where boxes touch; "within r" replaces buffers and unions."""
    dx = F.greatest(F.lit(0.0), a["minx"] - b["maxx"], b["minx"] - a["maxx"])
    dy = F.greatest(F.lit(0.0), a["miny"] - b["maxy"], b["miny"] - a["maxy"])
    return F.sqrt(dx * dx + dy * dy)


def box_overlap_area(a: dict[str, Column], b: dict[str, Column]) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["maxx"], b["maxx"]) - F.greatest(a["minx"], b["minx"]))
    h = F.greatest(F.lit(0.0), F.least(a["maxy"], b["maxy"]) - F.greatest(a["miny"], b["miny"]))
    return w * h


def boxes_intersect(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["minx"] <= b["maxx"]) & (b["minx"] <= a["maxx"]) & (a["miny"] <= b["maxy"]) & (b["miny"] <= a["maxy"])


def segment_distance(x: Column, y: Column, edge: Column) -> Column:
    """Distance of a point from a segment {a, b}."""
    dx, dy = edge["b"]["x"] - edge["a"]["x"], edge["b"]["y"] - edge["a"]["y"]
    t = F.coalesce(F.try_divide((x - edge["a"]["x"]) * dx + (y - edge["a"]["y"]) * dy, F.nullif(dx * dx + dy * dy, F.lit(0.0))), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return point_distance(x, y, edge["a"]["x"] + t * dx, edge["a"]["y"] + t * dy)


def distance_to_rings(x: Column, y: Column, rings: Column) -> Column:
    """0 inside, else the distance from the nearest edge."""
    nearest = F.array_min(F.transform(rings, lambda r: F.array_min(F.transform(edges(r), lambda e: segment_distance(x, y, e)))))
    return F.when(point_in_rings(x, y, rings), 0.0).otherwise(nearest)


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to metres on the sphere of radius 6378137."""
    r = 6378137.0
    return F.radians(lon) * r, F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * r


class ConformalConic:
    """Lambert conformal conic projection with two standard parallels, from degrees to the given unit."""

    def __init__(self, lat0, lon0, lat1, lat2, easting, northing, unit=1.0, a=6378137.0, inverse_flattening=298.257222101):
        f = 1 / inverse_flattening
        self.e = math.sqrt(2 * f - f * f)
        rad = math.radians
        m = lambda p: math.cos(p) / math.sqrt(1 - (self.e * math.sin(p)) ** 2)
        t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - self.e * math.sin(p)) / (1 + self.e * math.sin(p))) ** (self.e / 2)
        p0, p1, p2 = rad(lat0), rad(lat1), rad(lat2)
        self.n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
        self.scale = a * m(p1) / (self.n * t(p1) ** self.n) / unit
        self.rho0 = self.scale * t(p0) ** self.n
        self.lon0, self.easting, self.northing = rad(lon0), easting, northing

    def project(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        phi = F.radians(lat)
        es = F.sin(phi) * self.e
        t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - es) / (1 + es), F.lit(self.e / 2))
        rho = F.pow(t, F.lit(self.n)) * self.scale
        theta = (F.radians(lon) - self.lon0) * self.n
        return F.sin(theta) * rho + self.easting, F.lit(self.rho0) - F.cos(theta) * rho + self.northing

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Degrees; five rounds of the series for the latitude are exact to 1e-11."""
        dx, dy = x - self.easting, F.lit(self.rho0) - (y - self.northing)
        rho = F.sqrt(dx * dx + dy * dy)
        t = F.pow(rho / self.scale, F.lit(1 / self.n))
        phi = F.lit(math.pi / 2) - F.atan(t) * 2
        for _ in range(5):
            es = F.sin(phi) * self.e
            phi = F.lit(math.pi / 2) - F.atan(t * F.pow((1 - es) / (1 + es), F.lit(self.e / 2))) * 2
        return F.degrees(F.atan2(dx, dy) / self.n + self.lon0), F.degrees(phi)


US_FOOT = 1200 / 3937
#: Fixed values of public registries: New York Long Island in US feet.
LONG_ISLAND_FEET = dict(lat0=40 + 10 / 60, lon0=-74.0, lat1=41 + 2 / 60, lat2=40 + 40 / 60, easting=984250.0, northing=0.0, unit=US_FOOT)
METRES_PER_UNIT = {6539: US_FOOT, 3857: 1.0}


def metres_per_unit(srid: int) -> float:
    """ValueError for geographic systems, whose unit has no length."""
    if srid not in METRES_PER_UNIT:
        raise ValueError(f"system {srid} has no unit of length here")
    return METRES_PER_UNIT[srid]


def half_widths(radius_m: Column, size: int, metres_per_pixel: float) -> tuple[Column, Column]:
    """Whole stride N, at least 1, and the half width in metres that N * size pixels cover."""
    n = F.greatest(F.lit(1), F.bround(radius_m * 2 / metres_per_pixel / size).cast("int"))
    return n, n * size * metres_per_pixel / 2


def pixels(metres: Column, metres_per_pixel: float) -> Column:
    """Whole pixels, at least 1; halves are rounded to the even number."""
    return F.greatest(F.lit(1), F.bround(metres / metres_per_pixel).cast("int"))


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Counter-clockwise hull, collinear points left out."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    halves = []
    for run in (points, points[::-1]):
        half: list = []
        for p in run:
            while len(half) > 1 and turn(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        halves += half[:-1]
    return halves


def spatial_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, a: tuple[str, ...], b: tuple[str, ...], cell: float, exact: Column | None = None, largest: float | None = None) -> DataFrame:
    """Pairs of rows whose boxes intersect (and for which ``exact`` holds), as an equi-join on grid cells.

    a and b name the box columns minx, miny, maxx, maxy, which must differ
    between the sides.  Cells double in size from level to level; a box's own
    level is the first whose cells are not smaller than the box, so it touches
    four of them at most.  It is entered at its own and at all coarser levels
    there are, and two boxes meet at the coarser one of their levels.  There, a
    pair is emitted by one cell only: the one with the lower left corner of the
    common box.  So no pair has to be de-duplicated, the plan has no nested
    loop, and a box much larger than ``cell`` makes a few rows.  ``largest``: the
    longest side of a box on either side, if it is known; else it is looked up.  Cells that
    hold very many boxes are split by the skew handling of the adaptive join.
    """
    ca, cb = ({k: F.col(c) for k, c in zip(("minx", "miny", "maxx", "maxy"), names, strict=True)} for names in (a, b))
    extent = lambda c: F.greatest(c["maxx"] - c["minx"], c["maxy"] - c["miny"], F.lit(0.0))
    if largest is None:
        sizes = left.select(extent(ca).alias("s")).unionByName(right.select(extent(cb).alias("s")))
        largest = sizes.agg(F.max("s")).first()[0] or 0.0
    top = max(0, math.ceil(math.log2(largest / cell))) if largest > 0 else 0

    def cells(df: DataFrame, box: dict[str, Column], own: str) -> DataFrame:
        level = F.when(extent(box) > cell, F.ceil(F.log2(extent(box) / cell))).otherwise(0).cast("int")
        df = df.withColumn(own, level).withColumn("__level", F.explode(F.sequence(F.least(F.col(own), F.lit(top)), F.lit(top))))
        size = F.pow(F.lit(2.0), "__level") * cell
        span = lambda lo, hi: F.sequence(F.floor(box[lo] / size), F.floor(box[hi] / size))
        return df.withColumn("__cx", F.explode(span("minx", "maxx"))).withColumn("__cy", F.explode(span("miny", "maxy")))

    size = F.pow(F.lit(2.0), "__level") * cell
    meet = F.col("__level") == F.greatest("__left_level", "__right_level")
    owner = (F.col("__cx") == F.floor(F.greatest(ca["minx"], cb["minx"]) / size)) & (F.col("__cy") == F.floor(F.greatest(ca["miny"], cb["miny"]) / size))
    both = cells(left, ca, "__left_level").join(cells(right, cb, "__right_level"), ["__level", "__cx", "__cy"])
    pairs = both.where(meet & boxes_intersect(ca, cb) & owner).drop("__level", "__cx", "__cy", "__left_level", "__right_level")
    return pairs if exact is None else pairs.where(exact)


def mean_side(boxes: DataFrame, names: tuple[str, ...]) -> float:
    """The mean longer side of boxes, as a cell for a join of them; 1 for none or for points."""
    minx, miny, maxx, maxy = map(F.col, names)
    return float(boxes.agg(F.avg(F.greatest(maxx - minx, maxy - miny))).first()[0] or 1.0)


def max_overlap(pairs: DataFrame, base_id: str, other_id: str, overlap: str) -> DataFrame:
    """For each base the other one with the largest overlap; ties go to the smaller id."""
    best = F.max_by(F.struct(other_id, overlap), F.struct(F.col(overlap), F.col("__rank")))
    return pairs.withColumn("__rank", -F.col(other_id)).groupBy(base_id).agg(best.alias("__b")).select(base_id, f"__b.{other_id}", f"__b.{overlap}")


def square_around(box: dict[str, Column]) -> dict[str, Column]:
    """The square with the box's centre and its longer side."""
    half = F.greatest(box["maxx"] - box["minx"], box["maxy"] - box["miny"]) / 2
    cx, cy = (box["minx"] + box["maxx"]) / 2, (box["miny"] + box["maxy"]) / 2
    return {"minx": cx - half, "miny": cy - half, "maxx": cx + half, "maxy": cy + half}


def box_difference_area(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Area of a that is not in b."""
    return (a["maxx"] - a["minx"]) * (a["maxy"] - a["miny"]) - box_overlap_area(a, b)


def random_point(rings: Column, key: Column, seed: int, tries: int = 64) -> Column:
    """A point {x, y} inside the polygon: the first of ``tries`` seeded points of its box that is.

    If none is, as in a sliver, a seeded point of the stretch inside on the
    line half-way between the two lowest heights of corners.  NULL only for a
    polygon without area.
    """
    box = bounds(rings)
    draws = F.transform(
        F.sequence(F.lit(1), F.lit(tries)),
        lambda i: F.struct(
            (box["minx"] + (box["maxx"] - box["minx"]) * uniform(seed, key, i, F.lit("x"))).alias("x"),
            (box["miny"] + (box["maxy"] - box["miny"]) * uniform(seed, key, i, F.lit("y"))).alias("y"),
        ),
    )
    hit = F.try_element_at(F.filter(draws, lambda p: point_in_rings(p["x"], p["y"], rings)), F.lit(1))
    heights = F.array_sort(F.array_distinct(F.transform(F.flatten(rings), lambda p: p["y"])))
    y = (F.try_element_at(heights, F.lit(1)) + F.try_element_at(heights, F.lit(2))) / 2
    across = F.filter(F.flatten(F.transform(rings, edges)), lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
    xs = F.array_sort(F.transform(across, lambda e: e["a"]["x"] + (y - e["a"]["y"]) * F.try_divide(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])))
    first, second = F.try_element_at(xs, F.lit(1)), F.try_element_at(xs, F.lit(2))
    line = F.when(second.isNotNull(), F.struct((first + (second - first) * uniform(seed, key, F.lit("line"))).alias("x"), y.alias("y")))
    return F.coalesce(hit, line)
