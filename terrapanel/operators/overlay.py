"""Overlays of polygons that give geometry: union, intersection, difference, repair, and unions of whole groups.

All are one arrangement of edges in the plane.  Edges are cut wherever they meet,
equal pieces become one, and each piece learns which sources lie below and above
it by counting the pieces under its middle.  Pieces with the wanted area on one
side only are the boundary; they are linked into rings, the area to their left,
and holes are dealt to the smallest ring around them.

The plane has a grid of 2^40 steps across the shapes' extent; points closer than
a step are one, so edges that nearly meet do.  Corners keep the coordinates they
were given.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.functions.curves import morton, steps
from terrapanel.operators import polygons
from terrapanel.sources.scratch import folder

#: Steps of the grid, pairs of edges that are met in one step, and shapes that are united in one task at a time.
STEPS, EDGE_PAIRS, FAN_IN = 1 << 40, 1 << 20, 64

Parts = list  # of polygons, each a list of rings, each a list of points {x, y} or an n x 2 array


def _segments(rings) -> np.ndarray:
    """Edges (n, 4) of closed or open rings."""
    found = [np.zeros((0, 4))]
    for r in rings:
        p = r if isinstance(r, np.ndarray) else np.array([(q["x"], q["y"]) for q in r], float).reshape(-1, 2)
        p = p[np.isfinite(p).all(axis=1)]
        if len(p) > 2:
            found.append(np.hstack([p, np.roll(p, -1, axis=0)]))
    e = np.concatenate(found)
    return e[(e[:, :2] != e[:, 2:]).any(axis=1)]


def _meeting(e: np.ndarray):
    """Pairs of edges whose boxes meet, in blocks: a sweep over their left ends."""
    left, right = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    order = np.argsort(left, kind="stable")
    count = np.searchsorted(left[order], right[order], side="right") - np.arange(len(e)) - 1
    ends = np.cumsum(count)
    at = 0
    while at < len(e):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EDGE_PAIRS)))
        own = count[at:upto]
        i = np.repeat(np.arange(at, upto), own)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        i, j = order[i], order[j]
        near = (low[i] <= high[j]) & (low[j] <= high[i])
        yield i[near], j[near]
        at = upto


def _cuts(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edge, point) where edges are to be cut: crossings, and ends that lie on another edge (within a step)."""
    which, points = [], []
    for i, j in _meeting(e):
        a, b, c, d = e[i, :2], e[i, 2:], e[j, :2], e[j, 2:]
        u, v = b - a, d - c
        cross = lambda p, q: p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]
        long_u, long_v = np.hypot(*u.T), np.hypot(*v.T)
        off = {"c": cross(u, c - a) / long_u, "d": cross(u, d - a) / long_u, "a": cross(v, a - c) / long_v, "b": cross(v, b - c) / long_v}
        near = {k: np.abs(x) <= 1.0 for k, x in off.items()}
        for k, end, edge, start, way, size in (("c", c, i, a, u, long_u), ("d", d, i, a, u, long_u), ("a", a, j, c, v, long_v), ("b", b, j, c, v, long_v)):
            along = ((end - start) * way).sum(axis=1) / size
            on = near[k] & (along > 0) & (along < size)
            which.append(edge[on])
            points.append(end[on])
        through = ~np.logical_or.reduce(list(near.values())) & (off["c"] * off["d"] < 0) & (off["a"] * off["b"] < 0)
        share = off["a"][through] / (off["a"][through] - off["b"][through])
        at = np.rint(a[through] + share[:, None] * u[through])
        which += [i[through], j[through]]
        points += [at, at]
    return np.concatenate(which or [np.zeros(0, np.int64)]), np.concatenate(points or [np.zeros((0, 2))])


def _pieces(e: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges cut until none meets another but at ends; rounding a crossing may make another, so it is done again."""
    for _ in range(12):
        which, points = _cuts(e)
        own = (points != e[which, :2]).any(axis=1) & (points != e[which, 2:]).any(axis=1)
        which, points = which[own], points[own]
        if not len(which):
            break
        n = np.arange(len(e))
        edge = np.concatenate([n, which, n])
        point = np.concatenate([e[:, :2], points, e[:, 2:]])
        way = e[edge, 2:] - e[edge, :2]
        along = ((point - e[edge, :2]) * way).sum(axis=1)
        order = np.lexsort((along, edge))
        edge, point = edge[order], point[order]
        same = edge[1:] == edge[:-1]
        e, source = np.hstack([point[:-1], point[1:]])[same], source[edge[:-1][same]]
        there = (e[:, :2] != e[:, 2:]).any(axis=1)
        e, source = e[there], source[there]
    return e, source


def _sides(e: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """For each piece (pointing right or up), which sources are below it, or to the right of an upright one."""
    n, out = len(e), np.zeros_like(odd)
    middle = (e[:, :2] + e[:, 2:]) / 2
    upright = e[:, 0] == e[:, 2]
    block = max(1, (1 << 22) // max(1, n))
    for axis, chosen in ((0, np.flatnonzero(~upright)), (1, np.flatnonzero(upright))):
        # Under a middle (axis 0), or to the right of it (axis 1): the pieces that span it and lie on that side.
        p, q = e[:, axis], e[:, 2 + axis]
        lo, hi = np.minimum(p, q), np.maximum(p, q)
        slope = np.divide(e[:, 3 - axis] - e[:, 1 - axis], q - p, out=np.zeros(n), where=p != q)
        for at in range(0, len(chosen), block):
            rows = chosen[at : at + block]
            m = middle[rows, axis][:, None]
            spans = (lo[None] <= m) & (m < hi[None])
            height = e[None, :, 1 - axis] + (m - p[None]) * slope[None]
            mid = middle[rows, 1 - axis][:, None]
            beside = spans & ((height < mid) if axis == 0 else (height > mid))
            beside[np.arange(len(rows)), rows] = False
            out[rows] = (beside.astype(np.float32) @ odd.astype(np.float32)) % 2 > 0.5
    return out


def _rings(start: np.ndarray, end: np.ndarray, place: np.ndarray) -> list[list[int]]:
    """Closed walks along directed pieces, the wanted area to the left; at a node the sharpest turn to the left that stays at this area's edge."""
    way = place[end] - place[start]
    angle = np.arctan2(way[:, 1], way[:, 0])
    leaving: dict[int, list[int]] = {}
    for k in np.lexsort((angle, start)):
        leaving.setdefault(int(start[k]), []).append(int(k))
    used, out = np.zeros(len(start), bool), []
    for first in range(len(start)):
        if used[first]:
            continue
        walk, k = [], first
        while not used[k]:
            used[k] = True
            walk.append(int(start[k]))
            options = leaving.get(int(end[k]), [])
            back = np.arctan2(-way[k, 1], -way[k, 0])
            # Clockwise from where we came from, the first piece that leaves.
            turn = lambda j: (back - angle[j]) % (2 * np.pi) or 2 * np.pi  # noqa: B023, E731
            free = [j for j in options if not used[j]]
            if not free:
                break
            k = min(free, key=turn)
        out.append(walk)
    return out


def _area(p: np.ndarray) -> float:
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]).sum()) / 2


def _straightened(p: np.ndarray, tolerance: float = 2.0) -> np.ndarray:
    """Without corners that lie on the line between their neighbours, in steps of the grid."""
    keep = np.ones(len(p), bool)
    before, after = np.roll(p, 1, axis=0), np.roll(p, -1, axis=0)
    way, off = after - before, p - before
    size = np.hypot(*way.T)
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.abs(way[:, 0] * off[:, 1] - way[:, 1] * off[:, 0]) / size
    keep = ~((far <= tolerance) & (size > 0))
    return keep


def arrange(sources: list[Parts], wanted: Callable[[np.ndarray], np.ndarray]) -> Parts:
    """The area where ``wanted`` holds, as parts of closed rings; its argument says of pieces' sides (n, sources) what they lie in.

    A source's inside is what an odd number of its rings surrounds.
    """
    own = [_segments(r for rings in parts for r in rings) for parts in sources]
    e = np.concatenate(own) if own else np.zeros((0, 4))
    if not len(e):
        return []
    source = np.repeat(np.arange(len(own)), [len(x) for x in own])
    corner = e[:, :2]
    origin = np.minimum(e[:, :2].min(axis=0), e[:, 2:].min(axis=0))
    extent = float((np.maximum(e[:, :2].max(axis=0), e[:, 2:].max(axis=0)) - origin).max())
    step = 2.0 ** np.ceil(np.log2(extent / STEPS)) if extent > 0 else 1.0
    on_grid = lambda p: np.rint((p - origin) / step)
    given = {(int(x), int(y)): tuple(p) for (x, y), p in zip(on_grid(corner), corner.tolist(), strict=True)}
    e = np.hstack([on_grid(e[:, :2]), on_grid(e[:, 2:])])
    there = (e[:, :2] != e[:, 2:]).any(axis=1)
    e, source = _pieces(e[there], source[there])
    back = (e[:, 0] > e[:, 2]) | ((e[:, 0] == e[:, 2]) & (e[:, 1] > e[:, 3]))
    e[back] = e[back][:, [2, 3, 0, 1]]
    e, same = np.unique(e, axis=0, return_inverse=True)
    odd = np.zeros((len(e), len(sources)), np.int64)
    np.add.at(odd, (same.ravel(), source), 1)
    odd = odd % 2 > 0
    e, odd = e[odd.any(axis=1)], odd[odd.any(axis=1)]
    if not len(e):
        return []
    below = _sides(e, odd)  # on the right hand of a piece that points right or up
    right, left = wanted(below), wanted(below ^ odd)
    edge = right != left
    e, forward = e[edge], left[edge]
    e = np.where(forward[:, None], e, e[:, [2, 3, 0, 1]])
    if not len(e):
        return []
    place, node = np.unique(np.concatenate([e[:, :2], e[:, 2:]]), axis=0, return_inverse=True)
    node = node.ravel()
    outer, holes = [], []
    for walk in _rings(node[: len(e)], node[len(e) :], place):
        p = place[walk]
        if len(p) < 3:
            continue
        keep = _straightened(p)
        if keep.sum() >= 3 and _area(p):
            (outer if _area(p) > 0 else holes).append(p[keep])

    def points(p: np.ndarray) -> list[dict]:
        exact = [given.get((int(x), int(y)), (float(origin[0] + x * step), float(origin[1] + y * step))) for x, y in p]
        return [{"x": x, "y": y} for x, y in [*exact, exact[0]]]

    outer.sort(key=_area)
    found = [[points(p)] for p in outer]
    for hole in holes:
        middle = (hole[0] + hole[1]) / 2
        around = next((n for n, p in enumerate(outer) if polygons._inside(middle, np.vstack([p, p[:1]]))), None)
        if around is not None:
            found[around].append(points(hole))
    return sorted(found, key=lambda rings: min((q["x"], q["y"]) for q in rings[0]))


def united(shapes: list[Parts]) -> Parts:
    return arrange(shapes, lambda inside: inside.any(axis=1))


def repaired(parts: Parts) -> Parts:
    """What lies inside an outer ring (an odd number of times, where it meets itself) and in none of its holes; parts that overlap become one."""
    cleaned = []
    for rings in parts:
        if rings:
            own = [[[r]] for r in rings]
            cleaned.append(arrange(own, lambda inside: inside[:, 0] & ~inside[:, 1:].any(axis=1)))
    cleaned = [c for c in cleaned if c]
    return cleaned[0] if len(cleaned) == 1 else united(cleaned)


_RULES: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "union": lambda inside: inside[:, 0] | inside[:, 1],
    "intersection": lambda inside: inside[:, 0] & inside[:, 1],
    "difference": lambda inside: inside[:, 0] & ~inside[:, 1],
    "symmetric difference": lambda inside: inside[:, 0] ^ inside[:, 1],
}


def overlay(a: Column, b: Column, how: str) -> Column:
    """``union``, ``intersection`` (a clip), ``difference`` or ``symmetric difference`` of two columns of parts; NULL for NULL."""
    rule = _RULES[how]

    @F.arrow_udf(polygons.PARTS)
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = zip(x.to_pylist(), y.to_pylist(), strict=True)
        return pa.array([None if p is None or q is None else arrange([p, q], rule) for p, q in pairs], polygons._PARTS)

    return run(a, b)


def make_valid(parts: Column) -> Column:
    """Rings cut where they meet themselves or others, holes taken away, parts that overlap united; NULL for NULL."""
    return polygons._mapped(parts, polygons.PARTS, polygons._PARTS, repaired)


def unite(df: DataFrame, by: list[str], parts: str) -> DataFrame:
    """Rows (by..., parts, n): the union of each group's polygons, n of them.

    A tree of partial unions: shapes that are near each other, by the Morton
    number of their box, are united FAN_IN at a time, each round's results once
    more in cells that are 64 times as large, until one is left (FAN_IN or fewer
    are united at once).  So no task
    holds more than about twice FAN_IN shapes, and inner edges go early; a
    group's own result is one value.  Equal shapes of a group are united once.
    NULL groups are groups; NULL shapes go.
    """
    spark, keys = df.sparkSession, [f"k{n}" for n in range(len(by))]
    box = polygons.bounds(F.col("parts"))
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], F.col(f"`{parts}`").alias("parts")).where("parts IS NOT NULL")
    # Equal shapes of a group are one, and count.
    rows = rows.groupBy(*keys, "parts").agg(F.count("*").alias("n"))
    rows = rows.withColumns({"x": (box["minx"] + box["maxx"]) / 2, "y": (box["miny"] + box["maxy"]) / 2})
    e = rows.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("low", F.min), ("high", F.max))]).first()
    side = max((e.high_x or 0.0) - (e.low_x or 0.0), (e.high_y or 0.0) - (e.low_y or 0.0))
    rows = rows.withColumns({c: steps(F.col(c), e[f"low_{c}"] or 0.0, (e[f"low_{c}"] or 0.0) + side) for c in ("x", "y")})
    rows = rows.withColumn("cell", morton(F.col("x"), F.col("y"))).drop("x", "y")
    rows = rows.withColumn("mark", F.xxhash64("cell", "parts"))
    base, tasks = folder(spark, "unite"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*[rows.schema[k] for k in keys], rows.schema["cell"], *[T.StructField(c, T.LongType()) for c in ("mark", "n")], T.StructField("parts", T.DataType.fromDDL(polygons.PARTS))])

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("mark")  # the same order each time
        first = table.slice(0, 1).select([*keys, "cell", "mark"])
        out = {name: first.column(name) for name in first.column_names}
        shapes = table.column("parts").to_pylist()
        out["n"] = pa.array([sum(table.column("n").to_pylist())], pa.int64())
        out["parts"] = pa.array([united(shapes)], polygons._PARTS)
        return pa.table(out)

    for level in range(64):
        rows = rows.select(*[F.col(f.name) for f in schema])
        rows.write.parquet(f"{base}/{level}")
        rows = spark.read.schema(schema).parquet(f"{base}/{level}")
        most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        if level and most <= 1:
            break
        # The first round unites each cell's own shapes, the last one what is left; a cell of many is dealt out at random.
        rows = rows.withColumn("cell", F.lit(0).cast("long") if most <= FAN_IN else F.shiftright("cell", 6 if level else 0))
        sizes = rows.groupBy(*keys, "cell").agg(F.count("*").alias("m"))
        same = F.lit(True)
        for k in [*keys, "cell"]:
            same &= F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
        dealt = rows.alias("r").join(sizes.alias("s"), same).select("r.*", F.pmod(F.xxhash64(F.col("r.mark"), F.lit(level)), F.ceil(F.col("s.m") / FAN_IN)).alias("deal"))
        # A number of tasks that is given is kept; few bytes of shapes are much work, and would be put together in one task.
        deal = [*keys, "cell", "deal"]
        rows = dealt.repartition(tasks, *deal).groupBy(*deal).applyInArrow(merge, schema)
    return rows.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "parts", "n")
