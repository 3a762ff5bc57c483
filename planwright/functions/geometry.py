"""Plan geometry as column expressions: points are structs (x, z), polygons arrays of points.

Rings are walked with higher-order functions; tests of a whole polygon against another, which take every
edge of the one with every edge of the other, are the Arrow functions of ``rings``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, types
from pyspark.sql import functions as F

from planwright.functions import rings

#: Tolerance, in metres, within which a point counts as on an edge.
EPS = 5e-4
TINY = 1e-12


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, so that expressions don't grow with every use of it."""
    return F.get(F.transform(F.array(value), f), 0)


def point(x: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), z.cast("double").alias("z"))


def add(a: Column, b: Column) -> Column:
    return point(a["x"] + b["x"], a["z"] + b["z"])


def sub(a: Column, b: Column) -> Column:
    return point(a["x"] - b["x"], a["z"] - b["z"])


def scale(a: Column, k: Column) -> Column:
    return point(a["x"] * k, a["z"] * k)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return a["x"] * b["z"] - a["z"] * b["x"]


def length(a: Column) -> Column:
    return F.hypot(a["x"], a["z"])


def distance(a: Column, b: Column) -> Column:
    return length(sub(a, b))


def normalize(a: Column) -> Column:
    """Unit vector; zero for a vector too short to have a direction."""
    def unit(v):
        n = F.hypot(v["x"], v["z"])
        return F.when(n < TINY, point(F.lit(0.0), F.lit(0.0))).otherwise(point(v["x"] / n, v["z"] / n))

    return let(a, unit)


def rotate(a: Column, angle: Column) -> Column:
    """Rotation about the vertical axis."""
    c, s = F.cos(angle), F.sin(angle)
    return point(a["x"] * c + a["z"] * s, a["z"] * c - a["x"] * s)


def facing(direction: Column) -> Column:
    """Angle whose forward axis (0, 1) turns to a direction."""
    return F.atan2(direction["x"], direction["z"])


def edges(polygon: Column) -> Column:
    """Array of (a, b) for each edge of the closed ring."""
    n = F.size(polygon)
    return F.transform(polygon, lambda p, i: F.struct(p.alias("a"), F.element_at(polygon, (i + 1) % n + 1).alias("b")))


def _total(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + f(e))


def signed_area(polygon: Column) -> Column:
    """Half the sum of the edges' cross products."""
    return _total(edges(polygon), lambda e: cross(e["a"], e["b"])) / 2


def area(polygon: Column) -> Column:
    return F.abs(signed_area(polygon))


def perimeter(polygon: Column) -> Column:
    return _total(edges(polygon), lambda e: distance(e["a"], e["b"]))


def centroid(polygon: Column) -> Column:
    """Centre of area, or the vertices' mean where there is none."""
    ring, twice, n = edges(polygon), 2 * signed_area(polygon), F.size(polygon)
    cx = _total(ring, lambda e: (e["a"]["x"] + e["b"]["x"]) * cross(e["a"], e["b"]))
    cz = _total(ring, lambda e: (e["a"]["z"] + e["b"]["z"]) * cross(e["a"], e["b"]))
    mean = point(_total(polygon, lambda p: p["x"]) / n, _total(polygon, lambda p: p["z"]) / n)
    return F.when(F.abs(twice) / 2 < TINY, mean).otherwise(point(cx / (3 * twice), cz / (3 * twice)))


def bounds(polygon: Column) -> Column:
    """Least and greatest coordinates; infinite the wrong way round for an empty polygon."""
    xs, zs = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["z"])
    up, down = F.lit(float("inf")), F.lit(float("-inf"))
    return F.struct(F.coalesce(F.array_min(xs), up).alias("min_x"), F.coalesce(F.array_max(xs), down).alias("max_x"), F.coalesce(F.array_min(zs), up).alias("min_z"), F.coalesce(F.array_max(zs), down).alias("max_z"))


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """Distance of a point from a segment."""
    def from_start(v):
        squared = v["dx"] * v["dx"] + v["dz"] * v["dz"]
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v["x"] * v["dx"] + v["z"] * v["dz"]) / squared))
        return let(F.when(squared < 1e-18, F.lit(0.0)).otherwise(share), lambda t: F.hypot(v["x"] - v["dx"] * t, v["z"] - v["dz"] * t))

    own = F.struct((p["x"] - a["x"]).alias("x"), (p["z"] - a["z"]).alias("z"), (b["x"] - a["x"]).alias("dx"), (b["z"] - a["z"]).alias("dz"))
    return let(own, from_start)


def on_boundary(p: Column, polygon: Column, tolerance: float = EPS) -> Column:
    return F.exists(edges(polygon), lambda e: segment_distance(p, e["a"], e["b"]) <= tolerance)


def _crossings_odd(p: Column, polygon: Column) -> Column:
    def hit(e):
        straddles = (e["a"]["z"] > p["z"]) != (e["b"]["z"] > p["z"])
        at = (e["b"]["x"] - e["a"]["x"]) * (p["z"] - e["a"]["z"]) / (e["b"]["z"] - e["a"]["z"]) + e["a"]["x"]
        return straddles & (p["x"] < at)

    return F.size(F.filter(edges(polygon), hit)) % 2 == 1


def contains(polygon: Column, p: Column, tolerance: float = EPS) -> Column:
    """Even-odd rule; the boundary counts as inside."""
    return let(p, lambda q: on_boundary(q, polygon, tolerance) | _crossings_odd(q, polygon))


def strictly_contains(polygon: Column, p: Column, tolerance: float = EPS) -> Column:
    return let(p, lambda q: ~on_boundary(q, polygon, tolerance) & _crossings_odd(q, polygon))


def properly_intersect(a: Column, b: Column, c: Column, d: Column, tolerance: float = 1e-9) -> Column:
    """Whether two segments cross inside both; touching is not crossing."""
    def side(p, q, r):
        return cross(sub(q, p), sub(r, p))

    def apart(u, v):
        return ((u > tolerance) & (v < -tolerance)) | ((u < -tolerance) & (v > tolerance))

    return apart(side(a, b, c), side(a, b, d)) & apart(side(c, d, a), side(c, d, b))


def self_intersects(polygon: Column) -> Column:
    """Whether any two edges that are not neighbours cross."""
    ring, n = F.transform(edges(polygon), lambda e, i: F.struct(e["a"].alias("a"), e["b"].alias("b"), i.alias("i"))), F.size(polygon)

    def far(e, f):
        return (f["i"] > e["i"] + 1) & ~((e["i"] == 0) & (f["i"] == n - 1))

    return F.exists(ring, lambda e: F.exists(ring, lambda f: far(e, f) & properly_intersect(e["a"], e["b"], f["a"], f["b"])))


def is_convex(polygon: Column) -> Column:
    """Whether all turns go one way; straight corners are ignored."""
    n = F.size(polygon)
    at = lambda i: F.element_at(polygon, (i % n) + 1)
    turns = F.transform(polygon, lambda p, i: cross(sub(at(i + 1), p), sub(at(i + 2), at(i + 1))))
    return ~(F.exists(turns, lambda t: t >= TINY) & F.exists(turns, lambda t: t <= -TINY))


def distance_to_boundary(p: Column, polygon: Column) -> Column:
    return F.array_min(F.transform(edges(polygon), lambda e: segment_distance(p, e["a"], e["b"])))


def oriented_rect(centre: Column, width: Column, depth: Column, angle: Column) -> Column:
    """Corners of a rotated rectangle."""
    corners = [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)]
    return F.array(*[add(centre, rotate(point(width * a, depth * b), angle)) for a, b in corners])


def wall_direction(start: Column, end: Column) -> Column:
    return normalize(sub(end, start))


def wall_normal(start: Column, end: Column) -> Column:
    d = wall_direction(start, end)
    return point(-d["z"], d["x"])


def point_along_wall(start: Column, end: Column, offset: Column, side: Column) -> Column:
    return add(add(start, scale(wall_direction(start, end), offset)), scale(wall_normal(start, end), side))


def wall_footprint(start: Column, end: Column, thickness: Column) -> Column:
    """The wall's rectangle on the floor."""
    half = scale(wall_normal(start, end), thickness / 2)
    return F.array(add(start, half), add(end, half), sub(end, half), sub(start, half))


def plan_to_world(p: Column, origin: Column, ppm: Column) -> Column:
    """Pixels of the plan to metres."""
    return point((p["x"] - origin["x"]) / ppm, (p["z"] - origin["z"]) / ppm)


def world_to_plan(p: Column, origin: Column, ppm: Column) -> Column:
    return point(p["x"] * ppm + origin["x"], p["z"] * ppm + origin["z"])


def normalize_angle(angle: Column) -> Column:
    """An angle in [0, 2 pi)."""
    return F.pmod(angle, 2 * F.pi())


def rounded(value: Column, digits: int = 6) -> Column:
    """Half-up rounding that any SQL engine repeats bit for bit."""
    k = float(10**digits)
    return F.floor(value * k + 0.5) / k


def overlap_depth(a: Column, b: Column) -> Column:
    """Least overlap of two convex polygons along an edge's normal; zero or less, on the first such normal, where they are apart."""
    def normals(polygon):
        return F.transform(edges(polygon), lambda e: normalize(point(e["a"]["z"] - e["b"]["z"], e["b"]["x"] - e["a"]["x"])))

    def along(polygon, axis):
        return F.transform(polygon, lambda p: dot(p, axis))

    def depth(axis):
        pa, pb = along(a, axis), along(b, axis)
        return F.least(F.array_max(pa), F.array_max(pb)) - F.greatest(F.array_min(pa), F.array_min(pb))

    axes = F.filter(F.concat(normals(a), normals(b)), lambda n: dot(n, n) > 0.5)
    depths = F.transform(axes, depth)
    return F.coalesce(F.get(F.filter(depths, lambda d: d <= 0), 0), F.array_min(depths))


def convex_overlap(a: Column, b: Column, tolerance: float = EPS) -> Column:
    return overlap_depth(a, b) > tolerance


def convex_distance(a: Column, b: Column) -> Column:
    """Distance between two convex polygons; zero where they overlap."""
    def nearest(p, q):
        return F.array_min(F.transform(p, lambda v: distance_to_boundary(v, q)))

    return F.when(overlap_depth(a, b) > 0, F.lit(0.0)).otherwise(F.least(nearest(a, b), nearest(b, a)))


def contains_polygon(outer: Column, inner: Column, tolerance: float = EPS) -> Column:
    """Whether a polygon lies in another: vertices and edge middles inside and no edges that cross."""
    return rings.contains(outer, inner, tolerance)


def protrusion(inner: Column, outer: Column, step: float = 0.05) -> Column:
    """How far a polygon reaches out of another, its edges sampled every ``step`` metres."""
    return rings.protrusion(inner, outer, step, EPS)


def overhang(inner: Column, outer: Column, held: float, step: float = 0.05) -> Column:
    """``protrusion`` of a polygon that ``contains_polygon`` doesn't hold within ``held``, 0 of one that it does."""
    return rings.overhang(inner, outer, step, EPS, held)


def contains_each(outers: Column, inner: Column, tolerance: float = EPS) -> Column:
    """``contains_polygon`` for each polygon of an array."""
    return rings.contains_each(outers, inner, tolerance)


def approximate_overlap(a: Column, b: Column, cell: float = 0.05, most: int = 10_000) -> Column:
    """Common area of two simple polygons, from a grid over their common bounds of at most about ``most`` cells."""
    def counted(v):
        steps = lambda lo, hi: F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((v[hi] - v[lo]) / v["size"] - 0.5).cast("int") - 1))

        def inside(i: Column) -> Column:
            at = lambda j: point(v["x0"] + v["size"] * (i + 0.5), v["z0"] + v["size"] * (j + 0.5))
            return F.size(F.filter(F.transform(steps("z0", "z1"), at), lambda p: strictly_contains(a, p) & strictly_contains(b, p)))

        columns = F.when((v["x0"] < v["x1"]) & (v["z0"] < v["z1"]), steps("x0", "x1")).otherwise(F.array().cast("array<int>"))
        return F.aggregate(columns, F.lit(0), lambda n, i: n + inside(i)) * v["size"] * v["size"]

    def sized(v):
        area_ = F.greatest(F.lit(0.0), v["x1"] - v["x0"]) * F.greatest(F.lit(0.0), v["z1"] - v["z0"])
        return let(F.struct(*[v[k].alias(k) for k in ("x0", "x1", "z0", "z1")], F.greatest(F.lit(cell), F.sqrt(area_ / most)).alias("size")), counted)

    ba, bb = bounds(a), bounds(b)
    common = F.struct(*[f(ba[k], bb[k]).alias(n) for n, f, k in (("x0", F.greatest, "min_x"), ("x1", F.least, "max_x"), ("z0", F.greatest, "min_z"), ("z1", F.least, "max_z"))])
    return let(common, sized)


POINT = types.StructType([types.StructField("x", types.DoubleType()), types.StructField("z", types.DoubleType())])


@F.pandas_udf(types.ArrayType(types.ArrayType(POINT)))
def _clipped(polygons: pd.Series) -> pd.Series:
    return polygons.map(lambda ring: None if ring is None else [[{"x": x, "z": z} for x, z in part] for part in _parts([(p["x"], p["z"]) for p in ring])])


def convex_parts(polygon: Column | str) -> Column:
    """Convex pieces of a simple polygon: a convex one itself, else the triangles of ear clipping."""
    p = F.col(polygon) if isinstance(polygon, str) else polygon
    return F.coalesce(_clipped(F.when(~is_convex(p), p)), F.array(p))


def _turn(a: tuple, b: tuple, c: tuple) -> float:
    return (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])


def _parts(ring: list[tuple]) -> list[list[tuple]]:
    """Ears are cut off one by one, which is sequential; what can't be cut becomes a fan."""
    n = len(ring)
    turns = [t for t in (_turn(ring[i], ring[(i + 1) % n], ring[(i + 2) % n]) for i in range(n)) if abs(t) >= TINY]
    if all(t > 0 for t in turns) or all(t < 0 for t in turns):
        return [ring]
    if sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) < 0:
        ring = ring[::-1]
    out = []
    while len(ring) > 3:
        for k in range(len(ring)):
            ear = [ring[k - 1], ring[k], ring[(k + 1) % len(ring)]]
            sides = lambda p: [_turn(ear[i], ear[(i + 1) % 3], p) for i in range(3)]  # noqa: E731, B023
            if _turn(*ear) > TINY and not any(p not in ear and min(sides(p)) > 1e-9 for p in ring):
                out.append(ear)
                ring = ring[:k] + ring[k + 1 :]
                break
        else:
            break
    return out + [[ring[0], ring[k], ring[k + 1]] for k in range(1, len(ring) - 1)]


def parts_overlap_depth(a: Column, b: Column) -> Column:
    """Greatest overlap depth of two sets of convex pieces, as ``convex_parts`` gives them."""
    return rings.parts_depth(a, b)


def parts_overlap_depths(many: Column, own: Column) -> Column:
    """``parts_overlap_depth`` of one set of convex pieces with each of an array of such sets."""
    return rings.depths(many, own)


def collinear_overlap(a0: Column, a1: Column, b0: Column, b1: Column, tolerance: Column) -> Column:
    """Length over which two segments lie on one line, within a tolerance, and overlap."""
    def shared(d):
        def on_line(v):
            both = F.least(F.greatest(F.lit(0.0), v["end"]), F.greatest(v["p"], v["q"])) - F.greatest(F.least(F.lit(0.0), v["end"]), F.least(v["p"], v["q"]))
            return F.greatest(F.lit(0.0), both)

        along = lambda p: (p["x"] - a0["x"]) * d["x"] + (p["z"] - a0["z"]) * d["z"]
        off = (F.abs(cross(d, wall_direction(b0, b1))) > 1e-3) | (F.abs(d["x"] * (b0["z"] - a0["z"]) - d["z"] * (b0["x"] - a0["x"])) > tolerance)
        return F.when(off, F.lit(0.0)).otherwise(let(F.struct(along(a1).alias("end"), along(b0).alias("p"), along(b1).alias("q")), on_line))

    return let(wall_direction(a0, a1), shared)


def image_rect(origin: Column, ppm: Column, width: Column, height: Column) -> Column:
    """The plan image's rectangle in metres: least and greatest corner."""
    return F.struct(plan_to_world(point(F.lit(0.0), F.lit(0.0)), origin, ppm).alias("least"), plan_to_world(point(width, height), origin, ppm).alias("greatest"))
