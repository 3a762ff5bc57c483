"""Gaps between walls: where openings may be, and where room outlines stay open.

An opening's gap leads to the next wall on the same line, or to the wall a ray meets; a closure joins a free end to another or to a wall.

Walls are rows (plan_id, wall_id, a, b, thickness) in pixels, their fill the rectangle of their thickness;
``profiles`` gives each plan's main thickness.  Walls and the corridors ahead of their ends meet in cells of
a grid over the plane, so that a wall is held only against what lies ahead of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwright.functions import geometry as G
from planwright.operators.spatial import box_cells, segment_cells
from planwright.operators.structure import contacts, suppressed
from planwright.sources.lineage import cut

#: Longest gap in main thicknesses, greatest ratio of thicknesses on one line, and degrees between which the tolerance of directions lies.
LONGEST, RATIO, DEGREES = 30.0, 1.35, (3.0, 8.0)
#: Fixed values, in pixels: reach around a wall's fill, and the shortest gaps of either kind.
REACH, LEAST_ON_LINE, LEAST_TO_WALL = 1.5, 1.0, 2.0
#: Fixed value: cosine from which a wall met is no wall across.
ALONGSIDE = 0.5
#: Reach of a closing line in main thicknesses, its shortest length, and how far it may leave a wall's direction or the axes, in degrees.
CLOSING, LEAST_CLOSING, AHEAD, AXIAL = 12.0, 2.0, 15.0, 10.0
#: Share of a length that a line along an axis may lead back, and cosine from which a wall ahead runs alongside.
BACK, PARALLEL = 0.2, 0.9
#: Width of a cell in pixels.
CELL = 96.0


def on_one_line(p: Column, q: Column) -> Column:
    """Whether two walls (structs a, b, d, length, thickness) lie on one line: like directions, and near the line through all four ends."""
    least = F.least(p["length"], q["length"])
    low, high = (math.radians(v) for v in DEGREES)
    tolerance = F.least(F.lit(high), F.greatest(F.lit(low), F.atan(3 / F.greatest(F.lit(1.0), least))))
    like = F.abs(G.dot(p["d"], q["d"])) >= F.cos(tolerance)
    ends = [p["a"], p["b"], q["a"], q["b"]]
    mean = lambda k: (ends[0][k] + ends[1][k] + ends[2][k] + ends[3][k]) / 4

    def close(c: Column) -> Column:
        off = [(e["x"] - c["x"], e["z"] - c["z"]) for e in ends]
        total = lambda f: sum((f(x, z) for x, z in off[1:]), f(*off[0]))
        angle = 0.5 * F.atan2(2 * total(lambda x, z: x * z), total(lambda x, z: x * x) - total(lambda x, z: z * z))
        bound = F.greatest(F.lit(REACH), 0.2 * F.least(p["thickness"], q["thickness"]))
        return G.let(angle, lambda w: F.greatest(*[F.abs(z * F.cos(w) - x * F.sin(w)) for x, z in off]) <= bound)

    return like & G.let(G.point(mean("x"), mean("z")), close)


def _walls(walls: DataFrame, name: str) -> DataFrame:
    d = walls.withColumn("d", G.wall_direction(F.col("a"), F.col("b")))
    return d.select("plan_id", F.struct("wall_id", "a", "b", "d", G.distance(F.col("a"), F.col("b")).alias("length"), "thickness").alias(name))


def found(walls: DataFrame, profiles: DataFrame) -> DataFrame:
    """Gaps: plan_id, wall_id, end (0 at a, 1 at b), kind (collinear or to-wall), other_id, start and stop along the wall.

    Where a partner lies on the wall's line ahead, the nearest makes the gap; else the first wall that a ray
    from the end meets, if it lies across.  A gap that another wall fills by more than 30 % is none.  Two walls
    that face each other make one gap, that of the smaller id.
    """
    w, o = F.col("w"), F.col("o")
    own = _walls(walls, "w").join(profiles.select("plan_id", "major"), "plan_id").withColumn("end", F.explode(F.array(F.lit(0), F.lit(1))))
    sign, reach = F.when(F.col("end") == 0, -1.0).otherwise(1.0), F.col("major") * LONGEST
    at = lambda t: G.add(w["a"], G.scale(w["d"], t))
    tip = F.when(F.col("end") == 0, 0.0).otherwise(w["length"])
    own = own.withColumns({"sign": sign, "tip": tip, "reach": reach})
    own = own.withColumn("cell", F.explode(segment_cells(at(F.col("tip")), at(F.col("tip") + F.col("sign") * F.col("reach")), w["thickness"], CELL)))
    other = _walls(walls, "o").withColumn("cell", F.explode(segment_cells(o["a"], o["b"], o["thickness"] / 2 + REACH, CELL)))
    met = own.join(other, ["plan_id", "cell"]).where(w["wall_id"] != o["wall_id"])
    met = met.select("plan_id", "w", "end", "sign", "tip", "reach", "o").dropDuplicates(["plan_id", "w", "end", "o"])
    along = lambda p: G.dot(G.sub(p, w["a"]), w["d"])
    a, b = along(o["a"]), along(o["b"])
    near = F.when(F.col("sign") > 0, F.least(a, b)).otherwise(F.greatest(a, b))
    alike = F.greatest(w["thickness"], o["thickness"]) / F.least(w["thickness"], o["thickness"]) <= RATIO
    line = (near - F.col("tip")) * F.col("sign")
    on_line = F.when(alike & (line > LEAST_ON_LINE) & (line <= F.col("reach")) & on_one_line(w, o), line)
    met = cut(met.withColumn("line", on_line).withColumn("span", _crossed(w, o, F.col("tip"), F.col("sign"))))

    key = ["plan_id", "w", "end"]
    entry, leave = F.col("span.enter"), F.col("span.leave")
    ahead = F.when(leave >= 0, F.struct(F.greatest(entry, F.lit(0.0)).alias("at"), o["wall_id"].alias("wall_id"), G.dot(w["d"], o["d"]).alias("turn")))
    best = met.groupBy(*key, "tip", "sign", "reach").agg(F.min(F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("at"), o["wall_id"].alias("wall_id")))).alias("partner"), F.min(ahead).alias("hit"))
    partner, hit = F.col("partner"), F.col("hit")
    across = partner.isNull() & (hit["at"] > LEAST_TO_WALL) & (hit["at"] <= F.col("reach")) & (F.abs(hit["turn"]) <= ALONGSIDE)
    kind = F.when(partner.isNotNull(), "collinear").when(across, "to-wall")
    far, to = F.coalesce(partner["at"], hit["at"]), F.coalesce(partner["wall_id"], hit["wall_id"])
    gaps = best.withColumns({"kind": kind, "far": far, "other_id": to}).where("kind IS NOT NULL")

    # what of the gap other walls fill: their stretches of the ray, merged in order
    inside = met.where(leave > entry).join(gaps.select(*key, "far", "other_id"), key).where((o["wall_id"] != F.col("other_id")) & (leave > 0) & (entry < F.col("far")))
    pieces = inside.select(*key, "far", F.greatest(entry, F.lit(0.0)).alias("s"), F.least(leave, F.col("far")).alias("t"))
    before = F.max("t").over(Window.partitionBy(*key).orderBy("s", "t").rowsBetween(Window.unboundedPreceding, -1))
    filled = pieces.withColumn("new", F.greatest(F.lit(0.0), F.col("t") - F.greatest(F.col("s"), F.coalesce(before, F.lit(0.0))))).groupBy(*key).agg(F.sum("new").alias("filled"))
    gaps = gaps.join(filled, key, "left").where(F.coalesce("filled", F.lit(0.0)) <= 0.3 * F.col("far"))
    start = F.when(F.col("sign") > 0, F.col("tip")).otherwise(F.col("tip") - F.col("far"))
    out = gaps.select("plan_id", w["wall_id"].alias("wall_id"), "end", "kind", "other_id", start.alias("start"), (start + F.col("far")).alias("stop"))
    mutual = out.where("kind = 'collinear'").select("plan_id", F.col("wall_id").alias("other_id"), F.col("other_id").alias("wall_id"), "kind").distinct().withColumn("mutual", F.lit(True))
    d = out.join(mutual, ["plan_id", "wall_id", "other_id", "kind"], "left")
    return d.where(F.col("mutual").isNull() | (F.col("wall_id") < F.col("other_id"))).select(*out.columns)


def _within(p: Column, step: Column, o: Column, over: Column, beside: Column) -> Column:
    """Where a line from ``p`` along ``step`` runs within a wall's fill, with slack at its ends and beside it: (enter, leave) or null."""
    v = G.sub(p, o["a"])
    parts = (G.dot(v, o["d"]), G.dot(step, o["d"]), -over, o["length"] + over), (G.cross(o["d"], v), G.cross(o["d"], step), -o["thickness"] / 2 - beside, o["thickness"] / 2 + beside)
    enter, leave = [], []
    for at, speed, low, high in parts:
        still, inside, endless = F.abs(speed) < 1e-12, (at >= low) & (at <= high), F.lit(float("inf"))
        enter.append(F.when(still, F.when(inside, -endless).otherwise(endless)).otherwise(F.least((low - at) / speed, (high - at) / speed)))
        leave.append(F.when(still, F.when(inside, endless).otherwise(-endless)).otherwise(F.greatest((low - at) / speed, (high - at) / speed)))
    first, last = F.greatest(*enter), F.least(*leave)
    return F.when(last >= first, F.struct(first.alias("enter"), last.alias("leave")))


def _crossed(w: Column, o: Column, tip: Column, sign: Column) -> Column:
    """Where the ray ahead of an end runs within another wall's fill: (enter, leave) in pixels from the end, null if nowhere."""
    return _within(G.add(w["a"], G.scale(w["d"], tip)), G.scale(w["d"], sign), o, F.lit(1.0), F.lit(REACH))


def free_ends(walls: DataFrame) -> DataFrame:
    """Ends of walls that meet no other wall: plan_id, wall_id, key (0 at a, 1 at b), p and dir (outward)."""
    d = G.wall_direction(F.col("a"), F.col("b"))
    ends = F.array(F.struct(F.lit(0).alias("key"), F.col("a").alias("p"), G.scale(d, F.lit(-1.0)).alias("dir")), F.struct(F.lit(1).alias("key"), F.col("b").alias("p"), d.alias("dir")))
    every = walls.select("plan_id", "wall_id", "thickness", F.explode(ends).alias("e")).select("plan_id", "wall_id", "thickness", "e.*")
    return every.join(contacts(walls).select("plan_id", "wall_id", "key").distinct(), ["plan_id", "wall_id", "key"], "left_anti")


def closures(walls: DataFrame, profiles: DataFrame) -> DataFrame:
    """Lines that close room outlines at free wall ends: plan_id, wall_id, key, to_wall, to_key (null on a wall's side), a, b, length.

    A free end is joined to the nearest of the free ends ahead and of the wall straight ahead, unless a wall stands
    between.  Ends are taken in the order of their walls; one that an earlier end was joined to is done.
    """
    ends = cut(free_ends(walls).join(profiles.select("plan_id", (F.col("major") * CLOSING).alias("reach")), "plan_id"))
    p, direction, reach = F.col("p"), F.col("dir"), F.col("reach")
    one = ends.withColumn("cell", F.explode(box_cells(p, reach, CELL)))
    two = ends.select("plan_id", F.struct("wall_id", "key", "p", "thickness").alias("g"), F.explode(box_cells(p, F.lit(0.0), CELL)).alias("cell"))
    g = F.col("g")
    v = G.sub(g["p"], p)
    far, straight = G.length(v), G.dot(v, direction)
    ahead = straight / far >= math.cos(math.radians(AHEAD))
    axial = (F.least(F.abs(v["x"]), F.abs(v["z"])) / far <= math.sin(math.radians(AXIAL))) & (straight > -BACK * far)
    pairs = one.join(two, ["plan_id", "cell"]).where((g["wall_id"] != F.col("wall_id")) & far.between(F.lit(LEAST_CLOSING), reach) & (ahead | axial))
    to_end = pairs.select(*ends.columns, g["wall_id"].alias("to_wall"), g["key"].alias("to_key"), g["p"].alias("q"), far.alias("far"), F.greatest("thickness", g["thickness"]).alias("pad"))

    o = F.col("o")
    fill = _walls(walls, "o").withColumn("cell", F.explode(segment_cells(o["a"], o["b"], o["thickness"] / 2 + 1, CELL)))
    rays = ends.withColumn("cell", F.explode(segment_cells(p, G.add(p, G.scale(direction, reach)), F.lit(0.0), CELL)))
    hits = rays.join(fill, ["plan_id", "cell"]).where(o["wall_id"] != F.col("wall_id")).withColumn("s", _within(p, direction, o, F.lit(0.0), F.lit(0.5)))
    hits = hits.where((F.col("s.leave") >= LEAST_CLOSING) & (F.col("s.enter") <= reach))
    first = F.struct(F.greatest(F.lit(LEAST_CLOSING), "s.enter").alias("far"), o["wall_id"].alias("to_wall"), F.abs(G.dot(o["d"], direction)).alias("turn"))
    host = hits.groupBy(*ends.columns).agg(F.min(first).alias("h")).where(F.col("h.turn") <= PARALLEL)
    to_wall = host.select(*ends.columns, "h.to_wall", F.lit(None).cast("int").alias("to_key"), G.add(p, G.scale(direction, F.col("h.far"))).alias("q"), F.col("h.far").alias("far"), F.col("thickness").alias("pad"))

    lines = cut(to_end.unionByName(to_wall).dropDuplicates(["plan_id", "wall_id", "key", "to_wall", "to_key"]))
    q, pad = F.col("q"), F.col("pad")
    step = G.normalize(G.sub(q, p))
    met = lines.withColumn("cell", F.explode(segment_cells(p, q, F.lit(0.0), CELL))).join(fill, ["plan_id", "cell"]).withColumn("s", _within(p, step, o, F.lit(0.0), F.lit(0.0)))
    blocked = met.where("s IS NOT NULL").where(F.least("s.leave", F.col("far") - pad) - F.greatest("s.enter", pad) > 0).select("plan_id", "wall_id", "key", "to_wall", "to_key").distinct()
    match = [F.col(f"l.{c}").eqNullSafe(F.col(f"x.{c}")) for c in ("plan_id", "wall_id", "key", "to_wall", "to_key")]
    clear = lines.alias("l").join(blocked.alias("x"), match, "left_anti")
    rank = F.struct("far", F.col("to_key").isNull().alias("side"), "to_wall", "to_key")
    best = clear.groupBy("plan_id", "wall_id", "key").agg(F.min_by(F.struct("to_wall", "to_key", F.col("p").alias("a"), F.col("q").alias("b"), F.col("far").alias("length")), rank).alias("c")).select("plan_id", "wall_id", "key", "c.*")
    best = cut(best)
    end = lambda w, k: F.struct("plan_id", F.col(w).alias("wall_id"), F.col(k).alias("key"))
    items = best.withColumn("id", end("wall_id", "key")).withColumn("rank", F.col("id"))
    joined = best.where("to_key IS NOT NULL").select(end("wall_id", "key").alias("u"), end("to_wall", "to_key").alias("v")).where(F.col("u") < F.col("v"))
    return suppressed(items, joined).select(*best.columns)
