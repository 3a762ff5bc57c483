"""Floor zones that must stay usable, and topology: the rooms beside walls, doors and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwright.functions import geometry as G
from planwright.operators.spatial import room_at
from planwright.sources.lineage import shuffled

#: Free depth on both sides of doors and in front of windows, in metres.
DOOR_CLEARANCE, WINDOW_CLEARANCE = 0.8, 0.3
#: How far beside a wall's face a room is looked for, the step along a wall, and the most steps.
SIDE_PROBE, ALONG, MOST_STEPS = 0.08, 0.1, 400


def wall_side_rect(start: Column, end: Column, thickness: Column, begin: Column, stop: Column, depth: Column, side: Column | int) -> Column:
    """Rectangle on one side of a wall along a span of it."""
    near, far = thickness / 2 * side, (thickness / 2 + depth) * side
    at = lambda offset, out: G.point_along_wall(start, end, offset, out)
    return F.array(at(begin, near), at(stop, near), at(stop, far), at(begin, far))


def swing_depth(kind: Column, width: Column) -> Column:
    """How far a door's leaf reaches: its width, half of it for two leaves, nothing for other kinds."""
    return F.when(kind == "hinged", width).when(kind.isin("double", "bifold"), width / 2).otherwise(F.lit(0.0))


def functional_zones(walls: DataFrame, doors: DataFrame, windows: DataFrame, door: float = DOOR_CLEARANCE, window: float = WINDOW_CLEARANCE, swings: bool = True) -> DataFrame:
    """Zones of doors and windows: floor_id, zone_id, kind, issue, source_id, label, min_item_top, polygon.

    ``walls``: floor_id, wall_id, start, end, thickness; ``doors``: floor_id, id, wall_id, offset, width,
    kind, swing_side, note; ``windows``: floor_id, id, wall_id, offset, width, sill_height.  Openings
    without a wall have no zone.
    """
    d, w = doors.join(walls, ["floor_id", "wall_id"]), windows.join(walls, ["floor_id", "wall_id"])

    def rect(depth: Column, side: Column | int) -> Column:
        begin = F.col("offset") - F.col("width") / 2
        return wall_side_rect(F.col("start"), F.col("end"), F.col("thickness"), begin, begin + F.col("width"), depth, side)

    def zone(df: DataFrame, name: str, kind: str, issue: str, label: Column, top: Column, polygon: Column) -> DataFrame:
        return df.select("floor_id", F.concat(F.col("id").cast("string"), F.lit(f":{name}")).alias("zone_id"), F.lit(kind).alias("kind"), F.lit(issue).alias("issue"), F.col("id").alias("source_id"), label.alias("label"), top.cast("double").alias("min_item_top"), polygon.alias("polygon"))

    reach, none = swing_depth(F.col("kind"), F.col("width")), F.lit(None)
    label = F.lower(F.coalesce("note", F.when(F.col("kind") == "opening", "opening").otherwise("door")))
    side = F.when(F.col("swing_side") >= 0, 1).otherwise(-1)
    parts = [zone(d.where(reach > 0), "swing", "door-swing", "door-swing", label, none, rect(reach, side))] if swings else []
    for k, s in enumerate((1, -1)):
        parts.append(zone(d, f"access{k}", "door-access", "door-clearance", label, none, rect(F.lit(door), s)))
        parts.append(zone(w, f"access{k}", "window-access", "window-blocked", F.lit("window"), F.col("sill_height"), rect(F.lit(window), s)))
    return reduce(DataFrame.unionByName, parts)


def _probed(points: DataFrame, rooms: DataFrame, keys: list[str]) -> DataFrame:
    """The first room at each probe (keys, at): keys and room_id."""
    own = points.select("floor_id", F.struct(*keys).alias("probe"), "at")
    return room_at(own, rooms.select("floor_id", "room_id", "ord", "polygon"), "floor_id", "probe", "room_id").select("floor_id", *[F.col(f"probe.{k}").alias(k) for k in keys], "room_id")


def _sides(df: DataFrame, offset: Column) -> DataFrame:
    """Two probes beside a wall at an offset along it, side -1 before side 1."""
    d = df.withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    return d.withColumn("at", G.point_along_wall(F.col("start"), F.col("end"), offset, (F.col("thickness") / 2 + SIDE_PROBE) * F.col("side")))


def rooms_beside_walls(walls: DataFrame, rooms: DataFrame) -> DataFrame:
    """The first room on each side of each wall's middle: (floor_id, wall_id, side, room_id)."""
    return _probed(_sides(walls, G.distance(F.col("start"), F.col("end")) / 2), rooms, ["wall_id", "side"])


def rooms_along_walls(walls: DataFrame, rooms: DataFrame) -> DataFrame:
    """Rooms that touch either face of a wall, probed about every ALONG metres: (floor_id, wall_id, room_id).

    Walls meet the rooms near them first; probes are made of the pairs, so that they stay where the join by
    floor has put them, and only those in a room's bounds are held against its outline.
    """
    start, end = F.col("start"), F.col("end")
    span = G.distance(start, end)
    steps = F.least(F.lit(MOST_STEPS), F.greatest(F.lit(2), F.ceil(span / ALONG).cast("int")))
    d = walls.select("floor_id", "wall_id", "start", "end", span.alias("span"), steps.alias("steps"), (F.col("thickness") / 2 + SIDE_PROBE).alias("out"), G.wall_direction(start, end).alias("d"), G.wall_normal(start, end).alias("n"))
    r = rooms.select("floor_id", "room_id", "ord", "polygon", G.bounds(F.col("polygon")).alias("b"))
    b = F.col("b")
    beside = [(F.least(start[c], end[c]) - F.col("out") <= b[f"max_{c}"]) & (F.greatest(start[c], end[c]) + F.col("out") >= b[f"min_{c}"]) for c in ("x", "z")]
    pairs = d.join(r, "floor_id").where(beside[0] & beside[1]).withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    at = F.col("at")
    pairs = pairs.withColumn("at", G.add(G.add(start, G.scale(F.col("d"), F.col("span") * F.col("step") / F.col("steps"))), G.scale(F.col("n"), F.col("out") * F.col("side"))))
    inside = (at["x"] >= b["min_x"]) & (at["x"] <= b["max_x"]) & (at["z"] >= b["min_z"]) & (at["z"] <= b["max_z"])
    hits = pairs.where(inside).where(G.strictly_contains(F.col("polygon"), at))
    return hits.groupBy("floor_id", "wall_id", "side", "step").agg(F.min_by("room_id", "ord").alias("room_id")).select("floor_id", "wall_id", "room_id").distinct()


def rooms_of_openings(openings: DataFrame, walls: DataFrame, rooms: DataFrame) -> DataFrame:
    """Rooms on both sides of doors or windows: (floor_id, id, side, room_id); openings without a wall give no row."""
    return _probed(_sides(openings.join(walls.select("floor_id", "wall_id", "start", "end", "thickness"), ["floor_id", "wall_id"]), F.col("offset")), rooms, ["id", "side"])


def topology(rooms: DataFrame, walls: DataFrame, doors: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Doors with the rooms they connect, and rooms with the walls, doors and windows they touch."""
    beside = rooms_of_openings(doors, walls, rooms)
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("room_id")))
    connects = beside.groupBy("floor_id", "id").agg(side(-1).alias("negative"), side(1).alias("positive"))
    linked = doors.join(connects, ["floor_id", "id"], "left")

    def ids(pairs: DataFrame, of: DataFrame, key: str, name: str) -> DataFrame:
        d = pairs.where("room_id IS NOT NULL").select("floor_id", key, "room_id").distinct().join(of.select("floor_id", F.col(key), F.col("ord").alias("_o")), ["floor_id", key])
        return shuffled(d.groupBy("floor_id", "room_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", key))), lambda x: x[key]).alias(name)))

    out = rooms
    for part in (ids(rooms_along_walls(walls, rooms), walls, "wall_id", "wall_ids"), ids(beside, doors, "id", "door_ids"), ids(rooms_of_openings(windows, walls, rooms), windows, "id", "window_ids")):
        out = out.join(part, ["floor_id", "room_id"], "left")
    return shuffled(linked), shuffled(out)


def room_metrics(rooms: DataFrame) -> DataFrame:
    """Area, centroid, extents and perimeter of each room."""
    p, b = F.col("polygon"), G.bounds(F.col("polygon"))
    return rooms.select("floor_id", "room_id", G.area(p).alias("area"), G.centroid(p).alias("centroid"), (b["max_x"] - b["min_x"]).alias("width"), (b["max_z"] - b["min_z"]).alias("depth"), G.perimeter(p).alias("perimeter"))


def resolved_rooms(rooms: DataFrame, asked: DataFrame) -> DataFrame:
    """The room each query (floor_id, query) means: by id, else by name, else by a name that holds or is held by it."""
    q, name = F.lower(F.trim("query")), F.lower("name")
    rank = F.when(F.col("room_id") == q, 0).when(name == q, 1).when(F.contains(name, q) | F.contains(q, name), 2)
    d = asked.join(rooms.select("floor_id", "room_id", "name", "ord"), "floor_id").withColumn("rank", rank).where("rank IS NOT NULL")
    found = d.groupBy("floor_id", "query").agg(F.min_by("room_id", F.struct("rank", "ord")).alias("room_id"))
    return asked.join(found, ["floor_id", "query"], "left")
