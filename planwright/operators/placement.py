"""Furniture on floors: footprints, clearances, checks of a placement and single-request fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwright.functions import geometry as G
from planwright.operators.rules import union_rules
from planwright.sources.lineage import spread

#: The constraints of a placement.
WALKING_CLEARANCE, WALL_GAP, TOLERANCE = 0.6, 0.02, 0.005
BLOCKING = ("outside-room", "wall-collision", "fixture-collision")
#: Severity, category and wording of each issue.
SEVERITY = {"outside-room": "hard", "wall-collision": "hard", "fixture-collision": "hard", "furniture-collision": "hard", "door-swing": "hard", "door-clearance": "soft", "window-blocked": "soft", "front-clearance": "soft"}
CATEGORY = {"outside-room": "structural", "wall-collision": "structural", "fixture-collision": "structural", "furniture-collision": "furniture", "door-swing": "functional", "door-clearance": "functional", "window-blocked": "functional", "front-clearance": "clearance"}
RULE = {"outside-room": "room containment", "wall-collision": "wall clearance", "fixture-collision": "fixed fittings", "furniture-collision": "other furniture", "door-swing": "door swing", "door-clearance": "door clearance", "window-blocked": "window access", "front-clearance": "walkway clearance"}


def looked_up(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def footprint(position: Column, width: Column, depth: Column, rotation: Column) -> Column:
    return G.oriented_rect(position, width, depth, rotation)


def front_clearance(position: Column, width: Column, depth: Column, rotation: Column, clearance: Column) -> Column:
    """Rectangle in front of an item, as deep as its rule or the walking distance asks."""
    deep = F.greatest(clearance, F.lit(WALKING_CLEARANCE))
    centre = G.add(position, G.rotate(G.point(F.lit(0.0), depth / 2 + deep / 2), rotation))
    return G.oriented_rect(centre, width, deep, rotation)


def obstacles(walls: DataFrame, fixtures: DataFrame, furniture: DataFrame, zones: DataFrame) -> DataFrame:
    """What items may meet: floor_id, kind, issue, other_id, rank, min_item_top, parts (convex) and their bounds."""
    cols = lambda kind, issue, other, rank, top, polygon, parts: [F.lit(kind).alias("kind"), issue.alias("issue"), other.cast("string").alias("other_id"), rank.alias("rank"), top.cast("double").alias("min_item_top"), parts(polygon).alias("parts"), G.bounds(polygon).alias("box")]
    # rectangles are convex as they are made
    whole, split = lambda d, rect: d.withColumn("polygon", rect), G.convex_parts
    none, zero = F.lit(None), F.lit("")
    f = furniture.where("collides")
    return union_rules(
        whole(walls, G.wall_footprint(F.col("start"), F.col("end"), F.col("thickness"))).select("floor_id", *cols("wall", F.lit("wall-collision"), F.col("wall_id"), zero, none, F.col("polygon"), F.array)),
        fixtures.select("floor_id", *cols("fixture", F.lit("fixture-collision"), F.col("id"), zero, none, F.col("footprint"), split)),
        whole(f, footprint(F.col("position"), F.col("width"), F.col("depth"), F.col("rotation"))).select("floor_id", *cols("furniture", F.lit("furniture-collision"), F.col("item_id"), zero, none, F.col("polygon"), F.array)),
        zones.select("floor_id", *cols("zone", F.col("issue"), F.col("source_id"), F.col("zone_id"), F.col("min_item_top"), F.col("polygon"), split)),
    )


def _boxes_meet(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return (a["min_x"] < b["max_x"]) & (b["min_x"] < a["max_x"]) & (a["min_z"] < b["max_z"]) & (b["min_z"] < a["max_z"])


def _box_inside(box: Column, outer: Column) -> Column:
    return (box["min_x"] >= outer["min_x"] - TOLERANCE) & (box["max_x"] <= outer["max_x"] + TOLERANCE) & (box["min_z"] >= outer["min_z"] - TOLERANCE) & (box["max_z"] <= outer["max_z"] + TOLERANCE)


def placement_issues(items: DataFrame, rooms: DataFrame, walls: DataFrame, fixtures: DataFrame, furniture: DataFrame, zones: DataFrame, require_clear: tuple[str, ...] = ()) -> DataFrame:
    """Issues of placed items: floor_id, item_id, code, severity, category, other_id, amount in metres.

    ``items`` and ``furniture``: floor_id, item_id, room_id, position, rotation, width, depth, height,
    elevation, collides, front_clearance (0 for none); ``rooms``: floor_id, room_id, ord, polygon;
    ``walls``, ``fixtures`` (id, footprint) and ``zones`` as elsewhere.  The floor is the equi-key,
    bounding boxes cut the pairs before the overlap tests.  An item lies in its own room, else in the
    first that holds it; items that don't collide, such as rugs, ignore furniture, zones and the free
    space in front.  A blocked swing says all about its door, and a door counts one access zone.
    """
    own = footprint(F.col("position"), F.col("width"), F.col("depth"), F.col("rotation"))
    a = spread(items, "floor_id", "item_id").withColumn("polygon", own).withColumn("box", G.bounds(F.col("polygon")))
    r = rooms.select("floor_id", F.col("room_id").alias("in_room"), "ord", F.col("polygon").alias("room_polygon"))
    inside = _box_inside(F.col("box"), F.col("room_box"))
    held = a.join(r.withColumn("room_box", G.bounds(F.col("room_polygon"))), "floor_id").where(inside).where(G.contains_polygon(F.col("room_polygon"), F.col("polygon"), TOLERANCE))
    rank = F.struct((F.col("in_room") != F.col("room_id")).alias("other"), "ord")
    home = held.groupBy("floor_id", "item_id").agg(F.min_by(F.struct("in_room", "room_polygon"), rank).alias("home"))
    a = a.join(home, ["floor_id", "item_id"], "left")
    lost = a.where("home IS NULL").drop("home").join(r.withColumnRenamed("in_room", "room_id").drop("ord"), ["floor_id", "room_id"], "left")
    outside = lost.select("floor_id", "item_id", F.lit("outside-room").alias("code"), F.col("room_id").cast("string").alias("other_id"), G.protrusion(F.col("polygon"), F.col("room_polygon")).alias("amount"))

    met = a.withColumnRenamed("box", "own_box").join(obstacles(walls, fixtures, furniture, zones), "floor_id").where(_boxes_meet("own_box", "box"))
    relevant = F.col("kind").isin("wall", "fixture") | (F.col("collides") & ((F.col("kind") != "furniture") | (F.col("other_id") != F.col("item_id").cast("string"))))
    tall = F.col("min_item_top").isNull() | (F.coalesce("elevation", F.lit(0.0)) + F.col("height") > F.col("min_item_top"))
    hit = met.where(relevant & tall).withColumn("amount", G.parts_overlap_depth(F.array("polygon"), F.col("parts"))).where(F.col("amount") > TOLERANCE)
    door = Window.partitionBy("floor_id", "item_id", "other_id")
    swung = F.max((F.col("issue") == "door-swing").cast("int")).over(door)
    first = F.row_number().over(Window.partitionBy("floor_id", "item_id", "other_id", "issue").orderBy("rank"))
    hit = hit.withColumns({"_swung": swung, "_first": first})
    spare = (F.col("issue") == "door-clearance") & ((F.col("_swung") == 1) | (F.col("_first") > 1))
    hits = hit.where(~spare).select("floor_id", "item_id", F.col("issue").alias("code"), "other_id", "amount")

    need = a.where("collides AND front_clearance > 0").withColumn("zone", front_clearance(F.col("position"), F.col("width"), F.col("depth"), F.col("rotation"), F.col("front_clearance")))
    need = need.withColumn("zone_box", G.bounds(F.col("zone")))
    room = F.col("home.room_polygon")
    beyond = F.when(~G.contains_polygon(room, F.col("zone"), TOLERANCE), F.col("zone"))
    short = need.where(room.isNotNull()).select("floor_id", "item_id", G.protrusion(beyond, room).alias("amount"))
    others = obstacles(walls, fixtures, furniture, zones).where("kind IN ('fixture', 'furniture')")
    near = need.drop("box").join(others, "floor_id").where(_boxes_meet("zone_box", "box") & (F.col("other_id") != F.col("item_id").cast("string")) | (F.col("kind") == "fixture") & _boxes_meet("zone_box", "box"))
    short = short.unionByName(near.select("floor_id", "item_id", G.parts_overlap_depth(F.array("zone"), F.col("parts")).alias("amount")))
    front = short.groupBy("floor_id", "item_id").agg(F.max("amount").alias("amount")).where(F.col("amount") > TOLERANCE)
    front = front.select("floor_id", "item_id", F.lit("front-clearance").alias("code"), F.lit(None).cast("string").alias("other_id"), "amount")

    out = union_rules(outside, hits, front)
    severity = F.when(F.col("code").isin(*require_clear), "hard").otherwise(looked_up(SEVERITY, F.col("code"))) if require_clear else looked_up(SEVERITY, F.col("code"))
    return out.select("floor_id", "item_id", "code", severity.alias("severity"), looked_up(CATEGORY, F.col("code")).alias("category"), "other_id", F.round("amount", 3).alias("amount"))


def surrounded(asked: DataFrame, key: tuple[str, ...], rooms: DataFrame, walls: DataFrame, fixtures: DataFrame, furniture: DataFrame, zones: DataFrame) -> DataFrame:
    """``asked`` with what poses of its items may meet: ``rooms`` (others than its own, first by ``ord``) and ``obstacles``.

    ``asked``: the ``key``, which the floor is part of, and room_id, polygon (its room's), width, depth, front_clearance.  Items have their
    centre in the room's bounds, or behind an edge of it no farther than their depth, so that they and the space in front
    reach no farther than all these lengths together.
    """
    far = F.col("width") + F.col("depth") + F.greatest("front_clearance", F.lit(WALKING_CLEARANCE)) + 1
    b = G.bounds(F.col("polygon"))
    reach = F.struct((b["min_x"] - far).alias("min_x"), (b["max_x"] + far).alias("max_x"), (b["min_z"] - far).alias("min_z"), (b["max_z"] + far).alias("max_z"))
    a = asked.select(*key, "room_id", reach.alias("reach"))
    r = rooms.select("floor_id", F.col("room_id").alias("in_room"), F.struct("ord", F.col("room_id").cast("string").alias("room_id"), "polygon", G.bounds(F.col("polygon")).alias("box")).alias("one"))
    r = r.join(a, "floor_id").where((F.col("in_room") != F.col("room_id")) & _boxes_meet(F.col("reach"), F.col("one.box")))
    o = obstacles(walls, fixtures, furniture, zones)
    o = o.select("floor_id", F.struct("rank", *[c for c in o.columns if c not in ("floor_id", "rank")]).alias("one")).join(a, "floor_id").where(_boxes_meet(F.col("reach"), F.col("one.box")))
    out = asked
    for name, d in (("rooms", r), ("obstacles", o)):
        near = d.groupBy(*key).agg(F.sort_array(F.collect_list("one")).alias(name))
        out = out.join(near, [*key], "left").withColumn(name, F.coalesce(name, F.array().cast(near.schema[name].dataType)))
    return out


def judged(poses: DataFrame) -> DataFrame:
    """``poses`` with ``issues``, sorted, as ``placement_issues`` finds them, and ``within``: whether the own room holds the item.

    ``poses``: room_id, polygon (the room's), position, rotation, width, depth, height, collides, front_clearance and the
    ``rooms`` and ``obstacles`` of ``surrounded``.  They stand on the floor and are no furniture yet.  All is found in the row:
    poses are many more than requests, so none of them is shuffled or stored.
    """
    d = poses.withColumn("own", footprint(F.col("position"), F.col("width"), F.col("depth"), F.col("rotation"))).withColumn("box", G.bounds(F.col("own")))
    zone = front_clearance(F.col("position"), F.col("width"), F.col("depth"), F.col("rotation"), F.col("front_clearance"))
    d = d.withColumn("zone", F.when(F.col("collides") & (F.col("front_clearance") > 0), zone)).withColumn("zone_box", G.bounds(F.col("zone")))
    tall = lambda o: o["min_item_top"].isNull() | (F.col("height") > o["min_item_top"])
    in_front = F.filter("obstacles", lambda o: o["kind"].isin("fixture", "furniture") & _boxes_meet(F.col("zone_box"), o["box"]))
    d = d.withColumns({
        "candidates": F.filter("rooms", lambda r: _box_inside(F.col("box"), r["box"])),
        "met": F.filter("obstacles", lambda o: (o["kind"].isin("wall", "fixture") | F.col("collides")) & tall(o) & _boxes_meet(F.col("box"), o["box"])),
        "in_front": F.when(F.col("zone").isNotNull(), F.flatten(F.transform(in_front, lambda o: o["parts"]))),
    })
    d = d.withColumns({
        "within": G.contains_polygon(F.col("polygon"), F.col("own"), TOLERANCE), "holding": G.contains_each(F.transform("candidates", lambda r: r["polygon"]), F.col("own"), TOLERANCE),
        "depths": G.parts_overlap_depths(F.transform("met", lambda o: o["parts"]), F.array("own")), "short": G.parts_overlap_depth(F.array("zone"), F.col("in_front")),
    })
    first = F.array_position("holding", F.lit(True))
    home = F.when(F.col("within") & _box_inside(F.col("box"), G.bounds(F.col("polygon"))), F.col("polygon")).when(first > 0, F.get("candidates", (first - 1).cast("int"))["polygon"])
    d = d.withColumn("home", home)
    d = d.withColumns({
        "out": G.protrusion(F.when(F.col("home").isNull(), F.col("own")), F.col("polygon")),
        "short": F.greatest("short", G.overhang(F.when(F.col("home").isNotNull(), F.col("zone")), F.col("home"), TOLERANCE)),
    })

    hits = F.zip_with("met", "depths", lambda o, amount: F.struct(o["issue"].alias("code"), o["other_id"].alias("other_id"), o["rank"].alias("rank"), amount.alias("amount")))
    hits = F.transform(F.filter(hits, lambda h: h["amount"] > TOLERANCE), lambda h, i: h.withField("rank", F.struct(h["rank"].alias("rank"), i.alias("i"))))
    spare = lambda h: F.exists("hits", lambda g: g["other_id"].eqNullSafe(h["other_id"]) & ((g["code"] == "door-swing") | ((g["code"] == h["code"]) & (g["rank"] < h["rank"]))))
    d = d.withColumn("hits", hits)
    kept = F.filter("hits", lambda h: (h["code"] != "door-clearance") | ~spare(h))
    issue = lambda code, other, amount: F.struct(code.alias("code"), looked_up(SEVERITY, code).alias("severity"), other.cast("string").alias("other_id"), F.round(amount, 3).alias("amount"))
    found = F.concat(
        F.transform(kept, lambda h: issue(h["code"], h["other_id"], h["amount"])),
        F.array_compact(F.array(F.when(F.col("home").isNull(), issue(F.lit("outside-room"), F.col("room_id"), F.col("out"))), F.when(F.col("short") > TOLERANCE, issue(F.lit("front-clearance"), F.lit(None), F.col("short"))))),
    )
    return d.select(*poses.columns, F.sort_array(found).alias("issues"), "within")


def reports(items: DataFrame, issues: DataFrame) -> DataFrame:
    """Whether each item's placement breaks a hard rule, and one that stops a move."""
    g = issues.groupBy("floor_id", "item_id").agg(F.bool_or(F.col("severity") == "hard").alias("hard"), F.bool_or(F.col("code").isin(*BLOCKING)).alias("blocked"), F.count(F.lit(1)).alias("n_issues"))
    return items.select("floor_id", "item_id").join(g, ["floor_id", "item_id"], "left").fillna(False, ["hard", "blocked"]).fillna(0, ["n_issues"])


def wall_candidates(requests: DataFrame, rooms: DataFrame, step: float = 0.05) -> DataFrame:
    """Places along each room's edges where an item fits: middle first, then outward.

    ``requests``: floor_id, request_id, room_id, width, depth.  Edges rank by length, longest first.
    """
    ring = G.edges(F.col("polygon"))
    edges = rooms.select("floor_id", "room_id", F.posexplode(ring).alias("edge", "e")).withColumn("span", G.distance(F.col("e.a"), F.col("e.b")))
    by_length = Window.partitionBy("floor_id", "room_id").orderBy(F.col("span").desc(), "edge")
    edges = edges.withColumn("rank", F.row_number().over(by_length) - 1)
    c = requests.join(edges, ["floor_id", "room_id"]).where(F.col("span") >= F.col("width"))
    slots = F.floor((F.col("span") - F.col("width")) / (2 * step) + 1e-9).cast("int")
    c = c.withColumn("slot", F.explode(F.sequence(-slots, slots)))
    # each step is a column of its own, so that no expression repeats the ones before
    c = c.withColumn("_n", G.wall_normal(F.col("e.a"), F.col("e.b"))).withColumn("_d", G.wall_direction(F.col("e.a"), F.col("e.b")))
    along = F.col("span") / 2 + F.col("slot") * step
    c = c.withColumn("position", G.add(G.add(F.col("e.a"), G.scale(F.col("_d"), along)), G.scale(F.col("_n"), F.col("depth") / 2)))
    c = c.withColumn("rotation", G.facing(F.col("_n"))).withColumn("score", 10 * F.col("rank") + F.abs(F.col("slot") * step))
    return c.select("floor_id", "request_id", "room_id", "edge", "slot", "score", "position", "rotation", footprint(F.col("position"), F.col("width"), F.col("depth"), F.col("rotation")).alias("polygon"))


def fitted(requests: DataFrame, rooms: DataFrame, obstacles: DataFrame) -> DataFrame:
    """The best free candidate of each request, or none: candidates that meet an obstacle drop out."""
    c = wall_candidates(requests, rooms).withColumn("_c", G.bounds(F.col("polygon")))
    o = obstacles.select("floor_id", F.col("polygon").alias("other"), G.bounds(F.col("polygon")).alias("_b"))
    near = (F.col("_c.min_x") < F.col("_b.max_x")) & (F.col("_b.min_x") < F.col("_c.max_x")) & (F.col("_c.min_z") < F.col("_b.max_z")) & (F.col("_b.min_z") < F.col("_c.max_z"))
    blocked = c.join(o, "floor_id").where(near).where(G.overlap_depth(F.col("polygon"), F.col("other")) > TOLERANCE).select("floor_id", "request_id", "edge", "slot").distinct()
    free = c.join(blocked, ["floor_id", "request_id", "edge", "slot"], "left_anti")
    inside = free.join(rooms.select("floor_id", "room_id", F.col("polygon").alias("room_polygon")), ["floor_id", "room_id"]).where(G.contains_polygon(F.col("room_polygon"), F.col("polygon"), TOLERANCE))
    best = inside.groupBy("floor_id", "request_id").agg(F.min_by(F.struct("position", "rotation", "score"), F.struct("score", "edge", "slot")).alias("b"))
    return requests.select("floor_id", "request_id").join(best, ["floor_id", "request_id"], "left").select("floor_id", "request_id", F.col("b").isNotNull().alias("ok"), "b.position", "b.rotation", "b.score")
