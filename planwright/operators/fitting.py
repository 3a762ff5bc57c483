"""Fitting furniture into rooms: the best pose of each request, one after the other in every room at once.

A round takes the next request of each room, so that what was placed before stands in the way of what
comes after; rooms don't wait for each other.  Candidate poses are rows: backs against room edges, middle
first, or a grid about the place that goes well with other furniture.  They are tried in the order of
their score, a first part and then the rest, because a pose without any issue beats all later ones.
Poses are many more than requests: a task makes, judges and reduces them, and only requests are shuffled or written.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwright.functions import geometry as G
from planwright.operators import placement
from planwright.sources.lineage import cut, spread

#: Fixed values, in metres: steps along a wall and of the grid; what a turned pose costs.
STEP, GRID, TURNED = 0.05, 0.1, 0.05
#: What an item wants to stand in front of: its category, the other's, the gap, and whether it faces it.
ANCHORS = (("coffee-table", "sofa", 0.45, False), ("office-chair", "desk", 0.05, True), ("dining-chair", "dining-table", -0.15, True), ("rug", "sofa", 0.2, False))
#: Fixed value: a rug without a sofa lies under the bed.
UNDER = ("rug", "bed")
#: Poses of a score up to this are tried first; most poses of one request, and about how many of all, that a task looks at.
NEAR, SHARE, TASK = 0.0, 4096, 200_000
KEY = "floor_id", "request_id"
FURNITURE = ("floor_id", "item_id", "room_id", "category", "ord", "position", "rotation", "width", "depth", "height", "elevation", "collides", "front_clearance")


def _inward(a: Column, b: Column, turn: Column) -> Column:
    n = G.wall_normal(a, b)
    return G.scale(n, F.signum(turn))


def _ring(polygon: Column) -> Column:
    return F.transform(G.edges(polygon), lambda e, i: F.struct(i.alias("edge"), G.distance(e["a"], e["b"]).alias("span"), e["a"].alias("a"), e["b"].alias("b")))


def _slots(span: Column, width: Column) -> Column:
    """How many slots there are on either side of an edge's middle."""
    return F.floor((span / 2 - width / 2 + 1e-9) / STEP).cast("int")


def _places(low: Column, high: Column, inset: Column) -> Column:
    """Coordinates of the grid between two bounds."""
    steps = F.greatest(F.lit(-1), F.floor((high - low - 2 * inset + 1e-9) / GRID)).cast("int") + 1
    return F.filter(F.transform(F.sequence(F.lit(0), steps), lambda i: low + inset + i * GRID), lambda v: v <= high - inset + 1e-9)


def wall_poses(asked: DataFrame, tried=None) -> DataFrame:
    """Poses with the back to each edge that is long enough, from its middle outward; score 10 a rank and the way from the middle.

    ``asked``: floor_id, request_id, polygon, width, depth, prefer_wall, shares and share (a request of many poses comes
    in as many rows as it has shares); its columns come back with position, rotation, score and order.  ``tried`` keeps
    poses by their score.
    """
    long_enough = F.filter(_ring(F.col("polygon")), lambda e: e["span"] >= F.col("width"))
    by_rank = F.array_sort(F.transform(long_enough, lambda e: F.struct(F.when(F.col("prefer_wall") == "longest", -e["span"]).otherwise(F.lit(0.0)).alias("longest"), *[e[k].alias(k) for k in ("edge", "span", "a", "b")])))
    d = asked.withColumn("turn", G.signed_area(F.col("polygon"))).select("*", F.posexplode(by_rank).alias("rank", "e"))
    d = d.withColumns({"span": F.col("e.span"), "way": G.wall_direction(F.col("e.a"), F.col("e.b")), "normal": _inward(F.col("e.a"), F.col("e.b"), F.col("turn"))})
    slots = _slots(F.col("span"), F.col("width"))
    d = d.withColumn("slot", F.explode(F.sequence(-slots, slots))).where(F.pmod("slot", "shares") == F.col("share"))
    score = (F.col("rank") * 10 + F.abs(F.col("slot") * STEP)).cast("double")
    if tried is not None:
        d = d.where(tried(score))
    at = F.col("span") / 2 + F.col("slot") * STEP
    position = G.add(G.add(F.col("e.a"), G.scale(F.col("way"), at)), G.scale(F.col("normal"), F.col("depth") / 2 + placement.WALL_GAP))
    order = F.struct(F.col("rank").cast("double").alias("a"), F.abs("slot").cast("double").alias("b"), F.col("slot").cast("double").alias("c"), F.lit(0.0).alias("d"))
    return d.select(*asked.columns, position.alias("position"), G.facing(F.col("normal")).alias("rotation"), score.alias("score"), order.alias("order"))


def free_poses(asked: DataFrame, tried=None) -> DataFrame:
    """Poses on a grid over the room's bounds, nearest first to the anchor or else the centre, as it stands there or turned.

    ``asked`` and ``tried`` as for ``wall_poses``, with anchor (point, rotation) or null.
    """
    p = F.col("polygon")
    ring = F.transform(_ring(p), lambda e: F.struct(e["span"].alias("span"), (-e["edge"]).alias("first"), e["a"].alias("a"), e["b"].alias("b")))
    d = asked.withColumns({"box": G.bounds(p), "longest": F.array_max(ring), "turn": G.signed_area(p), "inset": F.least("width", "depth") / 2})
    base = F.coalesce("anchor.rotation", G.facing(_inward(F.col("longest.a"), F.col("longest.b"), F.col("turn"))))
    d = d.withColumns({"target": F.coalesce("anchor.point", G.centroid(p)), "base": base})
    b = F.col("box")
    d = d.select("*", F.posexplode(_places(b["min_x"], b["max_x"], F.col("inset"))).alias("column", "x")).where(F.pmod("column", "shares") == F.col("share")).withColumn("z", F.explode(_places(b["min_z"], b["max_z"], F.col("inset"))))
    d = d.withColumn("turned", F.explode(F.when(F.col("anchor").isNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    at = G.point(F.col("x"), F.col("z"))
    d = d.withColumn("score", G.distance(at, F.col("target")) + F.col("turned") * TURNED)
    if tried is not None:
        d = d.where(tried(F.col("score")))
    order = F.struct(F.col("score").alias("a"), F.col("x").alias("b"), F.col("z").alias("c"), F.col("turned").cast("double").alias("d"))
    return d.select(*asked.columns, at.alias("position"), (F.col("base") + F.col("turned") * (math.pi / 2)).alias("rotation"), "score", order.alias("order"))


def _counted(anchor: Column) -> Column:
    """How many poses a request has."""
    b, inset = G.bounds(F.col("polygon")), F.least("width", "depth") / 2
    walls = F.aggregate(F.filter(_ring(F.col("polygon")), lambda e: e["span"] >= F.col("width")), F.lit(0).cast("long"), lambda n, e: n + 2 * _slots(e["span"], F.col("width")) + 1)
    free = F.size(_places(b["min_x"], b["max_x"], inset)).cast("long") * F.size(_places(b["min_z"], b["max_z"], inset)) * F.when(anchor.isNull(), 2).otherwise(1)
    return F.coalesce(F.when(F.col("against_wall"), walls).otherwise(free), F.lit(0).cast("long"))


def anchored(asked: DataFrame, furniture: DataFrame) -> DataFrame:
    """``asked`` with ``anchor``: where a free-standing item goes well with the first fitting item of its room."""
    front = lambda gap: G.add(F.col("f.position"), G.rotate(G.point(F.lit(0.0), F.col("f.depth") / 2 + gap + F.col("depth") / 2), F.col("f.rotation")))
    f = furniture.select("floor_id", "room_id", F.struct(*FURNITURE).alias("f"))
    wanted = F.when(F.lit(False), F.lit(None).cast("int"))
    point, rotation = F.col("f.position"), F.col("f.rotation")
    for i, (own, other, gap, faces) in enumerate(ANCHORS):
        fits = (F.col("category") == own) & (F.col("f.category") == other)
        wanted = wanted.when(fits, i)
        point = F.when(fits, front(gap)).otherwise(point)
        rotation = F.when(fits, F.col("f.rotation") + (math.pi if faces else 0.0)).otherwise(rotation)
    wanted = wanted.when((F.col("category") == UNDER[0]) & (F.col("f.category") == UNDER[1]), len(ANCHORS))
    d = asked.select(*KEY, "room_id", "category", "depth").join(f, ["floor_id", "room_id"]).withColumn("wanted", wanted).where("wanted IS NOT NULL")
    one = F.struct(point.alias("point"), rotation.alias("rotation"))
    best = d.groupBy(*KEY).agg(F.min_by(one, F.struct("wanted", "f.ord", "f.item_id")).alias("anchor"))
    return asked.join(best, [*KEY], "left")


def _best(asked: DataFrame, tried) -> DataFrame:
    """The best pose that may be taken (no hard issue, within the room), the closest that may not, and whether the first of all ends the search.

    One row per request of which a pose was looked at.
    """
    poses = wall_poses(asked.where("against_wall"), tried).unionByName(free_poses(asked.where("NOT against_wall"), tried))
    d = placement.judged(poses)
    hard = F.filter("issues", lambda i: i["severity"] == "hard")
    badness = F.size(hard) * 10 + F.aggregate(hard, F.lit(0.0), lambda s, i: s + F.coalesce(i["amount"], F.lit(1.0)))
    fits, total = (F.size(hard) == 0) & F.col("within"), F.size("issues") * 100 + F.col("score")
    d = d.select(
        *KEY, F.when(fits, F.struct(total.alias("total"), "order", "position", "rotation", "issues")).alias("best"), F.when(~fits, F.struct(badness.alias("badness"), "order", "position", "rotation", F.col("issues").alias("violations"))).alias("closest"),
        (fits & (F.size("issues") == 0)).alias("settled"), (fits & (F.size("issues") == 0) & (F.col("score") == 0)).alias("stop"),
    )
    return _merged(d)


def _merged(d: DataFrame) -> DataFrame:
    return d.groupBy(*KEY).agg(F.min("best").alias("best"), F.min("closest").alias("closest"), F.bool_or("settled").alias("settled"), F.bool_or("stop").alias("stop"))


def fitted(requests: DataFrame, catalog: DataFrame, rooms: DataFrame, walls: DataFrame, fixtures: DataFrame, furniture: DataFrame, zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What becomes of each request, and the furniture with all that was placed.

    ``requests``: floor_id, request_id, ord, room_id, catalog_id, width, depth, height and prefer_wall (null
    for the catalogue's); ``furniture`` as FURNITURE; the rest as in ``placement``.  Placements: floor_id,
    request_id, ok, failure, position, rotation, width, depth, height, issues (of the chosen pose), tried (number of
    poses looked at), closest (the pose that came closest where none fits).  There are as many rounds as the
    room with most requests has of them.
    """
    c = catalog.select("catalog_id", "category", "size", "against_wall", F.col("prefer_wall").alias("own_wall"), "front_clearance", "collides")
    r = rooms.select("floor_id", "room_id", "polygon")
    size = lambda k: F.coalesce(F.col(k).cast("double"), F.col(f"size.{k}"))
    d = requests.join(F.broadcast(c), "catalog_id", "left").join(r, ["floor_id", "room_id"], "left")
    d = d.withColumns({k: size(k) for k in ("width", "depth", "height")}).withColumn("prefer_wall", F.coalesce("prefer_wall", "own_wall"))
    b, w, h = G.bounds(F.col("polygon")), F.col("width"), F.col("depth")
    wide, deep = b["max_x"] - b["min_x"], b["max_z"] - b["min_z"]
    fits = ((w <= wide) & (h <= deep)) | ((w <= deep) & (h <= wide))
    failure = F.when(F.col("polygon").isNull(), "unknown-room").when(F.col("category").isNull(), "unknown-item").when(~fits, "too-large")
    d = d.withColumn("failure", failure).withColumn("round", F.row_number().over(Window.partitionBy("floor_id", "room_id").orderBy("ord", "request_id")))
    d = cut(d.drop("size", "own_wall"))
    world = {"rooms": rooms, "walls": walls, "fixtures": fixtures, "zones": zones}
    result = [_failed(d.where("failure IS NOT NULL"))]
    live = d.where("failure IS NULL")
    furniture = furniture.select(*FURNITURE)
    rounds = live.groupBy("round").agg(F.count(F.lit(1)), F.sum(_counted(F.lit(None)))).collect()
    for k, requests, poses in sorted(map(tuple, rounds)):
        asked = live.where(F.col("round") == k)
        free = anchored(asked.where("NOT against_wall"), furniture)
        asked = asked.where("against_wall").unionByName(free, allowMissingColumns=True).withColumn("n", _counted(F.col("anchor")))
        asked = placement.surrounded(asked, KEY, furniture=furniture, **world)
        asked = cut(spread(asked, *KEY, tasks=requests // TASK))
        result.append(_failed(asked.where("n = 0").withColumn("failure", F.lit("no-wall-long-enough"))))
        seen = cut(_best(asked.withColumns({"shares": F.lit(1), "share": F.lit(0)}), lambda score: score <= NEAR))
        rest = asked.join(seen.where("settled").select(*KEY), [*KEY], "left_anti").withColumn("shares", F.ceil(F.col("n") / SHARE).cast("int"))
        rest = rest.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        seen = _merged(seen.unionByName(_best(spread(rest, *KEY, "share", tasks=poses // TASK), lambda score: ~F.coalesce(score <= NEAR, F.lit(False)))))
        best = asked.where("n > 0").join(seen, [*KEY], "left")
        placed = F.col("best").isNotNull()
        closest = F.struct("closest.position", "closest.rotation", "closest.violations")
        out = best.select(
            *KEY, placed.alias("ok"), F.when(~placed, "no-valid-position").alias("failure"), "best.position", "best.rotation", "width", "depth", "height", F.col("best.issues").alias("issues"),
            F.when(F.col("stop"), F.lit(1).cast("long")).otherwise(F.col("n")).alias("tried"), F.when(~placed & F.col("closest").isNotNull(), closest).alias("closest"), "room_id", "category", "collides", "front_clearance", "ord",
        )
        out = cut(out)
        result.append(out.select(*result[0].columns))
        new = out.where("ok").select("floor_id", F.col("request_id").cast("string").alias("item_id"), "room_id", "category", F.lit(2**40 + k).alias("ord"), "position", "rotation", "width", "depth", "height", F.lit(0.0).alias("elevation"), "collides", "front_clearance")
        furniture = furniture.unionByName(new)
    whole = result[0]
    for part in result[1:]:
        whole = whole.unionByName(part)
    return whole, furniture


def _failed(d: DataFrame) -> DataFrame:
    issue = "struct<code:string,severity:string,other_id:string,amount:double>"
    point = "struct<x:double,z:double>"
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return d.select(
        *KEY, F.lit(False).alias("ok"), "failure", null(point, "position"), null("double", "rotation"), "width", "depth", "height", null(f"array<{issue}>", "issues"), F.lit(0).cast("long").alias("tried"),
        null(f"struct<position:{point},rotation:double,violations:array<{issue}>>", "closest"),
    )


def explained(placements: DataFrame, item: Column, room: Column) -> DataFrame:
    """``placements`` with ``explanation``: what was done, or what stood in the way and by how much."""
    rule = lambda i: placement.looked_up(placement.RULE, i["code"])
    by = lambda i: F.coalesce(F.format_string(" by %.2f m", i["amount"]), F.lit(""))
    soft = lambda i: F.when(i["severity"] == "soft", " (preference)").otherwise("")
    listed = lambda c: F.array_join(F.transform(c, lambda i: F.concat(F.lit("- "), rule(i), by(i), soft(i))), "\n")
    where = F.coalesce(F.concat(F.lit(" in "), room), F.lit(""))
    good = F.when(F.size("issues") == 0, F.concat(F.lit("Placed "), item, where, F.lit(". All hard rules and clearances are satisfied.")))
    good = good.otherwise(F.concat(F.lit("Placed "), item, where, F.lit(", with compromises:\n"), listed(F.col("issues"))))
    bad = F.concat(F.lit("Cannot place "), item, where, F.lit(".\nReason: "), F.col("failure"))
    tried = F.format_string("\nChecked %d candidate positions/orientations.\nBest candidate violated:\n", F.col("tried"))
    bad = F.concat(bad, F.when(F.col("closest").isNotNull(), F.concat(tried, listed(F.col("closest.violations")))).otherwise(F.lit("")))
    return placements.withColumn("explanation", F.when(F.col("ok"), good).otherwise(bad))
