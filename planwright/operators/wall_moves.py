"""Moving interior walls sideways with all that hangs on them, or refusing with a reason.

Every request is judged on its own against its floor, many floors at once.  Ends of the moved wall slide
along the walls they meet, ends of other walls slide along themselves, room edges on its faces follow,
openings keep their place; what can't be done exactly is refused.  Walls, ends, outline points and room
edges meet in cells of a grid on the floor, so that a wall is held only against what lies near it.

``walls``: floor_id, wall_id, ord, kind, start, end, thickness; ``rooms``: floor_id, room_id, ord, polygon;
``openings``: floor_id, id, wall_id, offset; ``outlines``: floor_id, outline (points of the building's
outline); ``requests``: floor_id, request_id, wall_id, distance (metres along the wall's normal).
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwright.functions import geometry as G
from planwright.operators.spatial import box_cells, segment_cells
from planwright.sources.lineage import cut

#: Fixed values, in metres: what counts as touching, as too near to tell, and the shortest wall left.
JUNCTION_TOLERANCE, AMBIGUOUS_GAP, MIN_WALL_LENGTH = 0.03, 0.2, 0.05
#: Fixed value: cosine below which directions count as parallel.
MIN_CROSSING = 0.2
#: Width of a cell, in metres.
CELL = 2.0
#: What each code of a refusal says.
REASONS = {
    "unknown-wall": "There is no such wall.",
    "no-distance": "The distance must be a number of metres other than zero.",
    "not-interior": "Exterior walls and railings shape the building and stay where they are.",
    "outline": "The wall is part of the building's outline.",
    "ambiguous-end": "The wall ends near another wall without touching it.",
    "straight-line": "The wall runs on into another wall in a straight line, with no crossing wall between them.",
    "too-short": "The wall would become too short.",
    "ambiguous-junction": "Another wall ends near the wall without touching it.",
    "torn-junction": "Another wall meets the wall where a third one holds it.",
    "stretches-outline": "The move would stretch an exterior wall or a railing.",
    "collapses": "The move would collapse a wall that ends on this one.",
    "ambiguous-boundary": "A room's outline runs beside the wall's face without lying on it.",
    "runs-past": "A room's edge runs on past the end of the wall.",
    "shallow-corner": "A corner of a room meets the wall at too shallow an angle.",
}
KEY = "floor_id", "request_id"


class Moves(NamedTuple):
    """``refused``: code, subject, gap and message per request; else the new walls, room outlines and offsets."""

    refused: DataFrame
    walls: DataFrame
    rooms: DataFrame
    openings: DataFrame


def _framed(walls: DataFrame, name: str) -> DataFrame:
    """floor_id and one struct per wall: its own axes beside its fields."""
    d = walls.withColumn("d", G.wall_direction(F.col("start"), F.col("end")))
    n = G.point(-F.col("d.z"), F.col("d.x"))
    return d.select("floor_id", F.struct("ord", F.col("wall_id").alias("id"), "kind", "start", "end", (F.col("thickness") / 2).alias("half"), G.distance(F.col("start"), F.col("end")).alias("length"), "d", n.alias("n")).alias(name))


def _side(f: Column, p: Column) -> Column:
    return G.dot(G.sub(p, f["start"]), f["n"])


def _along(f: Column, p: Column) -> Column:
    return G.dot(G.sub(p, f["start"]), f["d"])


def _ends(f: Column) -> Column:
    """A wall's two ends as (key, p)."""
    return F.explode(F.array(F.struct(F.lit(0).alias("key"), f["start"].alias("p")), F.struct(F.lit(1).alias("key"), f["end"].alias("p"))))


def _touched(x: Column, p: Column, pad: Column) -> tuple[Column, Column]:
    """Whether a point lies beside a wall's length (with a pad at its ends), and its distance from the face."""
    along = _along(x, p)
    return (along >= -pad) & (along <= x["length"] + pad), F.abs(_side(x, p)) - x["half"]


def _refusal(df: DataFrame, broken: Column, step: int, code: Column | str, ord_: Column, sub: Column, subject: Column, gap: Column | None = None) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    gap = F.lit(None).cast("double") if gap is None else gap
    why = F.struct(F.lit(step).alias("step"), ord_.cast("long").alias("ord"), sub.cast("int").alias("sub"), code.alias("code"), subject.cast("string").alias("subject"), gap.alias("gap"))
    return df.where(broken).select(*KEY, why.alias("why"))


def moved(requests: DataFrame, walls: DataFrame, rooms: DataFrame, openings: DataFrame, outlines: DataFrame) -> Moves:
    """What becomes of every request."""
    zero, tol, m, f, p = F.lit(0), JUNCTION_TOLERANCE, F.col("m"), F.col("f"), F.col("p")
    asked = requests.select(*KEY, "wall_id", F.col("distance").cast("double").alias("distance"))
    own = _framed(walls, "m").withColumn("wall_id", F.col("m.id"))
    asked = asked.join(own, ["floor_id", "wall_id"], "left")
    number = F.coalesce(~F.isnan("distance") & (F.abs("distance") < float("inf")) & (F.abs("distance") >= 1e-6), F.lit(False))
    inner = F.coalesce(F.col("m.kind") == "interior", F.lit(False))
    refusals = [
        _refusal(asked, m.isNull(), 0, "unknown-wall", zero, zero, F.col("wall_id")),
        _refusal(asked, ~number, 1, "no-distance", zero, zero, F.col("wall_id")),
        _refusal(asked, m.isNotNull() & ~inner, 2, "not-interior", zero, zero, F.col("wall_id")),
    ]
    live = asked.where(m.isNotNull() & number & inner)
    live = cut(live)
    around = live.withColumn("cell", F.explode(segment_cells(m["start"], m["end"], m["half"] + AMBIGUOUS_GAP, CELL)))
    frames = _framed(walls, "f")
    reached = frames.withColumn("cell", F.explode(segment_cells(f["start"], f["end"], f["half"] + AMBIGUOUS_GAP, CELL)))
    around, reached = cut(around), cut(reached)

    corner = outlines.select("floor_id", F.explode("outline").alias("p")).withColumn("cell", F.explode(box_cells(p, F.lit(tol), CELL)))
    along = _along(m, p)
    outlined = around.join(corner, ["floor_id", "cell"]).where((F.abs(_side(m, p)) <= m["half"] + tol) & (along > -tol) & (along < m["length"] + tol))
    refusals.append(_refusal(outlined, F.lit(True), 3, "outline", zero, zero, F.col("wall_id")))

    # the wall's own ends
    ends = live.select("*", _ends(m).alias("e")).select(*KEY, "wall_id", "m", "distance", "e.key", "e.p")
    beside, gap = _touched(f, p, m["half"] + tol)
    crossing = F.abs(G.dot(f["d"], m["n"]))
    met = ends.withColumn("cell", F.explode(box_cells(p, m["half"] + tol, CELL))).join(reached, ["floor_id", "cell"]).where((f["id"] != F.col("wall_id")) & beside & (gap <= AMBIGUOUS_GAP))
    hosts = met.groupBy(*KEY, "key").agg(
        F.min(F.when(gap > tol, F.struct(f["ord"].alias("ord"), f["id"].alias("id"), gap.alias("gap")))).alias("unclear"),
        F.min(F.when((gap <= tol) & (crossing < MIN_CROSSING), F.struct(f["ord"].alias("ord"), f["id"].alias("id")))).alias("parallel"),
        F.max(F.when((gap <= tol) & (crossing >= MIN_CROSSING), F.struct(crossing.alias("crossing"), (-f["ord"]).alias("first"), f["n"].alias("n")))).alias("host"),
    )
    ends = ends.join(hosts, [*KEY, "key"], "left")
    delta = G.scale(m["n"], F.col("distance"))
    slide = -G.dot(delta, F.col("host.n")) / G.dot(m["d"], F.col("host.n"))
    ends = cut(ends.withColumn("new", G.add(G.add(p, delta), G.scale(m["d"], F.coalesce(slide, F.lit(0.0))))))
    refusals += [
        _refusal(ends, F.col("unclear").isNotNull(), 4, "ambiguous-end", F.col("key"), zero, F.col("unclear.id"), F.col("unclear.gap")),
        _refusal(ends, F.col("host").isNull() & F.col("parallel").isNotNull(), 4, "straight-line", F.col("key"), F.lit(1), F.col("parallel.id")),
    ]
    of = lambda k, c: F.max(F.when(F.col("key") == k, F.col(c)))
    held = lambda k: F.coalesce(F.bool_or((F.col("key") == k) & F.col("host").isNotNull()), F.lit(False))
    base = ends.groupBy(*KEY).agg(of(0, "new").alias("start"), of(1, "new").alias("end"), held(0).alias("held_start"), held(1).alias("held_end"))
    base = cut(live.join(base, [*KEY]))
    refusals.append(_refusal(base, G.dot(G.sub(F.col("end"), F.col("start")), m["d"]) < MIN_WALL_LENGTH, 5, "too-short", zero, zero, F.col("wall_id")))

    # ends of other walls on this one
    tips = frames.select("floor_id", "f", _ends(f).alias("e")).select("floor_id", "f", "e.key", "e.p")
    beside, gap = _touched(m, p, f["half"] + tol)
    near = around.join(tips.withColumn("cell", F.explode(box_cells(p, f["half"] + tol, CELL))), ["floor_id", "cell"]).where((f["id"] != F.col("wall_id")) & beside & (gap <= AMBIGUOUS_GAP))
    near = near.select(*KEY, "wall_id", "m", "distance", "f", f["id"].alias("tip_id"), "key", "p").dropDuplicates([*KEY, "tip_id", "key"])
    near = cut(near)
    x = F.col("x")
    beside_x, gap_x = _touched(x, p, f["half"] + tol)
    third = near.withColumn("cell", F.explode(box_cells(p, f["half"] + tol, CELL))).join(reached.withColumnRenamed("f", "x"), ["floor_id", "cell"])
    third = third.where((x["id"] != F.col("tip_id")) & (x["id"] != F.col("wall_id")) & (F.abs(G.dot(f["d"], x["n"])) >= MIN_CROSSING) & (gap_x <= tol) & beside_x)
    near = near.join(third.select(*KEY, "tip_id", "key").distinct().withColumn("pinned", F.lit(True)), [*KEY, "tip_id", "key"], "left").join(base.select(*KEY, "held_start", "held_end"), [*KEY])
    gap, along, crossing = F.abs(_side(m, p)) - m["half"], _along(m, p), G.dot(f["d"], m["n"])
    within = (along >= -tol) & (along <= m["length"] + tol)
    at_end = F.when(along <= f["half"] + tol, F.col("held_start")).when(along >= m["length"] - f["half"] - tol, F.col("held_end")).otherwise(F.lit(False))
    verdict = (
        F.when(gap > tol, F.when(within, "ambiguous-junction").otherwise("apart"))
        .when(F.abs(crossing) < MIN_CROSSING, F.when(at_end, "apart").otherwise("straight-line"))
        .when(F.col("pinned"), F.when(within, "torn-junction").otherwise("apart"))
        .when(f["kind"] != "interior", "stretches-outline")
        .otherwise("slides")
    )
    near = cut(near.withColumn("verdict", verdict))
    refusals.append(_refusal(near, ~F.col("verdict").isin("apart", "slides"), 6, F.col("verdict"), f["ord"], F.col("key"), F.col("tip_id"), F.when(F.col("verdict") == "ambiguous-junction", gap)))
    shift = F.col("distance") / crossing
    tip = lambda k, c: F.max(F.when(F.col("key") == k, c))
    slid = near.where("verdict = 'slides'").groupBy(*KEY, "tip_id").agg(
        F.first("f").alias("f"), tip(0, G.add(p, G.scale(f["d"], shift))).alias("start"), tip(1, G.add(p, G.scale(f["d"], shift))).alias("end"), F.coalesce(tip(0, shift), F.lit(0.0)).alias("shift"),
        F.min(along - f["half"]).alias("lo"), F.max(along + f["half"]).alias("hi"),
    ).withColumns({"start": F.coalesce("start", f["start"]), "end": F.coalesce("end", f["end"])})
    slid = cut(slid)
    refusals.append(_refusal(slid, G.dot(G.sub(F.col("end"), F.col("start")), f["d"]) < MIN_WALL_LENGTH, 6, "collapses", f["ord"], F.lit(2), F.col("tip_id")))

    # room edges on its faces
    reach = base.join(slid.groupBy(*KEY).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), [*KEY], "left")
    reach = reach.select(*KEY, "m", "distance", F.least(F.lit(0.0), "lo").alias("lo"), F.greatest(F.col("m.length"), F.col("hi")).alias("hi"))
    edges = rooms.select("floor_id", "room_id", F.explode(G.edges(F.col("polygon"))).alias("e")).withColumn("cell", F.explode(segment_cells(F.col("e.a"), F.col("e.b"), F.lit(0.0), CELL)))
    pairs = around.select(*KEY, "cell").join(edges.select("floor_id", "room_id", "cell"), ["floor_id", "cell"]).select(*KEY, "room_id").distinct()
    judged = cut(_outlines(pairs.join(reach, [*KEY]).join(rooms.select("floor_id", "room_id", "ord", "polygon"), ["floor_id", "room_id"])))
    for sub, code in enumerate(("ambiguous-boundary", "runs-past", "shallow-corner")):
        refusals.append(_refusal(judged, F.col("broken") == code, 7, code, F.col("ord"), F.lit(sub), F.col("room_id"), F.col("off") if sub == 0 else None))

    why = F.col("why")
    refused = reduce(DataFrame.unionByName, refusals).groupBy(*KEY).agg(F.min("why").alias("why"))
    refused = cut(refused)
    texts = F.create_map(*[F.lit(t) for pair in REASONS.items() for t in pair])
    refused = refused.select(*KEY, why["code"].alias("code"), why["subject"].alias("subject"), why["gap"].alias("gap"), texts[why["code"]].alias("message"))
    fine = base.join(refused.select(*KEY), [*KEY], "left_anti")
    first = G.dot(G.sub(F.col("start"), m["start"]), m["d"])
    changed = fine.select(*KEY, "wall_id", "start", "end", first.alias("shift")).unionByName(slid.join(fine.select(*KEY), [*KEY], "left_semi").select(*KEY, F.col("tip_id").alias("wall_id"), "start", "end", "shift"))
    outlines_new = judged.where("broken IS NULL AND touched").join(fine.select(*KEY), [*KEY], "left_semi").select(*KEY, "room_id", F.col("moved").alias("polygon"))
    offsets = openings.join(changed.where("shift <> 0").select(*KEY, "wall_id", "shift"), ["floor_id", "wall_id"]).select(*KEY, "id", "wall_id", (F.col("offset") - F.col("shift")).alias("offset"))
    return Moves(refused, changed.drop("shift"), outlines_new, offsets)


def _outlines(pairs: DataFrame) -> DataFrame:
    """Room outlines beside moved walls: ``touched``, the outline as ``moved``, or what is ``broken``."""
    tol, m, poly, distance = JUNCTION_TOLERANCE, F.col("m"), F.col("polygon"), F.col("distance")
    n = F.size("polygon")
    d = pairs.withColumn("q", F.transform(poly, lambda p: F.struct(_side(m, p).alias("side"), _along(m, p).alias("along"))))
    after = lambda a, i: F.get(a, (i + 1) % n)
    before = lambda a, i: F.get(a, (i - 1 + n) % n)

    def face(a: Column, i: Column) -> Column:
        b = after(F.col("q"), i)
        on = lambda s: (F.abs(a["side"] - s * m["half"]) <= tol) & (F.abs(b["side"] - s * m["half"]) <= tol)
        beside = (F.greatest(a["along"], b["along"]) <= tol) | (F.least(a["along"], b["along"]) >= m["length"] - tol)
        return F.when(~on(1) & ~on(-1) | beside, 0).when(on(1), 1).otherwise(-1)

    d = d.withColumn("faces", F.transform("q", face))

    def off(a: Column, i: Column) -> Column:
        """How far an edge beside the wall lies off its face, or null where that is clear."""
        b = after(F.col("q"), i)
        run, rise = b["along"] - a["along"], b["side"] - a["side"]
        part = lambda at: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (at - a["along"]) / run))
        t0, t1 = part(F.lit(tol)), part(m["length"] - tol)
        gap = lambda t: F.abs(a["side"] + t * rise) - m["half"]
        level = (F.abs(rise) < MIN_CROSSING * F.hypot(run, rise)) & (F.abs(run) >= 1e-9)
        unclear = level & (F.abs(t1 - t0) * F.abs(run) > tol) & (F.greatest(gap(t0), gap(t1)) <= AMBIGUOUS_GAP)
        return F.when((F.get("faces", i) == 0) & unclear, F.greatest(F.abs(gap(t0)), F.abs(gap(t1))))

    past = F.exists(F.transform("q", lambda a, i: (F.get("faces", i) != 0) & ((F.least(a["along"], after(F.col("q"), i)["along"]) < F.col("lo") - tol) | (F.greatest(a["along"], after(F.col("q"), i)["along"]) > F.col("hi") + tol))), lambda x: x)
    delta = G.scale(m["n"], distance)

    def corner(p: Column, i: Column) -> Column:
        """A point's new place; null where it can't slide."""
        prev, next_ = before(F.col("faces"), i) != 0, F.get("faces", i) != 0
        u = G.sub(p, F.when(prev, after(poly, i)).otherwise(before(poly, i)))
        rise = G.dot(u, m["n"])
        shallow = (G.length(u) < 1e-9) | (F.abs(rise) < MIN_CROSSING * G.length(u))
        return F.when(~prev & ~next_, p).when(prev & next_, G.add(p, delta)).when(~shallow, G.add(p, G.scale(u, distance / rise)))

    d = d.withColumns({"off": F.get(F.filter(F.transform("q", off), lambda x: x.isNotNull()), 0), "touched": F.exists("faces", lambda s: s != 0), "past": past, "moved": F.transform(poly, corner)})
    stuck = F.exists("moved", lambda p: p.isNull())
    broken = F.when(F.col("off").isNotNull(), "ambiguous-boundary").when(~F.col("touched"), None).when(F.col("past"), "runs-past").when(stuck, "shallow-corner")
    return d.withColumn("broken", broken)


def after(relation: DataFrame, accepted: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """A relation of the floors as each accepted request (floor_id, request_id) leaves it, with ``by_user`` where it changed."""
    news = [c for c in changed.columns if c not in (*KEY, key) and c in relation.columns]
    new = changed.select(*KEY, key, F.struct(*news).alias("_new"))
    d = relation.join(accepted.select(*KEY), "floor_id").join(new, [*KEY, key], "left")
    return d.select(*KEY, *[F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) if c in news else F.col(c) for c in relation.columns if c != "floor_id"], F.col("_new").isNotNull().alias("by_user"))
