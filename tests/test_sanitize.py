"""Repairs of extracted plans."""

from pyspark.sql import functions as F

from planwright.operators import sanitize
from planwright.operators.annotated import wall_geometry

PT = "struct<x:double,z:double>"
OPENINGS = "plan_id string, id string, ord int, wall_id string, kind string, confidence double, span_from double, span_to double, extra string"


def box(x0, z0, x1, z1):
    return [(float(x0), float(z0)), (float(x1), float(z0)), (float(x1), float(z1)), (float(x0), float(z1))]


def test_sanitized(spark):
    rect = "struct<x0:double,y0:double,x1:double,y1:double>"
    walls = spark.createDataFrame(
        [("p", "w", (10.0, 0.0, 210.0, 10.0), None), ("p", "flat", (0.0, 0.0, 0.0, 50.0), None), ("p", "back", None, ((0.0, 100.0), (0.0, 0.0), 8.0)), ("p", "bare", None, None), ("q", "w", (0.0, 0.0, 100.0, 10.0), None)],
        f"plan_id string, id string, rect {rect}, segment struct<a:{PT},b:{PT},thickness:double>",
    )
    door = lambda i, n, w, kind, c, a, b, p="p": (p, n, i, w, kind, c, float(a), float(b), "x")
    doors = spark.createDataFrame(
        [door(0, "d1", "w", "hinged", 0.6, 20, 50), door(1, "d2", "w", "hinged", 0.9, 45, 70), door(2, "d3", "w", "opening", 0.9, 100, 130), door(3, "d4", "flat", "hinged", 0.9, 0, 9), door(4, "d5", "w", "hinged", 0.9, 200, 300), door(5, "d6", "w", "hinged", 0.9, 205, 212), door(6, "d7", "back", "sliding", None, 90, 20), door(7, "d8", "none", "hinged", 1.0, 1, 9), door(0, "d1", "w", "hinged", 0.5, 5, 95, "q")],
        OPENINGS,
    )
    windows = spark.createDataFrame([door(0, "v1", "w", None, 0.4, 120, 150), door(1, "v2", "w", None, 0.9, 65, 80), door(2, "v3", "w", None, 0.9, 160, 180)], OPENINGS)
    rooms = spark.createDataFrame([("p", "r1", box(0, 0, 9, 9)), ("p", "r2", [(0.0, 0.0), (5.0, 5.0), (5.0, 0.0), (0.0, 5.0)]), ("p", "r3", box(0, 0, 0.5, 0.5)), ("q", "r4", [(0.0, 0.0), (float("nan"), 1.0), (1.0, 1.0)]), ("q", "r5", None)], f"plan_id string, id string, polygon array<{PT}>")
    fixtures = spark.createDataFrame([("p", "f1", None), ("p", "f2", box(0, 0, 2, 2)), ("p", "f3", box(0, 0, 0.1, 0.1))], f"plan_id string, id string, polygon array<{PT}>")
    outlines = spark.createDataFrame([("p", box(0, 0, 0.2, 0.2)), ("q", [])], f"plan_id string, polygon array<{PT}>")
    got = sanitize.sanitized(walls, doors, windows, rooms, fixtures, outlines)
    assert {(r.plan_id, r.id) for r in got.walls.collect()} == {("p", "w"), ("p", "back"), ("q", "w")} and got.walls.columns == walls.columns
    assert {(r.plan_id, r.id, r.span_from, r.span_to, r.confidence, r.extra) for r in got.doors.collect()} == {("p", "d1", 20.0, 70.0, 0.9, "x"), ("p", "d6", 205.0, 210.0, 0.9, "x"), ("p", "d7", 20.0, 90.0, None, "x"), ("q", "d1", 5.0, 95.0, 0.5, "x")}
    assert {(r.id, r.span_from, r.span_to) for r in got.windows.collect()} == {("v1", 120.0, 150.0), ("v3", 160.0, 180.0)}
    assert {r.id for r in got.rooms.collect()} == {"r1"} and {r.id for r in got.fixtures.collect()} == {"f1", "f2"} and all(r.polygon == [] for r in got.outlines.collect())
    assert {(r.plan_id, r.repair, r.element_id, r.other_id) for r in got.notes.collect()} == {
        ("p", "wall-without-geometry", "flat", None), ("p", "wall-without-geometry", "bare", None), ("p", "wall-gone", "d4", "flat"), ("p", "wall-gone", "d8", "none"), ("p", "outside-wall", "d5", "w"), ("p", "merged", "d1", "d2"),
        ("p", "weaker-dropped", "d1", "v2"), ("p", "weaker-dropped", "v1", "d3"), ("p", "room-dropped", "r2", None), ("p", "room-dropped", "r3", None), ("q", "room-dropped", "r4", None), ("q", "room-dropped", "r5", None), ("p", "outline-dropped", None, None),
    }


def test_geometry_of_walls_is_computed_once(spark):
    point = "struct<x:double,z:double>"
    rows = [("r", (0.0, 0.0, 60.0, 10.0), None), ("flat", (0.0, 0.0, 60.0, 0.0), None), ("s", None, ((0.0, 9.0), (0.0, 1.0), 2.0)), ("none", None, None)]
    d = wall_geometry(spark.createDataFrame(rows, f"id string, rect struct<x0:double,y0:double,x1:double,y1:double>, segment struct<a:{point},b:{point},thickness:double>"))
    got = {r.id: (r.a and tuple(r.a), r.b and tuple(r.b), r.thickness_px, r.length_px, r.dominant, r.dir and tuple(r.dir)) for r in d.collect()}
    assert got == {"r": ((0.0, 5.0), (60.0, 5.0), 10.0, 60.0, "x", (1.0, 0.0)), "s": ((0.0, 1.0), (0.0, 9.0), 2.0, 8.0, "y", (0.0, 1.0)), "flat": (None,) * 6, "none": (None,) * 6}
    assert d._jdf.queryExecution().optimizedPlan().toString().lower().count("hypot(") == 1


def test_openings_that_stand_apart_are_kept_as_those_of_the_fold(spark):
    door = lambda a, b, i: (a, 0, i, b, f"d{i}", "door", "hinged", None)
    rows = [("apart", [door(0.0, 5.0, 0), door(4.6, 9.0, 1), door(9.0, 12.0, 2)]), ("over", [door(0.0, 5.0, 0), door(4.0, 9.0, 1), door(9.0, 12.0, 2)]), ("one", [door(1.0, 2.0, 0)])]
    got = {r.w: r.s for r in spark.createDataFrame(rows, f"w string, o array<{sanitize.OPENING}>").select("w", sanitize._settled(F.col("o")).alias("s")).collect()}
    assert {k: ([(o["from"], o["to"], o["id"]) for o in s.kept], [n.repair for n in s.notes]) for k, s in got.items()} == {
        "apart": ([(0.0, 5.0, "d0"), (4.6, 9.0, "d1"), (9.0, 12.0, "d2")], []), "over": ([(0.0, 9.0, "d0"), (9.0, 12.0, "d2")], ["merged"]), "one": ([(1.0, 2.0, "d0")], []),
    }
