"""Wall moves on floors drawn by hand: one run over all of them, then each outcome by itself."""

import math

import pytest
from pyspark.sql import functions as F

from planwright.operators import wall_moves
from planwright.operators.spatial import box_cells, segment_cells

WALLS = "floor_id string, wall_id string, ord int, kind string, start struct<x:double,z:double>, end struct<x:double,z:double>, thickness double"
ROOMS = "floor_id string, room_id string, ord int, polygon array<struct<x:double,z:double>>"
OPENINGS = "floor_id string, id string, wall_id string, offset double"
OUTLINES = "floor_id string, outline array<struct<x:double,z:double>>"
REQUESTS = "floor_id string, request_id string, wall_id string, distance double"


def plain():
    """8 x 6 m: a wall across from south to north, and one from it to the east."""
    walls = [("south", "exterior", (0, 0), (8, 0), 0.3), ("north", "exterior", (0, 6), (8, 6), 0.3), ("west", "exterior", (0, 0), (0, 6), 0.3), ("east", "exterior", (8, 0), (8, 6), 0.3)]
    walls += [("mid", "interior", (4, 0.15), (4, 5.85), 0.1), ("arm", "interior", (4.05, 3), (7.85, 3), 0.1)]
    box = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
    rooms = [("left", box(0.15, 0.15, 3.95, 5.85)), ("lower", box(4.05, 0.15, 7.85, 2.95)), ("upper", box(4.05, 3.05, 7.85, 5.85))]
    return walls, rooms, [("door", "mid", 1.0), ("hatch", "arm", 1.0)], box(-0.15, -0.15, 8.15, 6.15)


def floors():
    """(floor, walls, rooms, openings, outline, wall, distance)."""
    out = []

    def add(name, wall="mid", distance=0.5, walls=None, rooms=None, outline=None, more=(), openings=None):
        w, r, o, b = plain()
        w = [walls.get(x[0], x) for x in w] if walls else w
        r = [(n, rooms.get(n, p)) for n, p in r] if rooms else r
        out.append((name, [x for x in w if x] + list(more), r, o if openings is None else openings, outline or b, wall, distance))

    add("moves")
    add("back", distance=-0.5)
    add("none", wall="attic")
    add("zero", distance=0.0)
    add("nan", distance=math.nan)
    add("outer", wall="south")
    add("rail", walls={"mid": ("mid", "railing", (4, 0.15), (4, 5.85), 0.1)})
    add("outline", outline=[(4, 2)])
    add("short", walls={"mid": ("mid", "interior", (4, 0.15), (4, 5.75), 0.1)})
    add("goes on", walls={"mid": ("mid", "interior", (4, 0.15), (4, 4), 0.1)}, more=[("rest", "interior", (4, 4), (4, 5.85), 0.1)])
    add("covered", walls={"mid": ("mid", "interior", (4, 0.15), (4, 3), 0.1), "arm": ("arm", "interior", (0.15, 3.05), (7.85, 3.05), 0.1)}, more=[("rest", "interior", (4, 3.1), (4, 5.85), 0.1)], rooms={"left": [(0.15, 0.15), (3.95, 0.15), (3.95, 3), (0.15, 3)], "lower": [(4.05, 0.15), (7.85, 0.15), (7.85, 3), (4.05, 3)], "upper": [(0.15, 3.1), (3.95, 3.1), (3.95, 5.85), (0.15, 5.85)]})
    add("arm short", walls={"arm": ("arm", "interior", (4.15, 3), (7.85, 3), 0.1)})
    add("arm far", walls={"arm": ("arm", "interior", (4.4, 3), (7.85, 3), 0.1)})
    add("pinned", more=[("pin", "interior", (4.1, 2.5), (4.1, 3.5), 0.1)])
    add("stretch", walls={"arm": ("arm", "exterior", (4.05, 3), (7.85, 3), 0.1)})
    add("collapse", distance=-3.78)
    add("strip", rooms={"left": [(0.15, 0.15), (3.85, 0.15), (3.85, 5.85), (0.15, 5.85)]})
    add("slant", rooms={"left": [(0.15, 0.15), (3.95, 0.15), (4.01, 5.85), (0.15, 5.85)]})
    add("near", rooms={"left": [(0.15, 0.15), (3.93, 0.15), (3.93, 5.85), (0.15, 5.85)]})
    add("clear", rooms={"left": [(0.15, 0.15), (3.6, 0.15), (3.6, 5.85), (0.15, 5.85)]})
    add("past", walls={"mid": ("mid", "interior", (4, 0.15), (4, 5), 0.1)})
    add("shallow", rooms={"left": [(0.15, 0.15), (3.95, 0.15), (3.95, 3), (3.6, 5.85), (0.15, 5.85)]})
    add("corner", wall="top", distance=0.2, more=[("top", "interior", (5, 1), (7, 1), 0.1), ("front", "interior", (5, 1.05), (5, 2.95), 0.1)], rooms={"lower": [(6, 2), (6.2, 2), (6.2, 2.2)]}, openings=[("door", "front", 0.9)])
    return out


@pytest.fixture(scope="module")
def outcome(spark):
    p = lambda xz: (float(xz[0]), float(xz[1]))
    rows = floors()
    walls = spark.createDataFrame([(f, n, i, k, p(a), p(b), t) for f, ws, *_ in rows for i, (n, k, a, b, t) in enumerate(ws)], WALLS)
    rooms = spark.createDataFrame([(f, n, i, [p(x) for x in poly]) for f, _, rs, *_ in rows for i, (n, poly) in enumerate(rs)], ROOMS)
    openings = spark.createDataFrame([(f, n, w, at) for f, _, _, os_, *_ in rows for n, w, at in os_], OPENINGS)
    outlines = spark.createDataFrame([(f, [p(x) for x in b]) for f, _, _, _, b, *_ in rows], OUTLINES)
    requests = spark.createDataFrame([(f, "r", w, float(d)) for f, *_, w, d in rows], REQUESTS)
    got = wall_moves.moved(requests, walls, rooms, openings, outlines)
    return {
        "refused": {r.floor_id: r for r in got.refused.collect()},
        "walls": {(r.floor_id, r.wall_id): (*r.start, *r.end) for r in got.walls.collect()},
        "rooms": {(r.floor_id, r.room_id): [tuple(q) for q in r.polygon] for r in got.rooms.collect()},
        "openings": {(r.floor_id, r.id): r.offset for r in got.openings.collect()},
        "frames": (requests, walls, rooms, openings, outlines, got),
    }


@pytest.mark.parametrize(
    "floor,code,subject",
    [("none", "unknown-wall", "attic"), ("zero", "no-distance", "mid"), ("nan", "no-distance", "mid"), ("outer", "not-interior", "south"), ("rail", "not-interior", "mid"), ("outline", "outline", "mid"),
     ("short", "ambiguous-end", "north"), ("goes on", "straight-line", "rest"), ("arm short", "ambiguous-junction", "arm"), ("pinned", "torn-junction", "arm"), ("stretch", "stretches-outline", "arm"),
     ("collapse", "collapses", "arm"), ("strip", "ambiguous-boundary", "left"), ("slant", "ambiguous-boundary", "left"), ("past", "runs-past", "left"), ("shallow", "shallow-corner", "left")],
)
def test_refusals(outcome, floor, code, subject):
    got = outcome["refused"][floor]
    assert (got.code, got.subject, got.message) == (code, subject, wall_moves.REASONS[code])
    assert not [k for part in ("walls", "rooms", "openings") for k in outcome[part] if k[0] == floor]


def test_what_moves(outcome):
    assert {f for f, *_ in floors()} - set(outcome["refused"]) == {"moves", "back", "covered", "arm far", "near", "clear", "corner"}
    for floor, d in (("moves", 0.5), ("back", -0.5)):  # the normal of a wall to the north points west
        x = 4 - d
        assert outcome["walls"][floor, "mid"] == pytest.approx((x, 0.15, x, 5.85))
        assert outcome["walls"][floor, "arm"] == pytest.approx((x + 0.05, 3, 7.85, 3))
        assert outcome["rooms"][floor, "left"] == [pytest.approx(q) for q in [(0.15, 0.15), (x - 0.05, 0.15), (x - 0.05, 5.85), (0.15, 5.85)]]
        assert outcome["rooms"][floor, "upper"] == [pytest.approx(q) for q in [(x + 0.05, 3.05), (7.85, 3.05), (7.85, 5.85), (x + 0.05, 5.85)]]
        assert {k[1]: v for k, v in outcome["openings"].items() if k[0] == floor} == {"hatch": pytest.approx(1 + d)}
    assert {k[1] for k in outcome["walls"] if k[0] == "arm far"} == {"mid"}
    assert ("near", "left") in outcome["rooms"] and ("clear", "left") not in outcome["rooms"]
    assert {k[1] for k in outcome["walls"] if k[0] == "covered"} == {"mid"}


def test_a_corner_keeps_its_door(outcome):
    assert outcome["walls"]["corner", "top"] == pytest.approx((5, 1.2, 7, 1.2))
    assert outcome["walls"]["corner", "front"] == pytest.approx((5, 1.25, 5, 2.95))
    assert outcome["openings"]["corner", "door"] == pytest.approx(0.7)


def test_a_move_can_be_undone_by_its_opposite(spark, outcome):
    requests, walls, rooms, openings, outlines, got = outcome["frames"]
    accepted = requests.join(got.refused, ["floor_id", "request_id"], "left_anti").where("floor_id <> 'clear'")  # its wall now stands in a room
    keep = lambda df, changed, key: wall_moves.after(df, accepted, changed, key).drop("request_id", "by_user")
    w, r, o = keep(walls, got.walls, "wall_id"), keep(rooms, got.rooms, "room_id"), keep(openings, got.openings, "id")
    again = wall_moves.moved(accepted.withColumn("distance", -F.col("distance")), w, r, o, outlines)
    assert again.refused.count() == 0
    before = {(x.floor_id, x.wall_id): (*x.start, *x.end) for x in walls.collect()}
    back = {(x.floor_id, x.wall_id): (*x.start, *x.end) for x in again.walls.collect()}
    assert back and all(back[k] == pytest.approx(before[k]) for k in back)
    assert wall_moves.after(walls, accepted, got.walls, "wall_id").where("by_user").count() == len(back)


def test_cells_hold_all_that_is_near(spark):
    import random

    r = random.Random(4)
    rows = [tuple(r.uniform(-9, 9) for _ in range(4)) + (r.choice([0.0, 0.4, 2.5]), r.uniform(0, 1), r.uniform(0, 2 * math.pi)) for _ in range(300)] + [(1.0, 2.0, 1.0, 2.0, 0.5, 0.0, 1.0), (1.0, 2.0, 1.0, 8.0, 0.5, 0.5, 0.0)]
    d = spark.createDataFrame([((a, b), (c, e), k, (a + t * (c - a) + k * math.cos(w) * 0.999, b + t * (e - b) + k * math.sin(w) * 0.999)) for a, b, c, e, k, t, w in rows], "a struct<x:double,z:double>, b struct<x:double,z:double>, k double, p struct<x:double,z:double>")
    missed = d.where(F.size(F.array_intersect(segment_cells(F.col("a"), F.col("b"), F.col("k"), 1.5), box_cells(F.col("p"), F.lit(0.0), 1.5))) == 0)
    assert missed.count() == 0
    assert d.where(F.size(box_cells(F.col("p"), F.lit(0.0), 1.5)) != 1).count() == 0
