"""Fitting furniture: one run over many floors, then each outcome by itself."""

import math
import random

import pytest
from pyspark.sql import functions as F

from planwright.operators import fitting, placement, zones
from planwright.sources.furniture import catalog

PT = "struct<x:double,z:double>"
REQUESTS = "floor_id string, request_id string, ord int, room_id string, catalog_id string, width double, depth double, height double, prefer_wall string"
FURNITURE = f"floor_id string, item_id string, room_id string, category string, ord long, position {PT}, rotation double, width double, depth double, height double, elevation double, collides boolean, front_clearance double"


def box(x0, z0, x1, z1):
    return [(float(x0), float(z0)), (float(x1), float(z0)), (float(x1), float(z1)), (float(x0), float(z1))]


ROOMS = {
    "wide": box(0, 0, 5, 4), "clockwise": box(0, 0, 5, 4)[::-1], "tiny": box(0, 0, 1, 1), "slot": box(0, 0, 3, 1.2), "full": box(0, 0, 2.6, 2.6), "talk": box(0, 0, 5, 4),
    "angle": [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (1.2, 4.0), (1.2, 2.0), (0.0, 2.0)], "door": box(0, 0, 3, 3),
}
ASKED = [
    ("wide", 0, "sofa-3", None, None), ("wide", 1, "sofa-3", None, None), ("wide", 2, "sofa-3", None, None), ("clockwise", 0, "sofa-3", None, None), ("tiny", 0, "bed-king", None, None), ("tiny", 1, "throne", None, None),
    ("slot", 0, "rug", 1.0, 2.5), ("full", 0, "bed-double", None, None), ("talk", 0, "coffee-table", None, None), ("talk", 1, "rug", None, None), ("angle", 0, "bed-double", None, None), ("door", 0, "plant", 0.4, 0.4),
]


@pytest.fixture(scope="module")
def outcome(spark):
    rooms = spark.createDataFrame([(f, "room", 0, p) for f, p in ROOMS.items()], f"floor_id string, room_id string, ord int, polygon array<{PT}>")
    rows = [(f, f"{f}{i}", i, "room", item, w, d, None, None) for f, i, item, w, d in ASKED] + [("wide", "lost", 9, "attic", "plant", None, None, None, None)]
    asked = spark.createDataFrame(rows, REQUESTS)
    walls = spark.createDataFrame([("door", "w", (0.0, -0.05), (3.0, -0.05), 0.1)], f"floor_id string, wall_id string, start {PT}, end {PT}, thickness double")
    doors = spark.createDataFrame([("door", "d", "w", 1.5, 2.9, "hinged", 1, None)], "floor_id string, id string, wall_id string, offset double, width double, kind string, swing_side int, note string")
    windows = doors.limit(0).withColumn("sill_height", F.lit(0.0))
    fixtures = spark.createDataFrame([("full", "bath", box(0.9, 0.9, 1.7, 1.7))], f"floor_id string, id string, footprint array<{PT}>")
    furniture = spark.createDataFrame([("talk", "s", "room", "sofa", 0, (2.5, 0.47), 0.0, 2.2, 0.9, 0.85, 0.0, True, 0.6)], FURNITURE)
    got, after = fitting.fitted(asked, catalog(spark), rooms, walls, fixtures, furniture, zones.functional_zones(walls, doors, windows))
    text = fitting.explained(got, F.lit("It"), F.col("floor_id"))
    return {r.request_id: r for r in text.collect()}, {(r.floor_id, r.item_id): r for r in after.collect()}


def test_failures(outcome):
    got = outcome[0]
    assert {k: (r.failure, r.tried > 0) for k, r in got.items() if not r.ok} == {"lost": ("unknown-room", False), "tiny0": ("too-large", False), "tiny1": ("unknown-item", False), "full0": ("no-valid-position", True), "door0": ("no-valid-position", True)}
    worst = got["full0"].closest.violations
    assert "fixture-collision" in {v.code for v in worst} and all(v.amount > 0 for v in worst if v.severity == "hard")
    assert got["full0"].explanation.startswith("Cannot place It in full.\nReason: no-valid-position\nChecked ") and "- fixed fittings by " in got["full0"].explanation
    assert {v.code for v in got["door0"].closest.violations} >= {"door-swing"}


def test_a_sofa_stands_against_the_longest_wall(outcome):
    for name in ("wide0", "clockwise0"):
        r = outcome[0][name]
        assert r.ok and r.issues == [] and r.tried == 1 and r.explanation.endswith("All hard rules and clearances are satisfied.")
    assert tuple(outcome[0]["wide0"].position) == pytest.approx((2.5, 0.47)) and outcome[0]["wide0"].rotation == pytest.approx(0)
    assert tuple(outcome[0]["clockwise0"].position) == pytest.approx((2.5, 3.53)) and abs(outcome[0]["clockwise0"].rotation) == pytest.approx(math.pi)


def test_what_was_placed_stands_in_the_way(outcome):
    got = outcome[0]
    assert tuple(got["wide1"].position) == pytest.approx((2.5, 3.53)) and got["wide1"].ok and got["wide1"].issues == []
    poses = [(*got[f"wide{i}"].position, got[f"wide{i}"].rotation) for i in range(3) if got[f"wide{i}"].ok]
    assert len(set(poses)) == len(poses) >= 2
    assert {k[1] for k in outcome[1] if k[0] == "wide"} == {f"wide{i}" for i in range(3) if got[f"wide{i}"].ok}


def test_turned_and_anchored_poses(outcome):
    got = outcome[0]
    assert got["slot0"].ok and abs(math.sin(got["slot0"].rotation)) == pytest.approx(1, abs=1e-9)
    table, rug = got["talk0"], got["talk1"]
    assert table.ok and table.rotation == 0 and math.dist(table.position, (2.5, 0.47 + 0.45 + 0.45 + 0.3)) < 0.08
    assert rug.ok and math.dist(rug.position, (2.5, 0.47 + 0.45 + 0.2 + 0.7)) < 0.08
    corners = [(got["angle0"].position.x + a * 1.45 / 2, got["angle0"].position.z + b * 2.05 / 2) for a in (-1, 1) for b in (-1, 1)] if abs(math.sin(got["angle0"].rotation)) < 0.5 else []
    assert got["angle0"].ok and all(x >= -0.01 and z >= -0.01 and not (x < 1.19 and z > 2.01) for x, z in corners)


def test_poses_are_judged_in_their_rows_and_never_stored(spark, monkeypatch):
    """Against every pose by ``placement_issues``; what is written or shuffled whole holds rows of requests alone."""
    stored = []

    def cut(df, kept=fitting.cut):
        stored.append(kept(df))
        return stored[-1]

    monkeypatch.setattr(fitting, "cut", cut)
    monkeypatch.setattr(fitting, "SHARE", 16)
    rooms = spark.createDataFrame([(f, r, i, p) for f in "ab" for i, (r, p) in enumerate({"left": box(0, 0, 3, 2.4), "right": box(3.1, 0, 6, 2.4)}.items())], f"floor_id string, room_id string, ord int, polygon array<{PT}>")
    walls = spark.createDataFrame([(f, w, p, q, 0.1) for f in "ab" for w, p, q in (("south", (0.0, -0.05), (6.0, -0.05)), ("mid", (3.05, 0.0), (3.05, 2.4)))], f"floor_id string, wall_id string, start {PT}, end {PT}, thickness double")
    doors = spark.createDataFrame([(f, "d", "south", 1.5, 0.8, "hinged", 1, None) for f in "ab"], "floor_id string, id string, wall_id string, offset double, width double, kind string, swing_side int, note string")
    windows = spark.createDataFrame([("b", "v", "mid", 1.2, 1.0, "0", 1, None, 0.3)], doors.schema.simpleString()[7:-1] + ",sill_height:double")
    fixtures = spark.createDataFrame([("a", "bath", box(0, 1.4, 0.6, 2.4))], f"floor_id string, id string, footprint array<{PT}>")
    furniture = spark.createDataFrame([("b", "s", "left", "sofa", 0, (2.2, 1.9), math.pi, 1.0, 0.6, 0.85, 0.0, True, 0.6)], FURNITURE)
    world = rooms, walls, fixtures, furniture, zones.functional_zones(walls, doors, windows)
    asked = spark.createDataFrame([("a", "desk", 0, "left", "desk", None, None, None, None), ("b", "plant", 0, "left", "plant", None, None, None, None)], REQUESTS)
    got = {r.request_id: r for r in fitting.fitted(asked, catalog(spark), *world)[0].collect()}
    assert len(stored) > 1 and all(d.count() <= asked.count() for d in stored)

    items = catalog(spark).where("catalog_id IN ('desk', 'plant')").select(F.when(F.col("catalog_id") == "desk", "a").otherwise("b").alias("floor_id"), F.col("catalog_id").alias("request_id"), F.lit("left").alias("room_id"), "size.*", "prefer_wall", "collides", "front_clearance")
    d = items.join(rooms.drop("ord"), ["floor_id", "room_id"]).withColumns({"shares": F.lit(1), "share": F.lit(0), "anchor": F.lit(None).cast(f"struct<point:{PT},rotation:double>"), "elevation": F.lit(0.0)})
    poses = fitting.wall_poses(d.where("floor_id = 'a'")).unionByName(fitting.free_poses(d.where("floor_id = 'b'"))).withColumn("item_id", F.to_json("order"))
    poses = poses.withColumn("within", fitting.G.contains_polygon(F.col("polygon"), placement.footprint(*map(F.col, ("position", "width", "depth", "rotation"))), placement.TOLERANCE))
    poses = spark.createDataFrame(poses.collect(), poses.schema)
    issues, codes = {}, set()
    for i in placement.placement_issues(poses.drop("polygon", "order", "within", "anchor"), *world).collect():
        issues.setdefault((i.floor_id, i.item_id), []).append((i.code, i.severity, i.other_id, i.amount))
        codes.add(i.code)
    assert codes >= {"door-swing", "front-clearance", "fixture-collision", "furniture-collision"}
    for name, floor in (("desk", "a"), ("plant", "b")):
        seen = [(p, sorted(issues.get((floor, p.item_id), []), key=lambda i: (i[0], i[2] or ""))) for p in poses.where(F.col("floor_id") == floor).collect()]
        hard = lambda i: any(x[1] == "hard" for x in i)
        best, found = min(((p, i) for p, i in seen if p.within and not hard(i)), key=lambda v: (100 * len(v[1]) + v[0].score, v[0].order))
        r = got[name]
        assert len(seen) > 2 * fitting.SHARE
        assert r.ok and r.position == best.position and r.rotation == best.rotation and [tuple(i) for i in r.issues] == found and r.tried == len(seen)


def test_judged_poses_have_the_issues_of_placed_items(spark):
    """Random poses over rooms side by side and over each other, with every kind of obstacle."""
    rng = random.Random(3)
    rooms = spark.createDataFrame([("a", r, i, p) for i, (r, p) in enumerate({"left": box(0, 0, 3, 3), "right": box(3.2, 0, 6, 3), "both": box(-1, -1, 5, 2.5), "angle": ROOMS["angle"]}.items())], f"floor_id string, room_id string, ord int, polygon array<{PT}>")
    walls = spark.createDataFrame([("a", "mid", (3.1, 0.0), (3.1, 3.0), 0.2)], f"floor_id string, wall_id string, start {PT}, end {PT}, thickness double")
    doors = spark.createDataFrame([("a", f"d{i}", "mid", 0.8 + i, 0.8, "hinged", 1 - 2 * i, None) for i in (0, 1)], "floor_id string, id string, wall_id string, offset double, width double, kind string, swing_side int, note string")
    fixtures = spark.createDataFrame([("a", "corner", [(0.0, 0.0), (1.0, 0.0), (1.0, 0.4), (0.4, 0.4), (0.4, 1.0), (0.0, 1.0)])], f"floor_id string, id string, footprint array<{PT}>")
    furniture = spark.createDataFrame([("a", "s", "right", "sofa", 0, (5.0, 2.2), 0.4, 1.0, 0.6, 0.85, 0.0, True, 0.6)], FURNITURE)
    world = rooms, walls, fixtures, furniture, zones.functional_zones(walls, doors, doors.limit(0).withColumn("sill_height", F.lit(0.0)))
    poses = [("a", str(i), rng.choice(["left", "right", "angle"]), (rng.uniform(0, 6), rng.uniform(0, 3)), rng.choice([0.0, 1.0, math.pi / 2]), rng.choice([0.3, 1.0]), 0.5, 0.8, 0.0, i % 5 > 0, rng.choice([0.0, 0.7])) for i in range(300)]
    d = spark.createDataFrame(poses, f"floor_id string, item_id string, room_id string, position {PT}, rotation double, width double, depth double, height double, elevation double, collides boolean, front_clearance double")
    expected = {}
    for r in placement.placement_issues(d, *world).collect():
        expected.setdefault(r.item_id, []).append((r.code, r.severity, r.other_id, r.amount))
    asked = placement.surrounded(d.join(rooms.drop("ord"), ["floor_id", "room_id"]), ("floor_id", "item_id"), *world)
    order = lambda found: sorted(found, key=str)
    got = {r.item_id: order(map(tuple, r.issues)) for r in placement.judged(asked).collect()}
    assert got == {str(i): order(expected.get(str(i), [])) for i in range(300)} and len({c for v in got.values() for c, *_ in v}) == 7
