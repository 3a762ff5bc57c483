"""Placement, formatting and annotation checks."""

import json

from pyspark.sql import functions as F

from planwright.functions import formatting
from planwright.functions import geometry as G
from planwright.operators import placement, zones
from planwright.sources import annotations

PT = "struct<x:double,z:double>"


def box(x0, z0, x1, z1):
    return [(x0, z0), (x1, z0), (x1, z1), (x0, z1)]


def test_overlap_containment_and_protrusion(spark):
    d = spark.createDataFrame([([*map(lambda p: tuple(map(float, p)), box(0, 0, 2, 2))], [*map(lambda p: tuple(map(float, p)), box(*b))]) for b in ((1, 1.5, 3, 3), (2, 0, 3, 1), (5, 0, 6, 1), (0.5, 0.5, 1, 1))], f"a array<{PT}>, b array<{PT}>")
    a, b = F.col("a"), F.col("b")
    got = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in d.select(G.overlap_depth(a, b), G.convex_distance(a, b), G.contains_polygon(a, b), G.protrusion(b, a)).collect()]
    assert got == [(0.5, 0.0, False, 1.414214), (0.0, 0.0, False, 1.0), (-3.0, 3.0, False, 4.0), (0.5, 0.0, True, 0.0)]


def test_formatting(spark):
    r = spark.range(1).select(formatting.length(F.lit(2.345), F.lit("user")), formatting.measured(F.lit(2.25), F.lit("assumed")), formatting.area(F.lit(57.44)), formatting.confidence(F.lit(None).cast("double")), formatting.confidence(F.lit(0.875))).first()
    assert list(r) == ["2.35 m", "≈ 2.3 m (assumed)", "≈ 57.4 m²", "not assessed", "88 %"]


ITEM = f"floor_id long, item_id string, room_id string, position {PT}, rotation double, width double, depth double, height double, elevation double, collides boolean, front_clearance double"


def item(name, x, z, w=0.6, d=0.6, room="r", h=0.8, collides=True, front=0.0):
    return (1, name, room, (x, z), 0.0, w, d, h, 0.0, collides, front)


def test_placement_issues(spark):
    rooms = spark.createDataFrame([(1, "r", 0, box(0.0, 0.0, 4.0, 3.0)), (1, "s", 1, box(4.2, 0.0, 8.0, 3.0))], f"floor_id long, room_id string, ord int, polygon array<{PT}>")
    walls = spark.createDataFrame([(1, "w", (4.1, 0.0), (4.1, 3.0), 0.2)], f"floor_id long, wall_id string, start {PT}, end {PT}, thickness double")
    corner = [(0.0, 3.0), (0.0, 2.0), (0.3, 2.0), (0.3, 2.7), (1.0, 2.7), (1.0, 3.0)]
    fixtures = spark.createDataFrame([(1, "f", corner)], f"floor_id long, id string, footprint array<{PT}>")
    doors = spark.createDataFrame([(1, "d", "w", 1.5, 0.8, "hinged", 1, "Entrance")], "floor_id long, id string, wall_id string, offset double, width double, kind string, swing_side int, note string")
    windows = doors.select("floor_id", F.lit("v").alias("id"), "wall_id", F.lit(0.5).alias("offset"), F.lit(0.6).alias("width"), F.lit(0.9).alias("sill_height"))
    zone = zones.functional_zones(walls, doors, windows)
    items = spark.createDataFrame([item("free", 1.5, 1.0), item("out", -0.2, 1.0), item("next", 1.7, 1.2), item("rug", 1.5, 1.0, collides=False), item("other", 6.0, 1.0), item("swing", 3.3, 1.5), item("high", 3.7, 0.5, h=1.8, w=0.4, d=0.4), item("low", 3.7, 0.5, h=0.7, w=0.4, d=0.4), item("hollow", 0.7, 2.3, w=0.2, d=0.2), item("sofa", 2.5, 2.5, w=0.8, d=0.6, front=0.6)], ITEM)
    got = {}
    for r in placement.placement_issues(items.where("item_id NOT IN ('high', 'low')"), rooms, walls, fixtures, items.where("item_id IN ('free', 'next')"), zone).collect():
        got.setdefault(r.item_id, {})[r.code] = (r.severity, r.other_id, r.amount)
    assert got["out"]["outside-room"] == ("hard", "r", 0.5) and got["free"] == {"furniture-collision": ("hard", "next", 0.4)}
    assert got["next"] == {"furniture-collision": ("hard", "free", 0.4)} and "rug" not in got and "other" not in got and "hollow" not in got
    assert set(got["swing"]) == {"door-swing"} and got["sofa"]["front-clearance"][0] == "soft"
    tall = placement.placement_issues(items.where("item_id IN ('high', 'low')"), rooms, walls, fixtures, items.limit(0), zone)
    assert {(r.item_id, r.code) for r in tall.collect()} == {("high", "window-blocked")}
    report = {r.item_id: (r.hard, r.blocked) for r in placement.reports(items, placement.placement_issues(items, rooms, walls, fixtures, items.limit(0), zone, ("front-clearance",))).collect()}
    assert report["out"] == (True, True) and report["free"] == (False, False) and report["sofa"] == (True, False)


def test_convex_parts_and_areas(spark):
    ring = [(0.0, 0.0), (3.0, 0.0), (3.0, 1.0), (1.0, 1.0), (1.0, 2.0), (0.0, 2.0)]
    d = spark.createDataFrame([(ring, box(0.5, 0.5, 1.5, 1.5)), (ring, box(1.5, 1.5, 1.8, 1.8)), (ring[::-1], box(0.0, 0.0, 1.0, 1.0))], f"a array<{PT}>, b array<{PT}>")
    d = d.select("a", "b", G.convex_parts("a").alias("p"), G.convex_parts("b").alias("q"))
    got = d.select("p", G.parts_overlap_depth(F.col("p"), F.col("q")).alias("depth"), G.approximate_overlap(F.col("a"), F.col("b")).alias("area")).collect()
    assert all(len(r.p) == 4 for r in got) and got[0].depth > 0 >= got[1].depth
    assert abs(got[0].area - 0.75) < 0.06 and got[1].area == 0 and abs(got[2].area - 1) < 0.06


def test_fit(spark):
    rooms = spark.createDataFrame([(1, "r", box(0.0, 0.0, 4.0, 3.0))], f"floor_id long, room_id string, polygon array<{PT}>")
    blocks = spark.createDataFrame([(1, box(0.0, 0.0, 0.3, 0.3))], f"floor_id long, polygon array<{PT}>")
    requests = spark.createDataFrame([(1, "sofa", "r", 2.0, 0.9), (1, "wide", "r", 9.0, 0.9)], "floor_id long, request_id string, room_id string, width double, depth double")
    fit = {r.request_id: r for r in placement.fitted(requests, rooms, blocks).collect()}
    assert fit["sofa"].ok and abs(fit["sofa"].position.x - 2.0) < 1e-9 and abs(fit["sofa"].position.z - 0.45) < 1e-9 and not fit["wide"].ok


def test_annotation_checks(spark):
    good = {k: [] for k in annotations.LISTS} | {"formatVersion": 1, "id": "p", "name": "a", "level": 0, "source": {"method": "manual"}, "image": {}, "originPx": {"x": 0, "y": 0}, "footprint": [], "defaults": {}}
    good["walls"] = [{"id": "w", "kind": "interior", "confidence": 0.5, "rect": {"x0": 0, "y0": 0, "x1": 9, "y1": 1}}, {"id": "v", "kind": "railing", "segment": {}}]
    good["doors"] = [{"id": "d", "wallId": "w", "span": [1, 4], "kind": "hinged", "hinge": "min", "swing": "up"}]
    good["rooms"] = [{"id": "r", "name": "Hall", "type": "hall", "labelSource": "inferred", "polygon": [{"x": 0, "y": 0}, {"x": 1, "y": 0}, {"x": 1, "y": 1}]}]
    bad = {k: v for k, v in good.items() if k != "formatVersion"} | {"extra": 1}
    bad["walls"] = [{"id": "w", "kind": "glass", "confidence": 2, "colour": "red"}]
    bad["doors"] = [{"id": "", "wallId": "w", "span": [1], "kind": "hinged", "hinge": "min", "swing": "in", "heightMeters": 9}]
    bad["rooms"] = [good["rooms"][0] | {"polygon": [{"x": 0, "y": 0}]}]
    files = [(1, json.dumps(good)), (2, json.dumps(bad)), (3, "nonsense"), (4, json.dumps(good | {"windows": 5}))]
    got = {r.id: r for r in annotations.checked(spark.createDataFrame(files, "id long, json string"), "id", "json").collect()}
    assert got[1].ok and got[3].errors == ["not a JSON object"] and got[4].errors == ["windows: expected an array"]
    assert sorted(got[2].errors) == sorted(["unexpected field extra", "missing field formatVersion", "walls[0]: unexpected field colour", "walls[0]: kind", "walls[0]: confidence", "walls[0]: rect or segment", "doors[0]: id", "doors[0]: span", "doors[0]: swing", "doors[0]: heightMeters", "rooms[0]: polygon"])


def test_svg(spark):
    d = spark.createDataFrame([(1, 2, box(0.0, 0.0, 1.0, 1.0), "red"), (1, 1, box(0.0, 0.0, 2.0, 2.0), "white")], f"plan_id long, ord int, polygon array<{PT}>, fill string")
    text = annotations.svg(d, 10, 10).first().svg
    assert text.index("white") < text.index("red") and text.count("<polygon") == 2


def test_pairs_of_polygons_are_held_against_each_other_in_batches(spark):
    """Rings of unlike sizes, degenerate and null ones in one batch, and enough pairs for several slices."""
    angle = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (1.2, 4.0), (1.2, 2.0), (0.0, 2.0)]
    square, thin = [(1.5, 0.5), (2.5, 0.5), (2.5, 1.5), (1.5, 1.5)], [(1.0, 1.0), (1.0, 1.0), (2.0, 2.0)]
    pairs = [(angle, square), (angle, [(0.2, 1.0), (0.8, 1.0), (0.5, 3.0)]), (angle, thin), (angle, None), (None, square), (square, angle)]
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], f"i int, a array<{PT}>, b array<{PT}>").crossJoin(spark.range(3000)).coalesce(1)
    got = d.select("i", G.contains_polygon(F.col("a"), F.col("b")).alias("held"), F.round(G.protrusion(F.col("b"), F.col("a")), 2).alias("out"), F.round(G.parts_overlap_depth(F.array("a"), F.array("b")), 2).alias("depth")).distinct().collect()
    assert sorted((r.i, r.held, r.out) for r in got if r.i != 5) == [(0, True, 0.0), (1, False, 0.74), (2, True, 0.0), (3, None, 0.0), (4, None, 0.0)]
    assert {r.i: r.depth for r in got}[0] == 1.0 and {r.i: r.depth for r in got}[3] is None
    plan = d.select(G.contains_polygon(F.col("a"), F.col("b")))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "exists(" not in plan
