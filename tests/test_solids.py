"""Walls as boxes, and renovations as commands."""

import json
import math

import pytest
from pyspark.sql import functions as F

from planwright.operators import documents, renovation, solids

PT = "struct<x:double,z:double>"


def test_pieces(spark):
    walls = spark.createDataFrame([("f", "w", (1.0, 1.0), (1.0, 7.0), 0.2, 2.5), ("f", "bare", (0.0, 0.0), (3.0, 0.0), 0.1, 2.0), ("f", "point", (0.0, 0.0), (0.0, 0.0), 0.1, 2.0)], f"floor_id string, wall_id string, start {PT}, end {PT}, thickness double, height double")
    doors = spark.createDataFrame([("f", "d", 0, "w", 1.0, 1.0, 2.0), ("f", "gone", 1, "nowhere", 1.0, 1.0, 2.0), ("f", "beyond", 2, "w", 9.0, 1.0, 2.0)], "floor_id string, id string, ord int, wall_id string, offset double, width double, height double")
    windows = spark.createDataFrame([("f", "v", 0, "w", 3.0, 1.0, 1.6, 0.9), ("f", "over", 1, "w", 3.4, 1.0, 2.0, 1.0), ("f", "edge", 2, "w", 5.9, 1.0, 2.5, 0.0)], "floor_id string, id string, ord int, wall_id string, offset double, width double, height double, sill_height double")
    got = solids.pieces(walls, solids.opening_spans(doors, windows))
    rows = sorted((r.wall_id, round(r["from"], 6), round(r.to, 6), r.bottom, r.top, r.kind) for r in got.collect())
    assert rows == [
        ("bare", 0.0, 3.0, 0.0, 2.0, "solid"), ("w", 0.0, 0.5, 0.0, 2.5, "solid"), ("w", 0.5, 1.5, 2.0, 2.5, "lintel"), ("w", 1.5, 2.5, 0.0, 2.5, "solid"), ("w", 2.5, 3.5, 0.0, 0.9, "sill"), ("w", 3.5, 3.9, 0.0, 1.0, "sill"), ("w", 3.9, 5.4, 0.0, 2.5, "solid"),
    ]
    at = {(r.kind, round(r["from"], 3)): r for r in solids.placed(walls, got, 3.0).where("wall_id = 'w'").collect()}["lintel", 0.5]
    assert tuple(at.centre) == pytest.approx((1.0, 5.25, 2.0)) and tuple(at.size) == pytest.approx((1.0, 0.5, 0.2)) and at.rotation == pytest.approx(-math.pi / 2)
    assert {r.wall_id: round(r.volume, 6) for r in solids.volumes(walls, got).collect()} == {"w": round(0.2 * (0.5 * 2.5 + 0.5 + 2.5 + 0.9 + 0.4 + 1.5 * 2.5), 6), "bare": 0.6}


def test_renovation(spark):
    rooms = spark.createDataFrame([("p", "hall", "hall", ["d1"], []), ("p", "bath", "bathroom", ["d1", "d2"], ["v"]), ("p", "out", "balcony", ["d3"], [])], "plan_id string, room_id string, type string, door_ids array<string>, window_ids array<string>")
    asked = spark.createDataFrame([("p", 1, "industrial", ["hall", "bath", "out", "attic"]), ("p", 2, "baroque", ["hall"])], "plan_id string, ask_id int, preset string, room_ids array<string>")
    found = renovation.styled(asked, rooms)
    assert [(r.type, r.id) for r in found.orderBy("ord", "sub").collect()] == [("room/renovate", "hall"), ("door/update", "d1"), ("room/renovate", "bath"), ("door/update", "d1"), ("door/update", "d2"), ("window/update", "v")]
    two = spark.createDataFrame([("p", 7, 0, "hall", {"doorMaterialId": "wood-oak"}), ("p", 7, 1, "bath", {"doorMaterialId": "wood-white", "lighting": "cool"})], "plan_id string, ask_id int, ord int, room_id string, patch map<string,string>")
    left = {(r.id, r.field): r.value for r in renovation.finished(renovation.commands(two, rooms)).collect()}
    assert left["d1", "materialId"] == left["d2", "materialId"] == "wood-white" and left["bath", "lighting"] == "cool"
    plan = {"floors": [{"walls": [{"id": "w", "start": [0, 0], "end": [9, 0]}], "rooms": [{"id": "hall"}, {"id": "bath"}], "doors": [{"id": d, "wallId": "w", "offset": i * 2 + 1, "width": 1} for i, d in enumerate(("d1", "d2"))], "windows": [{"id": "v", "wallId": "w", "offset": 7, "width": 1}]}]}
    log = renovation.batch(found, renovation.style_name(F.lit("industrial"))).select(F.lit("p").alias("doc"), F.lit(1).alias("seq"), F.lit("dispatch").alias("action"), "command", F.lit(None).cast("string").alias("key"))
    start = spark.createDataFrame([("p", 0, "load", json.dumps(plan), None)], "doc string, seq int, action string, command string, key string")
    state = next(json.loads(r.state) for r in documents.folded(start.unionByName(log)).collect() if r.action == "state")
    floor = state["document"]["floors"][0]
    assert state["past"][0]["label"] == "Industrial style" and floor["rooms"][1]["renovation"]["floorMaterialId"] == "floor-concrete" and floor["doors"][0]["materialId"] == "wood-gray" and floor["windows"][0]["materialId"] == "aluminium-dark"
