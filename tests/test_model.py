"""From annotated plans to validated models: a plan of two rooms, and ways to break it."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from planwright.operators import annotated, evaluation, review, validation, zones

PT = "struct<x:double,z:double>"
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
SEGMENT = f"struct<a:{PT},b:{PT},thickness:double>"


def box(x0, y0, x1, y1):
    return [(float(x0), float(y0)), (float(x1), float(y0)), (float(x1), float(y1)), (float(x0), float(y1))]


@pytest.fixture(scope="module")
def plan(spark):
    """Two rooms of 4 by 3 metres at 50 pixels a metre, a door between them and one to the outside, one window."""
    made = {}
    made["plans"] = spark.createDataFrame([("p", 1, "manual", (0.0, 0.0), 500.0, 250.0, box(0, 0, 430, 170), box(10, 10, 420, 160), None, None, 24.6, 2.5, 2.0, 1.1, 0.9, 2.1)], f"plan_id string, format_version int, method string, origin {PT}, width_px double, height_px double, footprint array<{PT}>, envelope array<{PT}>, manual_ppm double, estimated_ppm double, reported_m2 double, ceiling_m double, door_m double, railing_m double, sill_m double, head_m double")
    rects = {"n": (0, 0, 430, 10), "s": (0, 160, 430, 170), "w": (0, 10, 10, 160), "e": (420, 10, 430, 160), "m": (210, 10, 220, 160)}
    made["walls"] = spark.createDataFrame([("p", i, k, "interior" if k == "m" else "exterior", tuple(map(float, v)), None, 0.9) for i, (k, v) in enumerate(rects.items())], f"plan_id string, ord int, id string, kind string, rect {BOX}, segment {SEGMENT}, confidence double")
    made["doors"] = spark.createDataFrame([("p", 0, "d1", "m", 60.0, 100.0, "hinged", "min", "left", None, False, None, 0.9, None), ("p", 1, "d2", "s", 120.0, 80.0, "hinged", "max", "up", 2.05, True, "Entrance", 0.5, 0.4)], "plan_id string, ord int, id string, wall_id string, span_from double, span_to double, kind string, hinge string, swing string, height_m double, height_from_plan boolean, label string, confidence double, swing_confidence double")
    made["windows"] = spark.createDataFrame([("p", 0, "v1", "n", 300.0, 350.0, "standard", None, None, False, 0.9)], "plan_id string, ord int, id string, wall_id string, span_from double, span_to double, kind string, sill_m double, head_m double, heights_from_plan boolean, confidence double")
    made["rooms"] = spark.createDataFrame([("p", 0, "r1", "Bedroom", "bedroom", "plan-label", "l1", box(10, 10, 210, 160), None, 0.9, None, 0.9, None), ("p", 1, "r2", "x", "bedroom", "unknown", None, box(220, 10, 420, 160), None, 0.9, 0.5, None, None)], f"plan_id string, ord int, id string, name string, type string, label_source string, label_id string, polygon array<{PT}>, exterior boolean, confidence double, geometry_confidence double, label_confidence double, classification_confidence double")
    made["fixtures"] = spark.createDataFrame([("p", 0, "f1", "bath", "Bath", (20.0, 20.0, 60.0, 100.0), None, 0.6, None, "ceramic", False, None)], f"plan_id string, ord int, id string, kind string, label string, rect {BOX}, polygon array<{PT}>, height_m double, elevation_m double, material_id string, uncertain boolean, confidence double")
    made["labels"] = spark.createDataFrame([("p", 0, "l1", "BEDROOM", 0.9)], "plan_id string, ord int, id string, text string, confidence double")
    made["dimensions"] = spark.createDataFrame([("p", "m1", "r1", 4.0, "x", 10.0, 210.0, None, None), ("p", "m2", "r1", 3.0, None, None, None, (10.0, 10.0), (10.0, 160.0))], f"plan_id string, id string, room_id string, meters double, axis string, span_from double, span_to double, a {PT}, b {PT}")
    return made


def merged(spark, tables, key, variants):
    """All variants of the relations in one set, told apart by the key, so that one job checks them all."""
    base = {name: d.collect() for name, d in tables.items()}
    out = {}
    for name, d in tables.items():
        rows = []
        for variant, changed in variants.items():
            found = changed[name].select(d.columns).collect() if name in changed else base[name]
            rows += [tuple(variant if c == key else v for c, v in zip(d.columns, r)) for r in found]
        out[name] = spark.createDataFrame(rows, StructType([StructField(f.name, f.dataType) for f in d.schema])).cache()
    return out


def test_annotations(spark, plan):
    walls = plan["walls"].withColumn("rect", F.when(F.col("id") == "e", F.struct(*[F.lit(1.0).alias(k) for k in ("x0", "y0", "x1", "y1")])).otherwise(F.col("rect")))
    doors = plan["doors"].withColumn("wall_id", F.when(F.col("id") == "d2", "gone").otherwise("m")).withColumn("swing", F.lit("up"))
    windows = plan["windows"].withColumns({"wall_id": F.lit("s"), "span_from": F.lit(100.0), "span_to": F.lit(600.0), "head_m": F.lit(0.5)})
    rooms = plan["rooms"].withColumn("label_id", F.lit("zz")).withColumn("polygon", F.when(F.col("id") == "r1", F.slice("polygon", 1, 2)).otherwise(F.transform("polygon", lambda q: F.struct((q["x"] + 200).alias("x"), q["z"].alias("z")))))
    plans = plan["plans"].withColumns({"estimated_ppm": F.lit(40.0), "format_version": F.lit(9), "ceiling_m": F.lit(0.0)})
    none, labels = plan["dimensions"].limit(0), plan["labels"].withColumn("id", F.lit("d1"))
    variants = {
        "sound": {}, "walls": {"walls": walls}, "doors": {"doors": doors}, "windows": {"windows": windows}, "rooms": {"rooms": rooms}, "labels": {"labels": labels},
        "bare": {"dimensions": none}, "guessed": {"plans": plans, "dimensions": none}, "single": {"dimensions": plan["dimensions"].where("id = 'm1'")},
    }
    d = merged(spark, plan, "plan_id", variants)
    got = {v: set() for v in variants}
    for r in annotated.annotation_issues(*[d[k] for k in ("plans", "walls", "doors", "windows", "rooms", "fixtures", "labels", "dimensions")]).collect():
        got[r.plan_id].add((r.code, r.element_id))
    assert got == {
        "sound": set(), "walls": {("wall-geometry", "e")}, "doors": {("opening-wall", "d2"), ("door-swing", "d1")}, "windows": {("opening-outside-wall", "v1"), ("opening-overlap", "v1"), ("window-heights", "v1")},
        "rooms": {("room-polygon", "r1"), ("room-outside-image", "r2"), ("room-label-ref", "r1"), ("room-label-ref", "r2")}, "labels": {("duplicate-id", "d1"), ("room-label-ref", "r1")},
        "bare": {("no-scale", None)}, "guessed": {("estimated-scale", None), ("format-version", None), ("default-height", None)}, "single": {("single-scale-reference", None)},
    }


@pytest.fixture(scope="module")
def model(spark, plan):
    scales = spark.createDataFrame([("p", 50.0, "dimension-labels")], "plan_id string, ppm double, method string")
    made = annotated.reconstructed(plan["plans"], scales, plan["walls"], plan["doors"], plan["windows"], plan["rooms"], plan["fixtures"])
    return {k: v.cache() for k, v in made.items()}, scales


def test_reconstruction(plan, model):
    made, scales = model
    w = {r.wall_id: r for r in made["walls"].collect()}
    assert (w["m"].start.x, w["m"].start.z, w["m"].end.z, w["m"].thickness) == (4.3, 0.2, 3.2, 0.2) and w["m"].material_id == "paint-white"
    d = {r.id: r for r in made["doors"].collect()}
    assert d["d1"].offset == pytest.approx(1.4) and d["d1"].width == pytest.approx(0.8) and (d["d1"].negative, d["d1"].positive) == ("r2", "r1")
    assert d["d1"].swing_side == 1 and d["d2"].height == 2.05 and d["d2"].sources["height"] == "plan-label" and {d["d2"].negative, d["d2"].positive} == {"r1", None}
    v = made["windows"].first()
    assert v.height == pytest.approx(1.2) and v.sill_height == 0.9
    r = {x.room_id: x for x in made["rooms"].collect()}
    assert r["r1"].wall_ids == ["n", "s", "w", "m"] and r["r1"].door_ids == ["d1", "d2"] and r["r2"].window_ids == ["v1"] and (r["r2"].name, r["r2"].type) == ("Unknown Room", "unknown")
    assert made["fixtures"].first().room_id == "r1"
    notes = {(x.code, x.element_id, x.severity) for x in annotated.reconstruction_notes(plan["plans"], scales, made).collect()}
    assert notes == {("scale-calibrated", None, "info"), ("room-label-inferred", "r2", "info"), ("area-cross-check", None, "info")}
    m = {x.room_id: x for x in zones.room_metrics(made["rooms"]).collect()}
    assert m["r1"].area == pytest.approx(12) and m["r1"].width == pytest.approx(4) and m["r1"].perimeter == pytest.approx(14)


def relations(spark, model):
    made, _ = model
    out = {k: made[k].withColumn("apartment_id", F.lit("a")) for k in made}
    out["rooms"] = out["rooms"].withColumnRenamed("room_id", "id").withColumn("material_ids", F.array(F.lit("oak")))
    out["walls"] = out["walls"].withColumnRenamed("wall_id", "id")
    out["apartments"] = spark.createDataFrame([("a", 2)], "apartment_id string, schema_version int")
    out["floors"] = spark.createDataFrame([("a", "p", 0, 2.5)], "apartment_id string, floor_id string, ord int, height double")
    out["furniture"] = spark.createDataFrame([("a", "p", 0, "bed1", "bed", "r1", (3.0, 2.0), 0.0, 1.4, 2.0, 0.5)], f"apartment_id string, floor_id string, ord int, id string, catalog_id string, room_id string, position {PT}, rotation double, width double, depth double, height double")
    return out


def test_validation(spark, model):
    d = relations(spark, model)
    bad = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(z).alias("z")) for x, z in ((0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0), (0.0, 2.0))])
    rooms, walls, doors, f = d["rooms"], d["walls"], d["doors"], d["furniture"]
    moved = rooms.withColumn("polygon", F.when(F.col("id") == "r2", F.transform("polygon", lambda q: F.struct((q["x"] - 2).alias("x"), q["z"].alias("z")))).otherwise(F.col("polygon")))
    variants = {
        "sound": {}, "old": {"apartments": d["apartments"].withColumn("schema_version", F.lit(1)), "floors": d["floors"].withColumn("height", F.lit(0.0))}, "moved": {"rooms": moved},
        "crossed": {"rooms": rooms.where("id = 'r1'").withColumn("polygon", bad).withColumn("ceiling_height", F.lit(float("nan")))},
        "thin": {"walls": walls.withColumn("thickness", F.when(F.col("id") == "e", -1.0).otherwise(F.col("thickness"))).withColumn("end", F.when(F.col("id") == "n", F.col("start")).otherwise(F.col("end")))},
        "twice": {"walls": walls.unionByName(walls.where("id = 'm'").withColumn("id", F.lit("d1")).withColumn("ord", F.lit(9)))},
        "doors": {"doors": doors.withColumn("wall_id", F.when(F.col("id") == "d1", "gone").otherwise("n")).withColumn("offset", F.when(F.col("id") == "d2", 6.5).otherwise(F.col("offset"))).withColumn("height", F.lit(3.0)).withColumn("sources", F.lit(None).cast("map<string,string>"))},
        "flat": {"furniture": f.withColumn("width", F.lit(0.0))}, "turned": {"furniture": f.withColumn("rotation", F.lit(float("nan")))}, "lost": {"furniture": f.withColumn("room_id", F.lit("zz"))},
        "bath": {"fixtures": d["fixtures"].withColumn("room_id", F.lit(None).cast("string")).withColumn("height", F.lit(0.0))}, "sill": {"windows": d["windows"].withColumn("sill_height", F.lit(-0.1))},
    }
    m = merged(spark, d, "apartment_id", variants)
    names = ("apartments", "floors", "rooms", "walls", "doors", "windows", "fixtures", "furniture")
    got = {v: set() for v in variants}
    issues = validation.validated(*[m[k] for k in names]).cache()
    for r in issues.collect():
        got[r.apartment_id].add((r.code, r.entity))
    assert got == {
        "sound": set(), "old": {("schema-version", "old"), ("floor-height", "p")}, "moved": {("room-overlap", "r1")},
        "crossed": {("room-self-intersection", "r1"), ("room-area", "r1"), ("room-duplicate-vertex", "r1"), ("room-ceiling", "r1"), ("furniture-outside-room", "bed1"), ("fixture-outside-room", "f1")},
        "thin": {("wall-thickness", "e"), ("wall-zero-length", "n"), ("window-outside-wall", "v1")}, "twice": {("duplicate-id", "d1"), ("wall-overlap", "m")},
        "doors": {("door-missing-wall", "d1"), ("missing-provenance", "d1"), ("missing-provenance", "d2"), ("door-too-tall", "d2"), ("opening-overlap", "v1")},
        "flat": {("furniture-dimensions", "bed1")}, "turned": {("furniture-transform", "bed1")}, "lost": {("furniture-missing-room", "bed1")}, "bath": {("fixture-no-room", "f1"), ("fixture-height", "f1")}, "sill": {("window-sill", "v1")},
    }
    stock = spark.createDataFrame([("x", "x")], "catalog_id string, material_id string")
    assert {(r.code, r.entity) for r in validation.furniture_issues(f, rooms, stock).collect()} == {("furniture-catalog", "bed1")}
    assert {(r.code, r.entity) for r in validation.room_issues(rooms, stock).collect()} == {("unknown-material", "r1"), ("unknown-material", "r2")}
    assert {r.apartment_id for r in validation.verdicts(m["apartments"], issues).where("ok").collect()} == {"sound"}


def test_review(spark, plan):
    plans = plan["plans"].select("plan_id").withColumn("document_verdict", F.lit("LIKELY_FLOOR_PLAN"))
    none = spark.createDataFrame([], "plan_id string, severity string, code string, element_id string")
    scales = spark.createDataFrame([("p", "estimated", 1, "low")], "plan_id string, strategy string, samples_rejected int, confidence string")
    lost = spark.createDataFrame([("p", "HALL")], "plan_id string, text string")
    args = [plan[k] for k in ("walls", "rooms", "doors", "windows", "fixtures")]
    found = review.problems(plans, none, *args, scales, lost)
    assert {(r.code, r.element_id) for r in found.collect()} == {("uncertain-room-boundary", "r2"), ("unnamed-room", "r2"), ("possible-door", "d2"), ("scale-estimated", None), ("dimension-mismatch", None), ("label-outside-rooms", None)}
    assert review.statuses(plans, found).first().status == "needs-review"
    parts = {r.component: r for r in review.components(plans, found, *args[:4], scales).collect()}
    assert {k: r.status for k, r in parts.items()} == {"walls": "good", "rooms": "uncertain", "roomLabels": "uncertain", "doors": "uncertain", "windows": "good", "scale": "uncertain"}
    assert parts["rooms"].confidence == 0.7 and parts["scale"].confidence == 0.4
    broken = none.union(spark.createDataFrame([("p", "error", "room-area", "r2")], none.schema))
    worse = review.problems(plans, broken, *args, scales.limit(0), lost.limit(0))
    assert review.statuses(plans, worse).first().status == "failed" and ("uncertain-room-boundary", "r2") not in {(r.code, r.element_id) for r in worse.collect()}
    empty = review.problems(plans, none, *[x.limit(0) for x in args], scales.limit(0), lost.limit(0))
    assert {r.code for r in empty.collect()} == {"no-rooms", "no-fixtures"}


def test_evaluation(spark, plan, model):
    _, scales = model
    walls, doors, rooms = plan["walls"], plan["doors"], plan["rooms"]
    m = evaluation.wall_metrics(walls, walls).first()
    assert (m.expected, m.detected, m.kind_correct, m.false_positives, m.precision, m.recall) == (5, 5, 5, 0, 1.0, 1.0)
    moved = walls.where("id <> 'm'").unionByName(walls.where("id = 'm'").withColumn("rect", F.struct(F.lit(300.0).alias("x0"), F.lit(10.0).alias("y0"), F.lit(310.0).alias("x1"), F.lit(160.0).alias("y1"))))
    m = evaluation.wall_metrics(walls, moved).first()
    assert (m.detected, m.false_positives, m.precision, m.recall) == (4, 1, 0.8, 0.8)
    shifted = doors.withColumn("span_from", F.col("span_from") + 5).withColumn("span_to", F.col("span_to") + 5)
    got = evaluation.opening_matches(doors, walls, shifted, walls, scales)
    assert {(r.id, r.match_id, round(r.gap, 6), r.swing_correct) for r in got.collect()} == {("d1", "d1", 0.1, True), ("d2", "d2", 0.1, True)}
    o = evaluation.opening_metrics(doors, doors.limit(1), evaluation.opening_matches(doors, walls, doors.limit(1), walls, scales)).first()
    assert (o.expected, o.detected, o.extracted, o.false_positives, o.precision, o.recall) == (2, 1, 1, 0, 1.0, 0.5)
    r = evaluation.room_metrics(evaluation.room_matches(rooms, rooms)).first()
    assert (r.matched, r.types_right, r.labelled, r.labels_right) == (2, 2, 1, 1) and r.mean_iou > 0.99
    lone = evaluation.room_metrics(evaluation.room_matches(rooms, rooms.where("id = 'r2'").withColumn("type", F.lit("hall")))).first()
    assert (lone.matched, lone.detection_rate, lone.classification_accuracy, lone.label_accuracy) == (1, 0.5, 0.0, None)
    outcomes = spark.createDataFrame([("b", "real", "ok", 1.25, 3, 1.0, 0.5, None, None, None), ("a", "syn", "ok", 0.5, 3, 1.0, 1.0, 1.0, 1.0, 0.25)], "id string, category string, status string, seconds double, rooms int, wall_precision double, wall_recall double, room_rate double, door_precision double, door_recall double")
    assert evaluation.report_rows(outcomes, {"syn": 0, "real": 1}).orderBy("ord").first().line == "| a | syn | ok | 0.5 | 3 | 100 % / 100 % | 100 % | 100 % / 25 % |"
