"""Raster kernels, zones and floor validation on small plans."""

import numpy as np
from pyspark.sql import functions as F

from planwright.functions import raster
from planwright.operators import images, zones


def test_distance_transform_is_exact():
    r = np.random.default_rng(1)
    mask = r.random((14, 17)) < 0.8
    got = raster.distance_transform(mask)
    clear = np.argwhere(~mask)
    for y, x in np.argwhere(mask):
        assert abs(got[y, x] - np.sqrt(((clear - (y, x)) ** 2).sum(axis=1).min())) < 1e-9


def test_components_in_scan_order():
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 1, 1]], bool)
    labels, n = raster.connected_components(mask)
    assert n == 3 and labels.tolist() == [[1, 0, 0, 2], [0, 1, 0, 2], [0, 0, 0, 0], [3, 3, 3, 3]]
    assert raster.connected_components(mask, diagonal=False)[1] == 4
    assert raster.connected_components(np.zeros((3, 3), bool))[1] == 0


def test_thinning_and_holes():
    bar = np.zeros((9, 30), bool)
    bar[2:7, 2:28] = True
    line = raster.skeletonize(bar)
    assert 15 <= line.sum() <= 30 and raster.connected_components(line)[1] == 1
    bar[4, 10] = False
    assert raster.fill_small_holes(bar, 1)[4, 10] and not raster.fill_small_holes(bar, 1)[0, 0]


def test_gray_contrast_threshold():
    rgba = np.array([[[0, 0, 0, 255], [255, 255, 255, 255], [0, 0, 0, 0]]], np.uint8)
    assert raster.to_gray(rgba).tolist() == [[0, 255, 255]]
    gray = np.array([[40] * 50 + [200] * 50], np.uint8)
    assert 40 < raster.otsu(raster.histogram(gray)) <= 200
    assert raster.stretch(gray).min() == 0 and raster.stretch(gray).max() == 255
    assert raster.noise(3, 1, 1).tolist() == raster.noise(3, 1, 1).tolist()


def test_simplify_keeps_corners():
    points = np.array([(0, 0), (1, 0.01), (2, 0), (2, 1), (2, 2)], float)
    assert raster.simplify(points, 0.1).tolist() == [0, 2, 4]


def floor(spark):
    pt = "struct<x:double,z:double>"
    walls = spark.createDataFrame([(1, "w1", (0.0, 0.0), (4.0, 0.0), 0.2), (1, "w2", (0.0, 0.0), (0.0, 0.0), float("nan"))], f"floor_id long, wall_id string, start {pt}, end {pt}, thickness double")
    doors = spark.createDataFrame([(1, "d1", "w1", 1.0, 0.8, "hinged", 1), (1, "d2", "w1", 1.5, 0.8, "sliding", 1), (1, "d3", "gone", 1.0, 0.8, "hinged", -1), (1, "d4", "w1", 3.9, 0.8, "double", -1)], "floor_id long, id string, wall_id string, offset double, width double, kind string, swing_side int")
    rooms = spark.createDataFrame([(1, "r1", 0, [(0.0, 0.1), (4.0, 0.1), (4.0, 3.0), (0.0, 3.0)], 2.5), (1, "r2", 1, [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)], None)], f"floor_id long, room_id string, ord int, polygon array<{pt}>, ceiling_height double")
    return rooms, walls, doors


def test_zones_and_topology(spark):
    rooms, walls, doors = floor(spark)
    doors = doors.withColumn("note", F.lit(None).cast("string")).withColumn("ord", F.lit(0))
    windows = doors.where("id = 'd2'").select("floor_id", "id", "ord", "wall_id", "offset", "width", F.lit(0.9).alias("sill_height"))
    got = zones.functional_zones(walls, doors, windows).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in got} == {"door-swing": 2, "door-access": 6, "window-access": 2}
    beside = {(r.wall_id, r.side): r.room_id for r in zones.rooms_beside_walls(walls, rooms.where("room_id = 'r1'")).collect()}
    assert beside["w1", 1] == "r1" and beside["w1", -1] is None
    linked, filled = zones.topology(rooms.where("room_id = 'r1'"), walls.where("wall_id = 'w1'").withColumn("ord", F.lit(0)), doors, windows)
    assert {r.id: r.positive for r in linked.collect()} == {"d1": "r1", "d2": "r1", "d3": None, "d4": "r1"}
    r = filled.first()
    assert r.wall_ids == ["w1"] and sorted(r.door_ids) == ["d1", "d2", "d4"] and r.window_ids == ["d2"]


def test_images(spark):
    square = [[(5.0, 5.0), (45.0, 5.0), (45.0, 9.0), (5.0, 9.0)], [(5.0, 20.0), (45.0, 20.0), (45.0, 24.0), (5.0, 24.0)]]
    walls = spark.createDataFrame([(7, p) for p in square], "plan_id long, polygon array<struct<x:double,z:double>>")
    r = images.measured(images.drawn(walls, 50, 30)).first()
    assert r.plan_id == 7 and r.components == 2 and abs(r.ink - 320 / 1500) < 1e-9 and 3 <= r.thickness <= 5
    assert images.drawn(walls.where(F.lit(False)), 5, 5).count() == 0
