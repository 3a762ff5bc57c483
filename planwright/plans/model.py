"""Registered queries of the model's rules: plans derived from whole tables, rules written out again in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planwright.functions import geometry as G
from planwright.operators import answers, gaps, intents, placement, renovation, review, sanitize, solids, spatial, structure, validation, zones
from planwright.plans.registry import query
from planwright.sources import projects, tables

R = G.rounded


def _p(x: Column | float, z: Column | float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return G.point(lit(x), lit(z))


def _box(x0, z0, x1, z1) -> Column:
    return F.array(_p(x0, z0), _p(x1, z0), _p(x1, z1), _p(x0, z1))


def _null(kind: str, name: str) -> Column:
    return F.lit(None).cast(kind).alias(name)


@query("""
WITH c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS apartment_id FROM customer),
f AS (SELECT * FROM c WHERE k % 13 <> 0),
d AS (SELECT f.apartment_id, o_orderkey AS o, 'd' || o_orderkey AS id, CAST(o_orderkey % 89 AS DOUBLE) / 10 AS pos, CASE WHEN o_orderkey % 53 = 0 THEN 0.0 ELSE 0.4 END AS w, o_orderkey % 37 = 0 AS bare FROM orders JOIN f ON o_custkey = k),
i AS (
  SELECT apartment_id, NULL AS floor_id, 'error' AS severity, 'schema-version' AS code, 'apartment' AS kind, apartment_id AS entity FROM c WHERE k % 11 = 0
  UNION ALL SELECT apartment_id, NULL, 'error', 'no-floors', 'apartment', apartment_id FROM c WHERE k % 13 = 0
  UNION ALL SELECT apartment_id, 'f', 'error', 'floor-height', 'floor', 'f' FROM f WHERE k % 7 = 0
  UNION ALL SELECT apartment_id, 'f', 'error', 'room-overlap', 'room', 'r1' FROM f WHERE k % 5 = 0
  UNION ALL SELECT apartment_id, 'f', 'error', 'room-area', 'room', 'r1' FROM f WHERE k % 17 = 0 AND k % 5 <> 0
  UNION ALL SELECT apartment_id, 'f', 'error', 'room-self-intersection', 'room', 'r1' FROM f WHERE k % 17 = 0 AND k % 5 <> 0
  UNION ALL SELECT apartment_id, 'f', 'error', 'room-ceiling', 'room', 'r2' FROM f WHERE k % 19 = 0
  UNION ALL SELECT apartment_id, 'f', 'error', 'wall-thickness', 'wall', 'w' FROM f WHERE k % 23 = 0
  UNION ALL SELECT apartment_id, 'f', 'error', 'fixture-height', 'fixture', 'bath' FROM f WHERE k % 29 = 0
  UNION ALL SELECT apartment_id, 'f', 'warning', 'fixture-no-room', 'fixture', 'bath' FROM f WHERE k % 31 = 0
  UNION ALL SELECT apartment_id, 'f', 'warning', 'fixture-outside-room', 'fixture', 'bath' FROM f WHERE k % 31 <> 0 AND k % 17 = 0 AND k % 5 <> 0
  UNION ALL SELECT apartment_id, 'f', 'error', 'duplicate-id', 'window', 'r1' FROM f WHERE k % 41 = 0
  UNION ALL SELECT apartment_id, 'f', 'error', 'window-sill', 'window', CASE WHEN k % 41 = 0 THEN 'r1' ELSE 'v' END FROM f WHERE k % 43 = 0
  UNION ALL SELECT apartment_id, 'f', 'error', 'door-width', 'door', id FROM d WHERE w = 0
  UNION ALL SELECT apartment_id, 'f', 'error', 'door-outside-wall', 'door', id FROM d WHERE pos - w / 2 < -0.001 OR pos + w / 2 > 8.001
  UNION ALL SELECT apartment_id, 'f', 'error', 'missing-provenance', 'door', id FROM d WHERE bare
  UNION ALL SELECT a.apartment_id, 'f', 'error', 'opening-overlap', 'door', a.id FROM d a JOIN d b ON a.apartment_id = b.apartment_id AND b.o < a.o AND least(a.pos + a.w / 2, b.pos + b.w / 2) - greatest(a.pos - a.w / 2, b.pos - b.w / 2) > 0.001)
SELECT * FROM i""")
def validated_apartments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An apartment per customer with a door per order; keys pick what is wrong with each."""
    k = F.col("k")
    c = tables.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("apartment_id"))
    apartments = c.select("apartment_id", F.when(k % 11 == 0, 1).otherwise(2).alias("schema_version"))
    f = c.where(k % 13 != 0).withColumn("floor_id", F.lit("f"))
    sources = F.create_map(F.lit("geometry"), F.lit("plan")).alias("sources")
    own = ["apartment_id", "floor_id"]
    floors = f.select(*own, F.lit(0).alias("ord"), F.when(k % 7 == 0, 0.0).otherwise(2.5).alias("height"))
    first = F.when((k % 17 == 0) & (k % 5 != 0), F.array(_p(0, 0), _p(4, 3), _p(4, 0), _p(0, 3))).otherwise(_box(0, 0, 4, 3))
    second = _box(F.when(k % 5 == 0, 3.5).otherwise(4.0), 0, 8, 3)
    room = lambda n, i, p, high: F.struct(F.lit(n).alias("id"), F.lit(i).alias("ord"), p.alias("polygon"), high.alias("ceiling_height"))
    rooms = f.select(*own, F.explode(F.array(room("r1", 0, first, F.lit(2.5)), room("r2", 1, second, F.when(k % 19 == 0, F.lit(0.0)).otherwise(2.5)))).alias("r")).select(*own, "r.*", sources)
    wall = lambda n, i, z, long, thick: F.struct(F.lit(n).alias("id"), F.lit(i).alias("ord"), _p(0, z).alias("start"), _p(long, z).alias("end"), thick.alias("thickness"), F.lit(2.5).alias("height"))
    walls = f.select(*own, F.explode(F.array(wall("w", 0, 0, 8, F.when(k % 23 == 0, F.lit(-1.0)).otherwise(0.2)), wall("u", 1, 5, 3, F.lit(0.2)))).alias("w")).select(*own, "w.*", sources)
    o = F.col("o_orderkey")
    bare = F.when(o % 37 != 0, F.create_map(F.lit("geometry"), F.lit("plan"))).alias("sources")
    doors = tables.load(spark, sf_dir, "orders").join(f, F.col("o_custkey") == k).select(
        *own, F.concat(F.lit("d"), o.cast("string")).alias("id"), o.alias("ord"), F.lit("w").alias("wall_id"), (o % 89 / 10).alias("offset"), F.when(o % 53 == 0, 0.0).otherwise(0.4).alias("width"), F.lit(2.0).alias("height"), bare
    )
    windows = f.select(*own, F.when(k % 41 == 0, "r1").otherwise("v").alias("id"), F.lit(0).alias("ord"), F.lit("u").alias("wall_id"), F.lit(1.5).alias("offset"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"), F.when(k % 43 == 0, F.lit(-0.1)).otherwise(0.9).alias("sill_height"), sources)
    fixtures = f.select(*own, F.lit("bath").alias("id"), F.lit(0).alias("ord"), F.when(k % 31 != 0, "r1").alias("room_id"), _box(1, 1, 2, 2).alias("footprint"), F.when(k % 29 == 0, F.lit(0.0)).otherwise(0.6).alias("height"), sources)
    furniture = spark.createDataFrame([], "apartment_id string, floor_id string, ord int, id string, catalog_id string, room_id string, position struct<x:double,z:double>, rotation double, width double, depth double, height double")
    return validation.validated(apartments, floors, rooms, walls, doors, windows, fixtures, furniture)


@query("""
WITH d AS (SELECT p_partkey AS k, CAST(1.2 + p_size % 7 * 0.5 AS DOUBLE) AS pos, CAST(0.6 + p_partkey % 5 * 0.1 AS DOUBLE) AS w, ['hinged', 'double', 'sliding', 'bifold', 'opening'][CAST(p_partkey % 5 + 1 AS INT)] AS kind, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS side FROM part),
z AS (
  SELECT k, 'door:swing' AS zone_id, 'door-swing' AS issue, pos, w, CASE kind WHEN 'hinged' THEN w ELSE w / 2 END AS deep, side FROM d WHERE kind IN ('hinged', 'double', 'bifold')
  UNION ALL SELECT k, 'door:access' || s, 'door-clearance', pos, w, CAST(0.8 AS DOUBLE), 1 - 2 * s FROM d, (VALUES (0), (1)) v(s)
  UNION ALL SELECT k, 'window:access' || s, 'window-blocked', CAST(6.5 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0.3 AS DOUBLE), 1 - 2 * s FROM d, (VALUES (0), (1)) v(s))
SELECT k AS p_partkey, zone_id, issue, floor((pos - w / 2) * 10000 + 0.5) / 10000 AS min_x, floor((pos + w / 2) * 10000 + 0.5) / 10000 AS max_x,
  floor(CASE WHEN side > 0 THEN 0.1 ELSE -0.1 - deep END * 10000 + 0.5) / 10000 AS min_z, floor(CASE WHEN side > 0 THEN 0.1 + deep ELSE -0.1 END * 10000 + 0.5) / 10000 AS max_z, floor(w * deep * 10000 + 0.5) / 10000 AS area FROM z""")
def opening_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must stay free about a door and a window, for every part."""
    d = tables.dealt(spark, sf_dir, "part", "p_partkey").withColumn("floor_id", F.col("p_partkey"))
    k = F.col("p_partkey")
    walls = d.select("floor_id", F.lit("w").alias("wall_id"), _p(0, 0).alias("start"), _p(8, 0).alias("end"), F.lit(0.2).alias("thickness"))
    kind = F.element_at(F.array(*map(F.lit, ("hinged", "double", "sliding", "bifold", "opening"))), (k % 5 + 1).cast("int"))
    doors = d.select("floor_id", F.lit("door").alias("id"), F.lit("w").alias("wall_id"), (1.2 + F.col("p_size") % 7 * 0.5).alias("offset"), (0.6 + k % 5 * 0.1).alias("width"), kind.alias("kind"), F.when(k % 2 == 0, 1).otherwise(-1).alias("swing_side"), _null("string", "note"))
    windows = d.select("floor_id", F.lit("window").alias("id"), F.lit("w").alias("wall_id"), F.lit(6.5).alias("offset"), F.lit(1.0).alias("width"), F.lit(0.9).alias("sill_height"))
    z = zones.functional_zones(walls, doors, windows).withColumn("b", G.bounds(F.col("polygon")))
    return z.select(F.col("floor_id").alias("p_partkey"), "zone_id", "issue", *[R(F.col(f"b.{c}"), 4).alias(c) for c in ("min_x", "max_x", "min_z", "max_z")], R(G.area(F.col("polygon")), 4).alias("area"))


@query("""
WITH d AS (SELECT p_partkey AS k, p_size FROM part)
SELECT k AS p_partkey, CASE WHEN k % 3 = 0 THEN NULL ELSE 'south' END AS negative, CASE WHEN p_size % 2 = 0 THEN 'west' ELSE 'east' END AS positive, CASE WHEN p_size % 2 = 0 THEN 'door' ELSE '' END AS west_doors, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'door' END AS east_doors, 'wall' AS west_walls FROM d""")
def door_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rooms that a door connects, and the doors and walls of rooms, for every part."""
    d = tables.dealt(spark, sf_dir, "part", "p_partkey").withColumn("floor_id", F.col("p_partkey"))
    room = lambda n, i, p, where=None: F.struct(F.lit(n).alias("room_id"), F.lit(i).alias("ord"), p.alias("polygon")) if where is None else F.when(where, F.struct(F.lit(n).alias("room_id"), F.lit(i).alias("ord"), p.alias("polygon")))
    rooms = d.select("floor_id", F.explode(F.array_compact(F.array(room("west", 0, _box(0, 0.1, 3, 3)), room("east", 1, _box(3.1, 0.1, 6, 3)), room("south", 2, _box(0, -3, 6, -0.1), F.col("p_partkey") % 3 != 0)))).alias("r")).select("floor_id", "r.*")
    walls = d.select("floor_id", F.lit("wall").alias("wall_id"), F.lit(0).alias("ord"), _p(0, 0).alias("start"), _p(6, 0).alias("end"), F.lit(0.2).alias("thickness"))
    doors = d.select("floor_id", F.lit("door").alias("id"), F.lit(0).alias("ord"), F.lit("wall").alias("wall_id"), F.when(F.col("p_size") % 2 == 0, 1.5).otherwise(4.5).alias("offset"))
    linked, whole = zones.topology(rooms, walls, doors, doors.limit(0))
    of = lambda name, c: F.array_join(F.max(F.when(F.col("room_id") == name, F.coalesce(c, F.array().cast("array<string>")))), ",")
    lists = whole.groupBy("floor_id").agg(of("west", "door_ids").alias("west_doors"), of("east", "door_ids").alias("east_doors"), of("west", "wall_ids").alias("west_walls"))
    return linked.join(lists, "floor_id").select(F.col("floor_id").alias("p_partkey"), "negative", "positive", "west_doors", "east_doors", "west_walls")


@query("""
WITH a AS (SELECT o_custkey AS f, o_orderkey AS o, CAST(o_orderkey % 43 AS DOUBLE) / 10 AS x, CAST(o_orderkey % 31 AS DOUBLE) / 10 AS z FROM orders),
out AS (SELECT f, o, 'outside-room' AS code, 'room' AS other, sqrt(pow(greatest(0, 0.3 - x, x + 0.3 - 4), 2) + pow(greatest(0, 0.2 - z, z + 0.2 - 3), 2)) AS amt FROM a),
hit AS (SELECT a.f, a.o, 'furniture-collision' AS code, CAST(b.o AS VARCHAR) AS other, least(0.6 - abs(a.x - b.x), 0.4 - abs(a.z - b.z)) AS amt FROM a JOIN a b ON a.f = b.f AND a.o <> b.o)
SELECT f AS o_custkey, o AS o_orderkey, code, other AS other_id, 'hard' AS severity, floor(amt * 100 + 0.5) / 100 AS amount FROM (SELECT * FROM out UNION ALL SELECT * FROM hit) WHERE amt > 0.0051""")
def placement_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A room per customer with a piece of furniture per order: what stands out of it, and what collides."""
    o = tables.load(spark, sf_dir, "orders").withColumn("floor_id", F.col("o_custkey"))
    k = F.col("o_orderkey")
    items = o.select("floor_id", k.cast("string").alias("item_id"), F.lit("room").alias("room_id"), _p(k % 43 / 10, k % 31 / 10).alias("position"), F.lit(0.0).alias("rotation"), F.lit(0.6).alias("width"), F.lit(0.4).alias("depth"), F.lit(1.0).alias("height"), F.lit(0.0).alias("elevation"), F.lit(True).alias("collides"), F.lit(0.0).alias("front_clearance"))
    rooms = o.select("floor_id").distinct().select("floor_id", F.lit("room").alias("room_id"), F.lit(0).alias("ord"), _box(0, 0, 4, 3).alias("polygon"))
    pt = "struct<x:double,z:double>"
    none = lambda schema: spark.createDataFrame([], schema)
    walls, fixtures = none(f"floor_id long, wall_id string, start {pt}, end {pt}, thickness double"), none(f"floor_id long, id string, footprint array<{pt}>")
    zone = none(f"floor_id long, zone_id string, kind string, issue string, source_id string, label string, min_item_top double, polygon array<{pt}>")
    found = placement.placement_issues(items, rooms, walls, fixtures, items, zone)
    return found.select(F.col("floor_id").alias("o_custkey"), F.col("item_id").cast("long").alias("o_orderkey"), "code", "other_id", "severity", R(F.col("amount"), 2).alias("amount"))


@query("""
WITH c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer),
d AS (SELECT o_custkey AS k, max(CASE WHEN o_orderkey % 10 = 0 THEN 1 WHEN CAST(o_orderkey % 97 AS DOUBLE) / 97 < 0.6 THEN 1 WHEN CAST(o_orderkey % 89 AS DOUBLE) / 89 < 0.5 THEN 1 ELSE 0 END) AS warn,
  sum(CASE WHEN o_orderkey % 10 = 0 OR CAST(o_orderkey % 97 AS DOUBLE) / 97 < 0.6 OR CAST(o_orderkey % 89 AS DOUBLE) / 89 < 0.5 THEN 1 ELSE 0 END) AS n_doors FROM orders GROUP BY o_custkey),
p AS (SELECT c.k, CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END AS no_rooms, CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END AS thin,
  CASE WHEN k % 9 <> 0 AND CAST(k % 7 AS DOUBLE) / 7 < 0.7 THEN 1 ELSE 0 END AS bounds, CASE WHEN k % 9 <> 0 AND k % 4 = 0 THEN 1 ELSE 0 END AS unnamed, CASE WHEN k % 9 <> 0 AND k % 4 = 1 THEN 1 ELSE 0 END AS inferred, CASE WHEN k % 9 <> 0 AND k % 4 > 1 AND k % 5 = 0 THEN 1 ELSE 0 END AS unclear,
  CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS estimated, CASE WHEN n % 3 = 1 THEN 1 ELSE 0 END AS manual, CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS paper FROM c)
SELECT p.k AS c_custkey, CASE WHEN no_rooms = 1 THEN 'failed' WHEN thin + bounds + estimated + paper > 0 THEN 'needs-review' WHEN unnamed + unclear + coalesce(warn, 0) > 0 THEN 'ok-with-warnings' ELSE 'ok' END AS status,
  CAST(no_rooms + thin + bounds + unnamed + inferred + unclear + estimated + manual + paper + 1 + coalesce(n_doors, 0) AS BIGINT) AS n_problems FROM p LEFT JOIN d ON d.k = p.k""")
def review_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems and status of a plan per customer, with a door per order."""
    c, k = tables.load(spark, sf_dir, "customer"), F.col("c_custkey")
    plans = c.select(k.alias("plan_id"), F.when(k % 6 == 0, "UNCERTAIN").otherwise("LIKELY_FLOOR_PLAN").alias("document_verdict"))
    walls = c.select(k.alias("plan_id"), F.lit("w").alias("id"), F.when(k % 8 == 0, 0.5).otherwise(0.9).alias("confidence"))
    source = F.element_at(F.array(*map(F.lit, ("unknown", "inferred", "plan-label", "ocr"))), (k % 4 + 1).cast("int"))
    kind = F.when(k % 5 == 0, "unknown").otherwise("hall")
    rooms = c.where(k % 9 != 0).select(k.alias("plan_id"), F.lit("r").alias("id"), F.lit(0).alias("ord"), F.lit("Hall").alias("name"), source.alias("label_source"), _null("double", "label_confidence"), F.lit(0.9).alias("confidence"), (k % 7 / 7).alias("geometry_confidence"), kind.alias("type"))
    o = F.col("o_orderkey")
    doors = tables.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan_id"), o.cast("string").alias("id"), F.when(o % 10 == 0, "opening").otherwise("hinged").alias("kind"), (o % 97 / 97).alias("confidence"), (o % 89 / 89).alias("swing_confidence"))
    none = lambda schema: spark.createDataFrame([], schema)
    windows, fixtures = none("plan_id long, id string, confidence double"), none("plan_id long, id string")
    strategy = F.element_at(F.array(*map(F.lit, ("estimated", "manual", "dimensions"))), (F.col("c_nationkey") % 3 + 1).cast("int"))
    scales = c.select(k.alias("plan_id"), strategy.alias("strategy"), F.lit(0).alias("samples_rejected"), F.lit("high").alias("confidence"))
    found = review.problems(plans, none("plan_id long, severity string, code string, element_id string"), walls, rooms, doors, windows, fixtures, scales, none("plan_id long, text string"))
    return review.statuses(plans, found).select(F.col("plan_id").alias("c_custkey"), "status", "n_problems")


@query("""
WITH s AS (SELECT c_custkey AS k, CAST(15 + c_custkey % 67 * 5 AS DOUBLE) AS long, CAST([4, 6, 9, 12, 16][CAST(c_nationkey % 5 + 1 AS INT)] AS DOUBLE) AS t, CAST(0.3 + c_custkey % 8 * 0.1 AS DOUBLE) AS c FROM customer),
e AS (SELECT *, CASE WHEN 340 - long <= 6 + t / 2 + 2 THEN 1 ELSE 0 END AS links, CASE WHEN abs(12 - t) <= abs(6 - t) THEN CAST(12 AS DOUBLE) ELSE CAST(6 AS DOUBLE) END AS mode FROM s),
f AS (SELECT *, greatest(CAST(0 AS DOUBLE), 1 - abs(t - mode) / (CASE WHEN t > mode THEN CAST(1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END * mode)) AS fit, CASE links WHEN 1 THEN CAST(1 AS DOUBLE) ELSE long / 1400 END AS share FROM e),
g AS (SELECT *, c * (CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * fit) * (CAST(0.55 AS DOUBLE) + CAST(0.45 AS DOUBLE) * links / 2) * least(CAST(1 AS DOUBLE), long / (3 * t)) AS score FROM f),
h AS (SELECT *, CASE WHEN (share < 0.15 AND (score < 0.35 OR fit < 0.5)) OR (links = 0 AND (score < 0.35 OR fit < 0.5 OR long < 3 * t)) THEN 'removed' WHEN score < 0.45 OR share < 0.15 THEN 'doubtful' ELSE 'kept' END AS fate FROM g)
SELECT k AS c_custkey, fate, floor(score * 1000000 + 0.5) / 1000000 AS score, floor(share * 10000 + 0.5) / 10000 AS cluster, CAST(links AS DOUBLE) / 2 AS connectivity, floor(CASE fate WHEN 'doubtful' THEN least(c, score + 0.1) ELSE c END * 100 + 0.5) / 100 AS confidence FROM h""")
def structure_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of walls and a stroke in it for every customer: is the stroke a wall?"""
    c, k = tables.dealt(spark, sf_dir, "customer", "c_custkey"), F.col("c_custkey")
    thick = F.element_at(F.array(*[F.lit(float(t)) for t in (4, 6, 9, 12, 16)]), (F.col("c_nationkey") % 5 + 1).cast("int"))
    wall = lambda n, a, b, t, sure: F.struct(F.lit(n).alias("wall_id"), a.alias("a"), b.alias("b"), t.alias("thickness"), sure.alias("confidence"))
    box = [wall(f"w{i}", _p(*a), _p(*b), F.lit(12.0), F.lit(0.9)) for i, (a, b) in enumerate([((0, 0), (400, 0)), ((400, 0), (400, 300)), ((0, 300), (400, 300)), ((0, 0), (0, 300))])]
    stroke = wall("stroke", _p(60, 150), _p(60 + (15 + k % 67 * 5), 150), thick, 0.3 + k % 8 * 0.1)
    walls = c.select(k.alias("plan_id"), F.explode(F.array(*box, stroke)).alias("w")).select("plan_id", "w.*")
    profiles = c.select(k.alias("plan_id"), F.lit(12.0).alias("major"), F.array(F.lit(12.0), F.lit(6.0)).alias("modes"))
    got = structure.assessed(walls, profiles).where("wall_id = 'stroke'")
    return got.select(F.col("plan_id").alias("c_custkey"), "fate", R(F.col("score"), 6).alias("score"), R(F.col("cluster"), 4).alias("cluster"), "connectivity", R(F.col("confidence"), 2).alias("confidence"))


@query("""
WITH s AS (SELECT p_partkey AS k, CAST(p_size * 6 - 5 AS DOUBLE) AS far, p_partkey % 2 AS across, CASE WHEN p_partkey % 3 = 0 THEN 12 ELSE 8 END AS t, CASE WHEN p_partkey % 5 = 0 THEN 40 ELSE 0 END AS off FROM part)
SELECT k AS p_partkey, CASE across WHEN 1 THEN 'to-wall' ELSE 'collinear' END AS kind, 'other' AS other_id, CAST(100 AS DOUBLE) AS start, CASE across WHEN 1 THEN 100 + far - t / 2 - 1.5 ELSE 100 + far END AS stop FROM s
WHERE (across = 1 AND far - t / 2 - 1.5 > 2 AND far - t / 2 - 1.5 <= 240) OR (across = 0 AND t = 8 AND off = 0 AND far > 1 AND far <= 240)""")
def wall_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wall and another ahead of it, on its line or across, for every part: the gap between them."""
    d, k = tables.dealt(spark, sf_dir, "part", "p_partkey"), F.col("p_partkey")
    at, off = 100 + (F.col("p_size") * 6 - 5).cast("double"), F.when(k % 5 == 0, 40.0).otherwise(0.0)
    thick = F.when(k % 3 == 0, 12.0).otherwise(8.0)
    wall = lambda n, a, b, t: F.struct(F.lit(n).alias("wall_id"), a.alias("a"), b.alias("b"), t.alias("thickness"))
    other = F.when(k % 2 == 1, wall("other", _p(at, -50), _p(at, 50), thick)).otherwise(wall("other", _p(at, off), _p(at + 100, off), thick))
    walls = d.select(k.alias("plan_id"), F.explode(F.array(wall("own", _p(0, 0), _p(100, 0), F.lit(8.0)), other)).alias("w")).select("plan_id", "w.*")
    got = gaps.found(walls, d.select(k.alias("plan_id"), F.lit(8.0).alias("major")))
    # a gap on one line belongs to the smaller id, and is told from there
    own = got.where("wall_id = 'own'").select("plan_id", "kind", "other_id", "start", "stop")
    back = got.where("wall_id = 'other' AND kind = 'collinear'").select("plan_id", "kind", F.lit("other").alias("other_id"), F.lit(100.0).alias("start"), (100 + F.col("stop") - F.col("start")).alias("stop"))
    return own.unionByName(back).select(F.col("plan_id").alias("p_partkey"), "kind", "other_id", R(F.col("start"), 4).alias("start"), R(F.col("stop"), 4).alias("stop"))


@query("""
WITH c AS (SELECT c_custkey AS node, coalesce(lag(c_acctbal) OVER (ORDER BY c_custkey) < -900, TRUE) AS new FROM customer),
r AS (SELECT node, sum(CAST(new AS INT)) OVER (ORDER BY node) AS run FROM c)
SELECT node, min(node) OVER (PARTITION BY run) AS label FROM r""")
def component_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in a row, each linked with the next unless deep in debt: long chains over the whole table."""
    c = tables.load(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("long")
    ends = c.select(key.alias("u"), F.when(F.col("c_acctbal") < -900, key).otherwise(key + 1).alias("v"))
    known = c.select(key.alias("v"))
    links = ends.join(known, "v").select("u", "v").unionByName(known.select(F.col("v").alias("u"), "v"))
    return spatial.components(links)


@query("""
WITH o AS (SELECT o_orderkey AS k, o_custkey, CASE o_orderkey % 10 WHEN 0 THEN 'File is not valid JSON.' WHEN 1 THEN 'Unrecognised project format.' WHEN 2 THEN 'Project schema v3 is newer than v2.' WHEN 3 THEN 'No migration from schema v0.' WHEN 4 THEN 'Project apartment has no floors.' END AS error, o_orderkey % 10 = 5 AS new FROM orders)
SELECT k AS o_orderkey, error, CASE WHEN error IS NULL THEN 2 ELSE -1 END AS version, CASE WHEN error IS NULL THEN CASE WHEN new THEN 'measured' WHEN o_custkey % 3 = 0 THEN 'user' ELSE 'plan-geometry' END END AS wall_source,
  CASE WHEN error IS NULL AND NOT new THEN 'assumed' END AS height_source, CASE WHEN error IS NULL AND NOT new THEN CASE WHEN o_custkey % 4 = 3 THEN 'high' WHEN o_custkey % 4 = 2 THEN 'medium' ELSE 'low' END END AS grade FROM o""")
def projects_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A save file per order, of every version and kind of damage."""
    k, c = F.col("o_orderkey") % 10, F.col("o_custkey")
    wall = F.when(k == 5, '{"id":"w","sources":{"geometry":"measured"}}').when(c % 3 == 0, '{"id":"w","source":"user"}').otherwise('{"id":"w"}')
    samples = F.array_join(F.transform(F.sequence(F.lit(0), c % 4), lambda i: F.when(i == 0, F.lit('{"accepted":false}')).otherwise(F.lit('{"roomId":"r","accepted":true}'))), ",")
    version = F.when(k == 2, "3").when(k == 3, "0").when(k.isin(4, 5), "2").otherwise("1")
    form = F.when(k == 1, "drawing").otherwise("plans/apartment-project")
    floors = F.when(k == 4, F.lit("")).otherwise(F.concat(F.lit('"floors":[{"walls":['), wall, F.lit("]}],")))
    text = F.concat(F.lit('{"format":"'), form, F.lit('","schemaVersion":'), version, F.lit(',"apartment":{'), floors, F.lit('"coordinateSystem":{"plan":{"calibration":{"method":"labels","maxResidual":0.01,"samples":['), samples, F.lit("]}}}}}"))
    files = tables.load(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 0, F.concat(F.lit("{"), text)).otherwise(text).alias("json"))
    d = projects.loaded(files, "o_orderkey", "json")
    at = lambda path: F.get_json_object("document", "$." + path)
    return d.select(
        F.col("id").alias("o_orderkey"), "error", F.coalesce(at("schemaVersion").cast("int"), F.lit(-1)).alias("version"), at("floors[0].walls[0].sources.geometry").alias("wall_source"), at("floors[0].heightSource").alias("height_source"),
        at("coordinateSystem.plan.calibration.confidence").alias("grade"),
    )


#: Words dealt over parts: floors and walls with what they stand for, and pieces of furniture.
FLOORS = (("walnut", "floor-walnut"), ("marble", "floor-marble"), ("light oak", "floor-light-oak"), ("timber", "floor-oak"))
WALLS = (("cream", "paint-cream"), ("sage", "paint-sage"), ("white", "paint-white"))
PIECES = (("sofa", "sofa-3"), ("king size bed", "bed-king"), ("bookcase", "bookshelf"), ("desk", "desk"), ("tv stand", "tv-unit"))


def _dealt(words: tuple, k: Column, j: int = 0) -> Column:
    return F.element_at(F.array(*[F.lit(w[j]) for w in words]), (k % len(words) + 1).cast("int"))


def _sql_dealt(words: tuple, k: str, j: int = 0) -> str:
    return f"[{', '.join(repr(w[j]) for w in words)}][CAST({k} % {len(words)} + 1 AS INT)]"


@query(f"""
WITH d AS (SELECT p_partkey AS k, p_partkey % 6 AS form, p_size AS s FROM part)
SELECT k AS p_partkey, ['place_furniture', 'check_fit', 'renovate', 'remove_furniture', 'describe_room', 'unknown'][CAST(form + 1 AS INT)] AS action,
  CASE form WHEN 0 THEN CASE s % 3 WHEN 0 THEN 'living' WHEN 1 THEN 'hall' ELSE 'bed2' END WHEN 1 THEN CASE WHEN s % 2 = 0 THEN 'bed1' ELSE 'bed2' END WHEN 2 THEN CASE WHEN s % 2 = 0 THEN 'bed1' ELSE 'bed1,bed2,living,hall' END WHEN 4 THEN 'hall' ELSE '' END AS rooms,
  CASE form WHEN 0 THEN rtrim(repeat('dining-chair,', CAST(least(8, s % 9 + 1) AS INT)), ',') WHEN 1 THEN {_sql_dealt(PIECES, "s", 1)} WHEN 3 THEN {_sql_dealt(PIECES, "s", 1)} ELSE '' END AS furniture,
  CASE WHEN form = 2 THEN {_sql_dealt(FLOORS, "s", 1)} END AS floor, CASE WHEN form = 2 THEN {_sql_dealt(WALLS, "k", 1)} END AS wall FROM d""")
def intents_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence per part, made of its number and size, in a flat of four rooms; every sixth is the part's own name."""
    d = tables.dealt(spark, sf_dir, "part", "p_partkey")
    k, s = F.col("p_partkey"), F.col("p_size")
    where = F.when(s % 3 == 0, "living room").when(s % 3 == 1, "corridor").otherwise("smallest bedroom")
    forms = [
        F.concat(F.lit("Please put "), (s % 9 + 1).cast("string"), F.lit(" dining chairs in the "), where, F.lit(".")), F.concat(F.lit("Can a "), _dealt(PIECES, s), F.lit(" fit in bedroom "), (s % 2 + 1).cast("string"), F.lit("?")),
        F.concat(F.lit("Renovate "), F.when(s % 2 == 0, "the bedroom").otherwise("every room"), F.lit(" with "), _dealt(FLOORS, s), F.lit(" flooring and "), _dealt(WALLS, k), F.lit(" walls")),
        F.concat(F.lit("Get rid of the "), _dealt(PIECES, s)), F.lit("Describe the entrance"), F.col("p_name"),
    ]
    text = forms[5]
    for i, form in enumerate(forms[:5]):
        text = F.when(k % 6 == i, form).otherwise(text)
    asked = d.select(k.alias("ask_id"), k.alias("plan_id"), text.alias("text"), _null("string", "selected_room_id"))
    flat = [("bed1", "Bedroom 1", "bedroom", 14.0), ("bed2", "Bedroom 2", "bedroom", 11.0), ("living", "Salon", "living", 25.0), ("hall", "Lobby", "hall", 6.0)]
    rooms = d.select(k.alias("plan_id"), F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(r).alias("room_id"), F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(a).alias("area")) for i, (r, n, t, a) in enumerate(flat)])).alias("r")).select("plan_id", "r.*")
    got = intents.parsed(asked, rooms).select("ask_id", F.explode("intents").alias("i"))
    listed = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return got.select(F.col("ask_id").alias("p_partkey"), "i.action", listed("i.room_ids").alias("rooms"), listed("i.furniture").alias("furniture"), F.col("i.patch")["floorMaterialId"].alias("floor"), F.col("i.patch")["wallMaterialId"].alias("wall"))


@query("""
WITH o AS (SELECT o_orderkey AS k, CAST(60 + o_custkey % 7 * 30 AS DOUBLE) AS long, o_orderkey % 9 = 0 AS flat FROM orders),
d AS (SELECT k, long, flat, CAST(l_linenumber * 30 - 40 AS DOUBLE) AS a, CAST(l_linenumber * 30 - 40 + 1 + supp % 29 AS DOUBLE) AS b FROM (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS supp FROM lineitem GROUP BY ALL) JOIN o ON l_orderkey = k),
c AS (SELECT *, greatest(a, 0) AS lo, least(b, long) AS hi FROM d),
e AS (SELECT *, CASE WHEN flat THEN 'wall-gone' WHEN hi - lo < greatest(2, (b - a) / 2) THEN 'outside-wall' ELSE 'kept' END AS fate FROM c)
SELECT k AS o_orderkey, count(*) FILTER (WHERE fate = 'kept') AS n_kept, count(*) FILTER (WHERE fate = 'wall-gone') AS n_wall_gone, count(*) FILTER (WHERE fate = 'outside-wall') AS n_outside, coalesce(sum(hi - lo) FILTER (WHERE fate = 'kept'), 0) AS total FROM e GROUP BY k""")
def sanitized_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wall per order with a door per line: doors cut to the wall, dropped beyond it, and gone with it."""
    k = F.col("o_orderkey")
    o = tables.dealt(spark, sf_dir, "orders", "o_orderkey").select(k.cast("string").alias("plan_id"), (60 + F.col("o_custkey") % 7 * 30).cast("double").alias("long"), (k % 9 == 0).alias("flat"))
    rect = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("long").alias("x1"), F.when(F.col("flat"), 0.0).otherwise(10.0).alias("y1"))
    walls = o.select("plan_id", F.lit("w").alias("id"), rect.alias("rect"), _null("struct<a:struct<x:double,z:double>,b:struct<x:double,z:double>,thickness:double>", "segment"))
    at = (F.col("l_linenumber") * 30 - 40).cast("double")
    lines = tables.load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("l_suppkey"))
    doors = lines.select(F.col("l_orderkey").cast("string").alias("plan_id"), F.col("l_linenumber").cast("string").alias("id"), F.col("l_linenumber").cast("int").alias("ord"), F.lit("w").alias("wall_id"), F.lit("hinged").alias("kind"), F.lit(0.9).alias("confidence"), at.alias("span_from"), (at + 1 + F.col("l_suppkey") % 29).alias("span_to"))
    none = lambda schema: spark.createDataFrame([], schema)
    shapes = "plan_id string, id string, polygon array<struct<x:double,z:double>>"
    got = sanitize.sanitized(walls, doors, doors.limit(0), none(shapes), none(shapes), none("plan_id string, polygon array<struct<x:double,z:double>>"))
    notes = got.notes.where("element_id <> 'w'").groupBy("plan_id").agg(F.count_if(F.col("repair") == "wall-gone").alias("gone"), F.count_if(F.col("repair") == "outside-wall").alias("outside"))
    kept = got.doors.groupBy("plan_id").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.col("span_to") - F.col("span_from")).alias("total"))
    d = doors.select("plan_id").distinct().join(notes, "plan_id", "left").join(kept, "plan_id", "left").fillna(0, ["gone", "outside", "kept"]).fillna(0.0, ["total"])
    return d.select(F.col("plan_id").cast("long").alias("o_orderkey"), F.col("kept").alias("n_kept"), F.col("gone").alias("n_wall_gone"), F.col("outside").alias("n_outside"), "total")


@query("""
WITH s AS (SELECT p_partkey AS k, CAST(p_size * 3 AS DOUBLE) AS far, p_partkey % 2 AS across FROM part)
SELECT k AS p_partkey, 'own' AS wall_id, 1 AS key, 'other' AS to_wall, CASE across WHEN 1 THEN -1 ELSE 0 END AS to_key, CASE across WHEN 1 THEN far - 4.5 ELSE far END AS length FROM s WHERE (across = 1 AND far > 10 AND far - 4.5 <= 96) OR (across = 0 AND far > 8 AND far <= 96)""")
def wall_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wall that stops short of another on its line or across, for every part: the line that closes the gap."""
    d, k = tables.dealt(spark, sf_dir, "part", "p_partkey"), F.col("p_partkey")
    at = 100 + (F.col("p_size") * 3).cast("double")
    wall = lambda n, a, b: F.struct(F.lit(n).alias("wall_id"), a.alias("a"), b.alias("b"), F.lit(8.0).alias("thickness"))
    # the other wall comes later in the order of ends
    other = F.when(k % 2 == 1, wall("other", _p(at, -50), _p(at, 50))).otherwise(wall("other", _p(at, 0), _p(at + 100, 0)))
    walls = d.select(k.alias("plan_id"), F.explode(F.array(wall("own", _p(0, 0), _p(100, 0)), other)).alias("w")).select("plan_id", "w.*")
    got = gaps.closures(walls, d.select(k.alias("plan_id"), F.lit(8.0).alias("major")))
    # either end may tell of a line between two: told from the first wall
    ends = got.select("plan_id", "wall_id", "key", "to_wall", F.coalesce("to_key", F.lit(-1)).alias("to_key"), "length")
    back = (F.col("wall_id") == "other") & (F.col("to_wall") == "own")
    turned = ends.select("plan_id", F.when(back, "own").otherwise(F.col("wall_id")).alias("wall_id"), F.when(back, F.col("to_key")).otherwise(F.col("key")).alias("key"), F.when(back, "other").otherwise(F.col("to_wall")).alias("to_wall"), F.when(back, F.col("key")).otherwise(F.col("to_key")).alias("to_key"), "length")
    return turned.select(F.col("plan_id").alias("p_partkey"), "wall_id", "key", "to_wall", "to_key", R(F.col("length"), 4).alias("length"))


@query("""
WITH d AS (SELECT p_partkey AS k, p_partkey % 8 AS form, p_size AS s FROM part),
e AS (SELECT *, CASE form WHEN 1 THEN 'Unknown room "garage". Known rooms: hall, bath.' WHEN 2 THEN CASE WHEN s % 12 BETWEEN 1 AND 8 THEN NULL ELSE 'Quantity for "plant" must be an integer 1–8.' END WHEN 3 THEN 'Response is not valid JSON.' WHEN 4 THEN CASE WHEN s % 2 = 1 THEN 'Unknown floor material "lava".,renovate needs "style" or "finishes".' END
  WHEN 5 THEN CASE WHEN s % 50 BETWEEN 6 AND 40 THEN NULL ELSE 'minimumWalkway must be a number of metres between 0.3 and 2.' END WHEN 6 THEN '[1] Unknown intent "fly". Allowed: fit_furniture, check_fit, renovate, remove_furniture, describe_room.' WHEN 7 THEN 'Unexpected field "size" for remove_furniture.' END AS errors FROM d)
SELECT k AS p_partkey, errors IS NULL AS ok, coalesce(errors, '') AS errors, CASE WHEN errors IS NULL THEN ['describe_room', '', 'place_furniture', '', 'renovate', 'check_fit'][CAST(form + 1 AS INT)] ELSE '' END AS action,
  CASE WHEN errors IS NULL AND form = 2 THEN s % 12 WHEN errors IS NULL AND form = 5 THEN 1 ELSE 0 END AS n_items FROM e""")
def answers_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language model's answer per part, sound or broken by its size, in a flat of two rooms."""
    d = tables.dealt(spark, sf_dir, "part", "p_partkey")
    k, s = F.col("p_partkey"), F.col("p_size")
    size = s.cast("string")
    forms = [
        F.lit('{"intent":"describe_room","room":"hall"}'), F.lit('{"intent":"describe_room","room":"garage"}'), F.concat(F.lit('{"intent":"fit_furniture","room":"hall","items":[{"type":"plant","quantity":'), (s % 12).cast("string"), F.lit("}]}")),
        F.concat(F.lit("The size is "), size), F.concat(F.lit('{"intent":"renovate","room":"hall","finishes":{"floor":"'), F.when(s % 2 == 1, "lava").otherwise("Walnut"), F.lit('"}}')),
        F.concat(F.lit('{"intent":"check_fit","room":"hall","items":[{"type":"desk"}],"constraints":{"minimumWalkway":'), (s % 50 / 20).cast("string"), F.lit("}}")), F.lit('[{"intent":"describe_room","room":"hall"},{"intent":"fly"}]'), F.concat(F.lit('{"intent":"remove_furniture","items":[{"type":"desk"}],"size":'), size, F.lit("}")),
    ]
    text = forms[7]
    for i, form in enumerate(forms[:7]):
        text = F.when(k % 8 == i, form).otherwise(text)
    asked = d.select(k.alias("answer_id"), k.alias("plan_id"), text.alias("text"), _null("string", "selected_room_id"))
    room = lambda i, r, n, t: F.struct(F.lit(i).alias("ord"), F.lit(r).alias("room_id"), F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(5.0).alias("area"))
    rooms = d.select(k.alias("plan_id"), F.explode(F.array(room(0, "hall", "Hall", "hall"), room(1, "bath", "Bathroom", "bathroom"))).alias("r")).select("plan_id", "r.*")
    first = F.get("intents", 0)
    got = answers.checked(asked, rooms)
    return got.select(F.col("answer_id").alias("p_partkey"), "ok", F.array_join("errors", ",").alias("errors"), F.coalesce(first["action"], F.lit("")).alias("action"), F.coalesce(F.size(first["furniture"]), F.lit(0)).alias("n_items"))


@query("""
WITH d AS (SELECT p_partkey AS k, CAST(5 + p_partkey % 4 AS DOUBLE) AS long, CAST(2 + p_size % 4 * 0.2 AS DOUBLE) AS door, CAST(p_size % 3 * 0.45 AS DOUBLE) AS sill FROM part),
t AS (SELECT *, least(CAST(2.5 AS DOUBLE), sill + 1.5) AS top FROM d)
SELECT k AS p_partkey, CAST(3 AS BIGINT) AS n_solid, CASE WHEN sill > 0 THEN 1 ELSE 0 END AS n_sill, CASE WHEN door < 2.499 THEN 1 ELSE 0 END + CASE WHEN sill + 1.5 < 2.499 THEN 1 ELSE 0 END AS n_lintel, floor((long * 2.5 - 0.8 * least(door, 2.5) - (top - sill)) * 0.2 * 10000 + 0.5) / 10000 AS volume FROM t""")
def wall_solids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wall with a door and a window per part, as boxes."""
    d, k = tables.dealt(spark, sf_dir, "part", "p_partkey"), F.col("p_partkey")
    walls = d.select(k.alias("floor_id"), F.lit("w").alias("wall_id"), _p(0, 0).alias("start"), _p((5 + k % 4).cast("double"), 0).alias("end"), F.lit(0.2).alias("thickness"), F.lit(2.5).alias("height"))
    own = [k.alias("floor_id"), F.lit("o").alias("id"), F.lit(0).alias("ord"), F.lit("w").alias("wall_id")]
    doors = d.select(*own, F.lit(1.5).alias("offset"), F.lit(0.8).alias("width"), (2 + F.col("p_size") % 4 * 0.2).alias("height"))
    windows = d.select(*own, F.lit(3.5).alias("offset"), F.lit(1.0).alias("width"), F.lit(1.5).alias("height"), (F.col("p_size") % 3 * 0.45).alias("sill_height"))
    boxes = solids.pieces(walls, solids.opening_spans(doors, windows))
    of = lambda kind: F.count_if(F.col("kind") == kind)
    counts = boxes.groupBy("floor_id").agg(of("solid").alias("n_solid"), of("sill").cast("int").alias("n_sill"), of("lintel").cast("int").alias("n_lintel"))
    whole = counts.join(solids.volumes(walls, boxes), "floor_id")
    return whole.select(F.col("floor_id").alias("p_partkey"), "n_solid", "n_sill", "n_lintel", R(F.col("volume"), 4).alias("volume"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, ['hall', 'bath', 'attic'][CAST(o_orderkey % 3 + 1 AS INT)] AS room, 'finish-' || o_orderkey % 7 AS finish, 'floor-' || o_orderkey % 5 AS floor FROM orders)
SELECT o_custkey, arg_max(finish, o_orderkey) FILTER (WHERE room <> 'attic') AS shared_door, arg_max(finish, o_orderkey) FILTER (WHERE room = 'hall') AS hall_door, arg_max(floor, o_orderkey) FILTER (WHERE room = 'bath') AS bath_floor,
  coalesce(sum(CASE room WHEN 'hall' THEN 3 WHEN 'bath' THEN 2 END), 0)::BIGINT AS n_commands FROM o GROUP BY o_custkey""")
def renovations_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat per customer, renovated once per order: two rooms share a door, a third one isn't there."""
    o = tables.load(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    room = F.element_at(F.array(*map(F.lit, ("hall", "bath", "attic"))), (key % 3 + 1).cast("int"))
    finish, floor = F.concat(F.lit("finish-"), (key % 7).cast("string")), F.concat(F.lit("floor-"), (key % 5).cast("string"))
    asked = o.select(F.col("o_custkey").alias("plan_id"), F.lit(0).alias("ask_id"), key.alias("ord"), room.alias("room_id"), F.create_map(F.lit("doorMaterialId"), finish, F.lit("floorMaterialId"), floor).alias("patch"))
    flat = F.array(F.struct(F.lit("hall").alias("room_id"), F.array(F.lit("shared"), F.lit("front")).alias("door_ids"), F.array(F.lit("v")).alias("window_ids")), F.struct(F.lit("bath").alias("room_id"), F.array(F.lit("shared")).alias("door_ids"), F.array(F.lit("v")).alias("window_ids")))
    plans = o.select(F.col("o_custkey").alias("plan_id")).distinct()
    found = renovation.commands(asked, plans.select("plan_id", F.explode(flat).alias("r")).select("plan_id", "r.*"))
    left = renovation.finished(found)
    of = lambda i, f: F.max(F.when((F.col("id") == i) & (F.col("field") == f), F.col("value")))
    last = left.groupBy("plan_id").agg(of("shared", "materialId").alias("shared_door"), of("front", "materialId").alias("hall_door"), of("bath", "floorMaterialId").alias("bath_floor"))
    counts = found.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_commands"))
    return plans.join(last, "plan_id", "left").join(counts, "plan_id", "left").fillna(0, ["n_commands"]).withColumnRenamed("plan_id", "o_custkey")
