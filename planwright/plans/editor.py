"""Registered queries of the editor: floors and edits derived from the rows of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planwright.functions import geometry as G
from planwright.operators import documents, fitting, wall_moves
from planwright.plans.registry import query
from planwright.sources import tables
from planwright.sources.furniture import catalog

#: Depth of the floors that customers get.
DEEP = 5.0


def _at(x: Column | float, z: Column | float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return G.point(lit(x), lit(z))


def _customer_floors(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A floor per customer: four outer walls, one inner wall across and one against it, three rooms, and a wish to move a wall.

    The customer's key picks what is odd about the floor: a wall short of another, one that runs on, a
    third wall at a joint, a railing, an outline off its wall.
    """
    c = tables.dealt(spark, sf_dir, "customer", "c_custkey")
    k, s = F.col("c_custkey") % 13, (F.col("c_custkey") * 5 + F.col("c_nationkey")) % 7
    wide = (4 + F.col("c_nationkey") % 5).cast("double")
    d = c.select(F.col("c_custkey").alias("floor_id"), k.alias("k"), s.alias("s"), wide.alias("w"), (wide / 2).alias("mid"))
    w, mid, k = F.col("w"), F.col("mid"), F.col("k")
    gap = F.when(k == 3, 0.1).when(k.isin(4, 9), 0.5).otherwise(F.lit(0.0))
    arm = mid + 0.06 + F.when(k == 5, 0.1).otherwise(F.lit(0.0))
    top = DEEP - 0.15

    def wall(name: str, ord_: int, kind: Column | str, start: Column, end: Column, thick: float, where: Column | None = None) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        one = F.struct(F.lit(name).alias("wall_id"), F.lit(ord_).alias("ord"), kind.alias("kind"), start.alias("start"), end.alias("end"), F.lit(thick).alias("thickness"))
        return one if where is None else F.when(where, one)

    walls = F.array_compact(F.array(
        wall("south", 0, "exterior", _at(0, 0), _at(w, 0), 0.3), wall("north", 1, "exterior", _at(0, DEEP), _at(w, DEEP), 0.3),
        wall("west", 2, "exterior", _at(0, 0), _at(0, DEEP), 0.3), wall("east", 3, "exterior", _at(w, 0), _at(w, DEEP), 0.3),
        wall("mid", 4, "interior", _at(mid, 0.15), _at(mid, top - gap), 0.12), wall("arm", 5, F.when(k == 7, "railing").otherwise("interior"), _at(arm, DEEP / 2), _at(w - 0.15, DEEP / 2), 0.12),
        wall("pin", 6, "interior", _at(mid + 0.12, DEEP / 2 - 0.5), _at(mid + 0.12, DEEP / 2 + 0.5), 0.12, k == 6),
        wall("rest", 7, "interior", _at(mid, top - 0.5), _at(mid, top), 0.12, k == 4),
    ))
    box = lambda x0, z0, x1, z1: F.array(_at(x0, z0), _at(x1, z0), _at(x1, z1), _at(x0, z1))
    room = lambda name, ord_, poly: F.struct(F.lit(name).alias("room_id"), F.lit(ord_).alias("ord"), poly.alias("polygon"))
    left = mid - 0.06 - F.when(k == 8, 0.1).otherwise(F.lit(0.0))
    rooms = F.array(room("left", 0, box(0.15, 0.15, left, top)), room("lower", 1, box(mid + 0.06, 0.15, w - 0.15, DEEP / 2 - 0.06)), room("upper", 2, box(mid + 0.06, DEEP / 2 + 0.06, w - 0.15, top)))
    outline = F.concat(box(-0.15, -0.15, w + 0.15, DEEP + 0.15), F.when(k == 2, F.array(_at(mid, DEEP / 2))).otherwise(F.array().cast("array<struct<x:double,z:double>>")))
    asked = F.when(k == 0, "attic").when(k == 1, "south").otherwise("mid")
    s = F.col("s")
    far = F.when(s == 0, F.lit(0.0)).when(s == 1, 0.25).when(s == 2, -0.25).when(s == 3, 0.5).when(s == 4, -0.5).when(s == 5, 0.25 - mid).otherwise(0.1)
    return {
        "walls": d.select("floor_id", F.explode(walls).alias("v")).select("floor_id", "v.*"),
        "rooms": d.select("floor_id", F.explode(rooms).alias("v")).select("floor_id", "v.*"),
        "openings": d.select("floor_id", F.lit("door").alias("id"), F.lit("arm").alias("wall_id"), F.lit(0.8).alias("offset"), F.lit(0.6).alias("width")),
        "outlines": d.select("floor_id", outline.alias("outline")),
        "requests": d.select("floor_id", F.lit("wish").alias("request_id"), asked.alias("wall_id"), far.alias("distance")),
    }


@query("""
WITH c AS (SELECT c_custkey, c_custkey % 13 AS k, (c_custkey * 5 + c_nationkey) % 7 AS s, CAST(4 + c_nationkey % 5 AS DOUBLE) / 2 AS mid FROM customer),
d AS (SELECT *, CASE s WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN 0.25 WHEN 2 THEN -0.25 WHEN 3 THEN 0.5 WHEN 4 THEN -0.5 WHEN 5 THEN 0.25 - mid ELSE 0.1 END AS far FROM c),
r AS (SELECT *, CASE WHEN k = 0 THEN 'unknown-wall' WHEN far = 0 THEN 'no-distance' WHEN k = 1 THEN 'not-interior' WHEN k = 2 THEN 'outline' WHEN k = 3 THEN 'ambiguous-end' WHEN k = 4 THEN 'straight-line'
  WHEN k = 5 THEN 'ambiguous-junction' WHEN k = 6 THEN 'torn-junction' WHEN k = 7 THEN 'stretches-outline' WHEN s = 5 THEN 'collapses' WHEN k = 8 THEN 'ambiguous-boundary' WHEN k = 9 THEN 'runs-past' END AS code FROM d)
SELECT c_custkey, code, CASE code WHEN 'unknown-wall' THEN 'attic' WHEN 'no-distance' THEN CASE k WHEN 1 THEN 'south' ELSE 'mid' END WHEN 'not-interior' THEN 'south' WHEN 'outline' THEN 'mid' WHEN 'ambiguous-end' THEN 'north' WHEN 'straight-line' THEN 'rest'
  WHEN 'ambiguous-boundary' THEN 'left' WHEN 'runs-past' THEN 'left' WHEN 'collapses' THEN 'arm' WHEN 'ambiguous-junction' THEN 'arm' WHEN 'torn-junction' THEN 'arm' WHEN 'stretches-outline' THEN 'arm' END AS subject,
  CASE WHEN code IS NULL THEN floor((mid - far) * 10000 + 0.5) / 10000 END AS mid_x, CASE WHEN code IS NULL THEN floor((mid + 0.06 - far) * 10000 + 0.5) / 10000 END AS arm_x,
  CASE WHEN code IS NULL THEN floor((0.8 + far) * 10000 + 0.5) / 10000 END AS door_at, CASE WHEN code IS NULL THEN floor((mid - 0.21 - far) * 4.7 * 10000 + 0.5) / 10000 END AS left_area, CASE WHEN code IS NULL THEN 3 ELSE 0 END AS n_rooms FROM r""")
def wall_moves_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _customer_floors(spark, sf_dir)
    got = wall_moves.moved(*[r[n] for n in ("requests", "walls", "rooms", "openings", "outlines")])
    of = lambda name: F.max(F.when(F.col("wall_id") == name, F.col("start.x")))
    walls = got.walls.groupBy("floor_id").agg(of("mid").alias("mid_x"), of("arm").alias("arm_x"))
    rooms = got.rooms.groupBy("floor_id").agg(F.max(F.when(F.col("room_id") == "left", G.area(F.col("polygon")))).alias("left_area"), F.count(F.lit(1)).cast("int").alias("n_rooms"))
    out = r["requests"].select("floor_id").join(got.refused.drop("request_id"), "floor_id", "left")
    for part in (walls, rooms, got.openings.select("floor_id", F.col("offset").alias("door_at"))):
        out = out.join(part, "floor_id", "left")
    return out.select(F.col("floor_id").alias("c_custkey"), "code", "subject", *[G.rounded(F.col(c), 4).alias(c) for c in ("mid_x", "arm_x", "door_at", "left_area")], F.coalesce("n_rooms", F.lit(0)).alias("n_rooms"))


@query("""
WITH d AS (SELECT user_id, event_id, ts, event_type, value, CAST(3 + user_id % 5 AS DOUBLE) AS long FROM events),
j AS (SELECT *, CASE event_type WHEN 'error' THEN NULL WHEN 'purchase' THEN value / 50 > 0 AND long / 2 - value / 100 >= -0.001 ELSE TRUE END AS ok FROM d),
k AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM j WHERE ok IS NULL OR ok),
steps AS (SELECT user_id, least(200, count(*) FILTER (WHERE ok AND before IS DISTINCT FROM event_type)) AS n_undo FROM k GROUP BY user_id)
SELECT j.user_id, count(*) FILTER (WHERE ok) AS n_done, count(*) FILTER (WHERE NOT ok) AS n_refused, any_value(n_undo) AS n_undo,
  coalesce(arg_max(value, struct_pack(a := ts, b := event_id)) FILTER (WHERE event_type = 'click'), 0) AS turned, coalesce(arg_max(value, struct_pack(a := ts, b := event_id)) FILTER (WHERE event_type = 'view'), -1) AS named,
  coalesce(arg_max(value, struct_pack(a := ts, b := event_id)) FILTER (WHERE event_type = 'signup'), -1) AS lit, coalesce(arg_max(value, struct_pack(a := ts, b := event_id)) FILTER (WHERE event_type = 'purchase' AND ok), 40) AS door,
  CASE WHEN count(*) FILTER (WHERE event_type = 'purchase' AND ok) > 0 THEN 'user' ELSE 'plan' END AS door_source
FROM j JOIN steps USING (user_id) GROUP BY j.user_id""")
def document_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as commands on a plan of their own: clicks turn a chair, views rename its room, and so on."""
    events = tables.load(spark, sf_dir, "events")
    v = F.col("value").cast("string")
    kinds = {"click": ('{"type":"furniture/update","id":"chair","patch":{"rotation":%s}}', v), "view": ('{"type":"room/rename","roomId":"room","name":"%s"}', v), "signup": ('{"type":"room/renovate","roomId":"room","patch":{"lighting":%s}}', v), "purchase": ('{"type":"door/update","id":"door","patch":{"width":%s}}', (F.col("value") / 50).cast("string"))}
    command = F.lit(None).cast("string")
    for kind, (form, what) in kinds.items():
        command = F.when(F.col("event_type") == kind, F.format_string(form, what)).otherwise(command)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    edits = events.select("user_id", place.alias("seq"), F.when(F.col("event_type") == "error", "end").otherwise("dispatch").alias("action"), command.alias("command"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("key"))
    start = F.format_string(
        '{"floors":[{"walls":[{"id":"wall","kind":"interior","start":[0,0],"end":[%s,0],"thickness":0.1}],"rooms":[{"id":"room","name":"-1","renovation":{"lighting":-1}}],'
        '"doors":[{"id":"door","wallId":"wall","offset":%s,"width":0.8,"height":2,"sources":{"geometry":"plan"}}],"furniture":[{"id":"chair","roomId":"room","rotation":0}]}]}',
        (3 + F.col("user_id") % 5).cast("string"), ((3 + F.col("user_id") % 5) / 2).cast("string"),
    )
    first = events.select("user_id").distinct().select("user_id", F.lit(0).alias("seq"), F.lit("load").alias("action"), start.alias("command"), F.lit(None).cast("string").alias("key"))
    out = documents.folded(edits.unionByName(first).withColumnRenamed("user_id", "doc"))
    g = out.groupBy("doc").agg(
        F.count_if(F.col("ok") & (F.col("action") == "dispatch")).alias("n_done"), F.count_if(~F.col("ok")).alias("n_refused"), F.max("state").alias("state"),
    )
    at = lambda path: F.get_json_object("state", "$." + path)
    floor = "document.floors[0]."
    number = lambda path: at(floor + path).cast("double")
    return g.select(
        F.col("doc").cast("long").alias("user_id"), "n_done", "n_refused", F.json_array_length(at("past")).cast("long").alias("n_undo"), number("furniture[0].rotation").alias("turned"), number("rooms[0].name").alias("named"),
        number("rooms[0].renovation.lighting").alias("lit"), F.round(number("doors[0].width") * 50, 6).alias("door"), at(floor + "doors[0].sources.geometry").alias("door_source"),
    )


#: What customers ask for, by the remainder of their key: catalogue id, width, depth, clearance in front, whether the longest wall is preferred.
WISHES = (("sofa-3", 2.2, 0.9, 0.6, 1), ("bookshelf", 0.8, 0.32, 0.6, 0), ("desk", 1.2, 0.6, 0.8, 0), ("wardrobe", 1.0, 0.6, 0.7, 0), ("throne", None, None, None, 0), ("bed-king", 1.6, 2.1, 0.6, 1))


@query(f"""
WITH wish(k, item, w, d, front, longest) AS (VALUES {", ".join(f"({i}, '{n}', {w or 'NULL'}, {d or 'NULL'}, {f or 'NULL'}, {g})" for i, (n, w, d, f, g) in enumerate(WISHES))}),
c AS (SELECT c_custkey, item, CAST(w AS DOUBLE) AS w, CAST(d AS DOUBLE) AS d, CAST(front AS DOUBLE) AS front, longest, CAST(1.35 + (c_nationkey % 5) * 0.6 AS DOUBLE) AS wide, CAST(1.55 + (c_custkey // 6 % 4) * 0.55 AS DOUBLE) AS deep FROM customer JOIN wish ON k = c_custkey % 6),
e AS (SELECT *, CASE WHEN item = 'throne' THEN 'unknown-item' WHEN NOT ((w <= wide AND d <= deep) OR (w <= deep AND d <= wide)) THEN 'too-large' END AS first,
  CASE WHEN wide >= w AND d + 0.02 <= deep + 0.005 THEN CASE WHEN d + 0.02 + front <= deep + 0.005 THEN 0 ELSE 1 END END AS south,
  CASE WHEN deep >= w AND d + 0.02 <= wide + 0.005 THEN CASE WHEN d + 0.02 + front <= wide + 0.005 THEN 0 ELSE 1 END END AS east FROM c),
f AS (SELECT *, coalesce(first, CASE WHEN south IS NULL AND east IS NULL THEN 'no-valid-position' END) AS failure, east IS NULL OR (south IS NOT NULL AND (south < east OR (south = east AND NOT (longest = 1 AND deep > wide)))) AS is_south,
  CASE WHEN wide >= w THEN 2 * CAST(floor((wide / 2 - w / 2 + 1e-9) / 0.05) AS INT) + 1 ELSE 0 END AS n_south, CASE WHEN deep >= w THEN 2 * CAST(floor((deep / 2 - w / 2 + 1e-9) / 0.05) AS INT) + 1 ELSE 0 END AS n_east FROM e)
SELECT c_custkey, failure, CASE WHEN failure IS NULL THEN floor(CASE WHEN is_south THEN wide / 2 ELSE wide - d / 2 - 0.02 END * 10000 + 0.5) / 10000 END AS x, CASE WHEN failure IS NULL THEN floor(CASE WHEN is_south THEN d / 2 + 0.02 ELSE deep / 2 END * 10000 + 0.5) / 10000 END AS z,
  CASE WHEN failure IS NULL THEN CASE WHEN is_south THEN south ELSE east END ELSE -1 END AS n_issues,
  CASE WHEN first IS NOT NULL THEN 0 WHEN failure IS NULL AND CASE WHEN is_south THEN south ELSE east END = 0 AND CASE WHEN is_south THEN n_east = 0 OR NOT (longest = 1 AND deep > wide) ELSE n_south = 0 OR (longest = 1 AND deep > wide) END THEN 1
    ELSE 2 * n_south + 2 * n_east END::BIGINT AS tried FROM f""")
def fitted_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bare room and a piece of furniture for every customer."""
    c = tables.dealt(spark, sf_dir, "customer", "c_custkey")
    wide, deep = 1.35 + F.col("c_nationkey") % 5 * 0.6, 1.55 + F.floor(F.col("c_custkey") / 6) % 4 * 0.55
    rooms = c.select(F.col("c_custkey").alias("floor_id"), F.lit("room").alias("room_id"), F.lit(0).alias("ord"), F.array(_at(0, 0), _at(wide, 0), _at(wide, deep), _at(0, deep)).alias("polygon"))
    item = F.element_at(F.array(*[F.lit(w[0]) for w in WISHES]), (F.col("c_custkey") % len(WISHES) + 1).cast("int"))
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    asked = c.select(F.col("c_custkey").alias("floor_id"), F.lit("wish").alias("request_id"), F.lit(0).alias("ord"), F.lit("room").alias("room_id"), item.alias("catalog_id"), *[null("double", k) for k in ("width", "depth", "height")], null("string", "prefer_wall"))
    none = lambda schema: spark.createDataFrame([], schema)
    pt = "struct<x:double,z:double>"
    walls = none(f"floor_id long, wall_id string, start {pt}, end {pt}, thickness double")
    fixtures = none(f"floor_id long, id string, footprint array<{pt}>")
    furniture = none(f"floor_id long, item_id string, room_id string, category string, ord long, position {pt}, rotation double, width double, depth double, height double, elevation double, collides boolean, front_clearance double")
    zones = none(f"floor_id long, zone_id string, kind string, issue string, source_id string, label string, min_item_top double, polygon array<{pt}>")
    got, _ = fitting.fitted(asked, catalog(spark), rooms, walls, fixtures, furniture, zones)
    return got.select(F.col("floor_id").alias("c_custkey"), "failure", G.rounded(F.col("position.x"), 4).alias("x"), G.rounded(F.col("position.z"), 4).alias("z"), F.when(F.col("ok"), F.size("issues")).otherwise(-1).alias("n_issues"), "tried")
