"""Annotated plans in pixels: wall geometry, checks before use, and reconstruction in metres.

Points are structs (x, z) as everywhere, with the image's y, which points down, in z.  Relations carry
``plan_id`` and ``ord``, the order in the annotation file:

plans: plan_id, format_version, method, origin, width_px, height_px, footprint, envelope, manual_ppm,
estimated_ppm, estimated_basis, reported_m2, and the default heights ceiling_m, door_m, railing_m, sill_m, head_m;
walls: id, kind, rect (x0, y0, x1, y1), segment (a, b, thickness), confidence;
doors: id, wall_id, span_from, span_to, kind, hinge, swing, height_m, height_from_plan, label, confidence;
windows: id, wall_id, span_from, span_to, kind, sill_m, head_m, heights_from_plan, confidence;
rooms: id, name, type, label_source, label_id, polygon, exterior, confidence;
fixtures: id, kind, label, rect, polygon, height_m, elevation_m, material_id, uncertain, confidence;
labels: id, text, confidence; dimensions: id, room_id, meters, axis, span_from, span_to, a, b.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwright.functions import geometry as G
from planwright.operators.rules import union_rules
from planwright.operators.zones import topology

#: Format, slack of spans in pixels, least share of a swing across its wall.
FORMAT_VERSION, SLACK, ACROSS = 1, 0.5, 0.3
#: Directions a door swings to on the image, and materials of walls by kind.
DIRECTION = {"up": (0.0, -1.0), "down": (0.0, 1.0), "left": (-1.0, 0.0), "right": (1.0, 0.0)}
WALL_MATERIAL = {"exterior": "exterior-render", "interior": "paint-white", "railing": "railing-glass"}
HEIGHTS = ("ceiling_m", "door_m", "railing_m", "head_m")


def _positive(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (c > 0), F.lit(False))


def _finite(p: Column) -> Column:
    ok = lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    return ok(p["x"]) & ok(p["z"])


def wall_geometry(walls: DataFrame) -> DataFrame:
    """``walls`` with a, b, thickness_px, length_px, dir and dominant; all null where a wall has no usable geometry.

    A rectangle's centre line runs along its longer side; lines point along their dominant axis.
    """
    r, s = F.col("rect"), F.col("segment")
    w, h = r["x1"] - r["x0"], r["y1"] - r["y0"]
    mid_x, mid_y = (r["x0"] + r["x1"]) / 2, (r["y0"] + r["y1"]) / 2
    flat = _positive(w) & _positive(h)
    line = F.when(w >= h, F.struct(G.point(r["x0"], mid_y).alias("a"), G.point(r["x1"], mid_y).alias("b"), h.alias("t"))).otherwise(F.struct(G.point(mid_x, r["y0"]).alias("a"), G.point(mid_x, r["y1"]).alias("b"), w.alias("t")))
    drawn = F.when(r.isNotNull(), F.when(flat, line)).otherwise(F.when(s.isNotNull(), F.struct(s["a"].alias("a"), s["b"].alias("b"), s["thickness"].alias("t"))))

    def measured(g: Column) -> Column:
        v = G.sub(g["b"], g["a"])

        def turned(m: Column) -> Column:
            along_x = F.abs(m["v"]["x"]) >= F.abs(m["v"]["z"])
            back = F.when(along_x, m["v"]["x"]).otherwise(m["v"]["z"]) < 0
            ends = F.struct(F.when(back, g["b"]).otherwise(g["a"]).alias("a"), F.when(back, g["a"]).otherwise(g["b"]).alias("b"))
            dominant = F.when(along_x, "x").otherwise("y")
            whole = lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), g["t"].alias("thickness_px"), m["l"].alias("length_px"), dominant.alias("dominant"), G.scale(G.sub(e["b"], e["a"]), 1 / m["l"]).alias("dir"))
            return F.when(_positive(m["l"]) & _positive(g["t"]), G.let(ends, whole))

        return G.let(F.struct(v.alias("v"), G.length(v).alias("l")), turned)

    # one column with each step computed once: as columns of their own, Spark repeats every step within the next
    d = walls.withColumn("_g", G.let(drawn, measured))
    return d.withColumns({k: F.col(f"_g.{k}") for k in ("a", "b", "thickness_px", "length_px", "dominant", "dir")}).drop("_g")


def kept(df: DataFrame) -> DataFrame:
    """A relation that several others are made from, computed once; it also keeps their plans apart."""
    return df.persist()


def _on_walls(openings: DataFrame, geometry: DataFrame) -> DataFrame:
    """Openings with their wall's geometry and their span along it, in pixels."""
    g = geometry.where("length_px IS NOT NULL").select("plan_id", F.col("id").alias("wall_id"), "a", "dir", "dominant", "length_px")
    d = openings.join(g, ["plan_id", "wall_id"])
    slope, origin = F.when(F.col("dominant") == "x", F.col("dir.x")).otherwise(F.col("dir.z")), F.when(F.col("dominant") == "x", F.col("a.x")).otherwise(F.col("a.z"))
    return d.withColumns({"from": (F.least("span_from", "span_to") - origin) / slope, "to": (F.greatest("span_from", "span_to") - origin) / slope})


def _across(swing: Column) -> Column:
    """How far a swing points along the wall's normal."""
    table = F.create_map(*[x for k, (x, z) in DIRECTION.items() for x in (F.lit(k), G.point(F.lit(x), F.lit(z)))])
    s = table[swing]
    return s["x"] * -F.col("dir.z") + s["z"] * F.col("dir.x")


def dimension_px(d: DataFrame) -> DataFrame:
    """``d`` with ``px``, a dimension's length on the image."""
    return d.withColumn("px", F.when(F.col("axis").isNotNull(), F.abs(F.col("span_to") - F.col("span_from"))).otherwise(G.distance(F.col("a"), F.col("b"))))


def _rows(df: DataFrame, element: str | None, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    hits = F.array_compact(F.array(*[F.when(broken, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"))) for c, (s, broken) in rules.items()]))
    name = F.col(element) if element else F.lit(None)
    return df.select("plan_id", F.explode(hits).alias("h"), name.cast("string").alias("element_id")).select("plan_id", "h.severity", "h.code", "element_id")


def _polygon_rules(what: str, p: Column, width: Column, height: Column) -> dict[str, tuple[str, Column]]:
    sound = (F.size(p) >= 3) & F.forall(p, _finite)
    off = F.exists(p, lambda q: (q["x"] < 0) | (q["z"] < 0) | (q["x"] > width) | (q["z"] > height))
    return {f"{what}-polygon": ("error", ~sound), f"{what}-area": ("error", sound & (G.area(p) < 1)), f"{what}-self-intersection": ("error", sound & G.self_intersects(p)), f"{what}-outside-image": ("warning", sound & off)}


def annotation_issues(plans: DataFrame, walls: DataFrame, doors: DataFrame, windows: DataFrame, rooms: DataFrame, fixtures: DataFrame, labels: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Every problem of every plan at once: (plan_id, severity, code, element_id)."""
    size = plans.select("plan_id", "width_px", "height_px")
    whole = _rows(plans, None, {
        "format-version": ("error", ~F.col("format_version").eqNullSafe(F.lit(FORMAT_VERSION))), "image-size": ("error", ~(_positive(F.col("width_px")) & _positive(F.col("height_px")))),
        "origin": ("error", ~_finite(F.col("origin"))), "manual-scale": ("error", F.col("manual_ppm").isNotNull() & ~_positive(F.col("manual_ppm"))),
    })
    low = F.explode(F.array_compact(F.array(*[F.when(~_positive(F.col(h)), F.lit(h)) for h in HEIGHTS])))
    heights = plans.select("plan_id", low.alias("element_id")).select("plan_id", F.lit("error").alias("severity"), F.lit("default-height").alias("code"), F.lit(None).cast("string").alias("element_id"))

    kinds = (walls, doors, windows, rooms, fixtures, labels)
    every = union_rules(*[d.select("plan_id", F.lit(k).alias("kind_ord"), "ord", "id", F.col("confidence").cast("double").alias("confidence")) for k, d in enumerate(kinds)])
    again = F.row_number().over(Window.partitionBy("plan_id", "id").orderBy("kind_ord", "ord"))
    share = F.col("confidence")
    ids = _rows(every.withColumn("_k", again), "id", {"duplicate-id": ("error", F.col("_k") > 1), "confidence-range": ("error", share.isNotNull() & (F.isnan(share) | (share < 0) | (share > 1)))})

    g = kept(wall_geometry(walls))
    shapes = _rows(g, "id", {"wall-geometry": ("error", F.col("length_px").isNull())})
    cols = ["plan_id", "id", "ord", "wall_id", "span_from", "span_to"]
    openings = doors.select(*cols, F.lit(0).alias("rank"), "kind", "swing").unionByName(windows.select(*cols, F.lit(1).alias("rank"), F.lit("opening").alias("kind"), F.lit(None).cast("string").alias("swing")))
    placed = kept(_on_walls(openings, g))
    missing = openings.join(g.where("length_px IS NOT NULL").select("plan_id", F.col("id").alias("wall_id")).distinct(), ["plan_id", "wall_id"], "left_anti")
    spans = _rows(placed, "id", {
        "opening-empty": ("error", ~(F.col("to") - F.col("from") > 0)), "opening-outside-wall": ("error", (F.col("from") < -SLACK) | (F.col("to") > F.col("length_px") + SLACK)),
        "door-swing": ("error", (F.col("rank") == 0) & (F.col("kind") != "opening") & (F.abs(_across(F.col("swing"))) < ACROSS)),
    })
    other = placed.select("plan_id", "wall_id", *[F.col(c).alias(f"{c}2") for c in ("rank", "ord", "from", "to")])
    over = placed.join(other, ["plan_id", "wall_id"]).where((F.struct("rank2", "ord2") < F.struct("rank", "ord")) & (F.least("to", "to2") - F.greatest("from", "from2") > SLACK))
    sill = windows.join(plans.select("plan_id", F.col("sill_m").alias("_sill"), F.col("head_m").alias("_head")), "plan_id")
    low_head = _rows(sill, "id", {"window-heights": ("error", ~((F.coalesce("head_m", "_head") > F.coalesce("sill_m", "_sill")) & (F.coalesce("sill_m", "_sill") >= 0)))})

    w, h = F.col("width_px"), F.col("height_px")
    outlines = _rows(rooms.join(size, "plan_id"), "id", _polygon_rules("room", F.col("polygon"), w, h))
    lost = rooms.where(F.col("label_id").isNotNull()).join(labels.select("plan_id", F.col("id").alias("label_id")), ["plan_id", "label_id"], "left_anti")
    boxed = F.col("rect").isNotNull()
    r = F.col("rect")
    fitted = fixtures.join(size, "plan_id")
    boxes = _rows(fitted, "id", {"fixture-rect": ("error", boxed & ~((r["x1"] > r["x0"]) & (r["y1"] > r["y0"]))), "fixture-height": ("error", ~_positive(F.col("height_m")))})
    drawn = _rows(fitted.where(~boxed), "id", _polygon_rules("fixture", F.col("polygon"), w, h))
    rims = [_rows(plans.where(F.size(c) > 0).withColumn("element", F.lit(c)), "element", _polygon_rules(what, F.col(c), w, h)) for what, c in (("footprint", "footprint"), ("envelope", "envelope"))]

    d = dimension_px(dimensions)
    lengths = _rows(d, "id", {"dimension": ("error", ~(_positive(F.col("meters")) & _positive(F.col("px"))))})
    scale = plans.join(d.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n")), "plan_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bare, guess = F.col("manual_ppm").isNull(), F.col("estimated_ppm").isNotNull()
    scales = _rows(scale, None, {"no-scale": ("error", (F.col("n") == 0) & bare & ~guess), "single-scale-reference": ("warning", (F.col("n") == 1) & bare)})
    # an estimate that is no number is an error of the same code as the warning that it is one
    wrong = _rows(scale, None, {"estimated-scale": ("error", guess & ~_positive(F.col("estimated_ppm")))})
    rough = _rows(scale, None, {"estimated-scale": ("warning", (F.col("n") == 0) & bare & guess)})
    flag = lambda df, code: df.select("plan_id", F.lit("error").alias("severity"), F.lit(code).alias("code"), F.col("id").cast("string").alias("element_id"))
    return union_rules(whole, heights, ids, shapes, flag(missing, "opening-wall"), spans, flag(over, "opening-overlap"), low_head, outlines, flag(lost, "room-label-ref"), boxes, drawn, *rims, lengths, scales, wrong, rough)


def reconstructed(plans: DataFrame, scales: DataFrame, walls: DataFrame, doors: DataFrame, windows: DataFrame, rooms: DataFrame, fixtures: DataFrame) -> dict[str, DataFrame]:
    """Plans in metres: relations walls, doors, windows, rooms and fixtures, with provenance and topology.

    ``scales``: plan_id, ppm, as calibration gives it; plans without a scale, or not to be used for their
    errors, are left out by an inner join with it.  Swing sides follow the drawn swing on the wall's
    normal; rooms without a readable label stay unknown; names read by software are never ``plan-label``.
    """
    p = plans.join(scales.select("plan_id", "ppm"), "plan_id").withColumn("drawn", F.when(F.col("method") == "automatic", "detected").otherwise("plan-geometry"))
    top = p.select("plan_id", "ppm", "origin", "drawn", "method", *[F.col(h).alias(f"default_{h}") for h in (*HEIGHTS, "sill_m")])
    metres = lambda c: F.col(c) / F.col("ppm")
    world = lambda q: G.plan_to_world(q, F.col("origin"), F.col("ppm"))
    source = lambda **kinds: F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))])
    drawn = F.col("drawn")

    g = kept(wall_geometry(walls))
    material = F.create_map(*[F.lit(x) for pair in WALL_MATERIAL.items() for x in pair])
    w = g.where("length_px IS NOT NULL").join(top, "plan_id").select(
        F.col("plan_id").alias("floor_id"), F.col("id").alias("wall_id"), "ord", world(F.col("a")).alias("start"), world(F.col("b")).alias("end"), metres("thickness_px").alias("thickness"),
        F.when(F.col("kind") == "railing", F.col("default_railing_m")).otherwise(F.col("default_ceiling_m")).alias("height"), "kind", material[F.col("kind")].alias("material_id"),
        source(geometry=drawn, height="assumed").alias("sources"), "confidence",
    )
    where = [F.col("plan_id").alias("floor_id"), "id", "ord", "wall_id", ((F.col("from") + F.col("to")) / 2 / F.col("ppm")).alias("offset"), ((F.col("to") - F.col("from")) / F.col("ppm")).alias("width")]
    d = _on_walls(doors, g).join(top, "plan_id").select(
        *where, F.coalesce("height_m", "default_door_m").alias("height"), "kind", F.when(F.col("hinge") == "min", "start").otherwise("end").alias("hinge"),
        F.when(_across(F.col("swing")) >= 0, 1).otherwise(-1).alias("swing_side"), F.lit("wood-white").alias("material_id"), F.col("label").alias("note"),
        source(geometry=drawn, height=F.when(F.col("height_from_plan"), "plan-label").otherwise("assumed"), swing=F.when(F.col("kind") == "opening", "inferred").otherwise(drawn)).alias("sources"), "confidence",
    )
    sill, head = F.coalesce("sill_m", "default_sill_m"), F.coalesce("head_m", "default_head_m")
    printed = F.when(F.col("heights_from_plan"), "plan-label").otherwise("assumed")
    v = _on_walls(windows, g).join(top, "plan_id").select(*where, (head - sill).alias("height"), sill.alias("sill_height"), "kind", F.lit("upvc-white").alias("material_id"), source(geometry=drawn, sillHeight=printed, height=printed).alias("sources"), "confidence")

    unknown, auto = F.col("label_source") == "unknown", F.col("method") == "automatic"
    label = F.when(F.col("label_source") == "plan-label", F.when(auto, "ocr").otherwise("plan-label")).otherwise("inferred")
    typed = F.when(~unknown & (F.col("type") != "unknown") & auto, F.when(F.col("label_source") == "plan-label", label).otherwise("inferred"))
    named = F.when(auto & ~unknown, label)
    r = rooms.join(top, "plan_id").select(
        F.col("plan_id").alias("floor_id"), F.col("id").alias("room_id"), "ord", F.when(unknown, "Unknown Room").otherwise(F.col("name")).alias("name"), F.when(unknown, "unknown").otherwise(F.col("type")).alias("type"),
        label.alias("label_source"), F.transform("polygon", world).alias("polygon"), F.col("default_ceiling_m").alias("ceiling_height"), F.coalesce("exterior", F.lit(False)).alias("exterior"),
        F.map_filter(source(geometry=drawn, ceilingHeight="assumed", name=named, type=typed), lambda k, x: x.isNotNull()).alias("sources"), "confidence",
    )
    box = F.col("rect")
    corners = F.array(G.point(box["x0"], box["y0"]), G.point(box["x1"], box["y0"]), G.point(box["x1"], box["y1"]), G.point(box["x0"], box["y1"]))
    r = kept(r)
    f = fixtures.join(top, "plan_id").withColumn("footprint", F.transform(F.when(box.isNotNull(), corners).otherwise(F.col("polygon")), world)).withColumn("at", G.centroid(F.col("footprint")))
    inside = f.select("plan_id", "id", "at").join(r.select(F.col("floor_id").alias("plan_id"), "room_id", F.col("ord").alias("room_ord"), F.col("polygon").alias("room_polygon")), "plan_id").where(G.strictly_contains(F.col("room_polygon"), F.col("at")))
    f = f.join(inside.groupBy("plan_id", "id").agg(F.min_by("room_id", "room_ord").alias("room_id")), ["plan_id", "id"], "left").select(
        F.col("plan_id").alias("floor_id"), "id", "ord", "room_id", "kind", "label", "footprint", F.col("height_m").alias("height"), F.coalesce("elevation_m", F.lit(0.0)).alias("elevation"), "material_id",
        source(footprint=F.when(F.col("uncertain"), "inferred").otherwise(drawn), height="assumed").alias("sources"), "confidence",
    )
    w, d, v = map(kept, (w, d, v))
    linked_doors, linked_rooms = topology(r, w, d, v)
    return {"walls": w, "doors": linked_doors, "windows": v, "rooms": linked_rooms, "fixtures": f}


def reconstruction_notes(plans: DataFrame, scales: DataFrame, made: dict[str, DataFrame]) -> DataFrame:
    """Notes on reconstructed plans: (plan_id, severity, code, element_id).

    Inferred labels, doors that connect nothing, rooms without a door, the printed area against the
    measured one, and how the scale was found (``scales`` with method: dimension-labels, reference,
    estimated or manual).
    """
    def note(df: DataFrame, severity: Column | str, code: Column | str, element: str | None) -> DataFrame:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return df.select(F.col("floor_id").alias("plan_id"), lit(severity).alias("severity"), lit(code).alias("code"), (F.col(element) if element else F.lit(None)).cast("string").alias("element_id"))

    s = scales.withColumnRenamed("plan_id", "floor_id")
    how = F.when(F.col("method").isin("dimension-labels", "reference"), "scale-calibrated").when(F.col("method") == "estimated", "scale-estimated").otherwise("scale-manual")
    grade = F.when(F.col("method").isin("dimension-labels", "reference"), "info").otherwise("warning")
    rooms, doors = made["rooms"], made["doors"]
    area = plans.join(scales.select("plan_id", "ppm"), "plan_id").where("reported_m2 IS NOT NULL AND envelope IS NOT NULL").withColumn("gap", G.area(F.col("envelope")) / (F.col("ppm") * F.col("ppm")) / F.col("reported_m2") - 1).withColumnRenamed("plan_id", "floor_id")
    return union_rules(
        note(s, grade, how, None), note(rooms.where("label_source = 'inferred'"), "info", "room-label-inferred", "room_id"),
        note(doors.where("negative IS NULL AND positive IS NULL"), "warning", "door-unconnected", "id"), note(rooms.where("door_ids IS NULL"), "warning", "room-no-door", "room_id"),
        note(area, F.when(F.abs("gap") <= 0.05, "info").otherwise("warning"), "area-cross-check", None),
    )
