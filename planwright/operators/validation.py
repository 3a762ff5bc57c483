"""Validation of apartments: every rule as rows (apartment_id, floor_id, severity, code, kind, entity).

Row rules are one pass over a relation, references are anti-joins, overlaps are self-joins on the floor
or wall with a cheap residual first.  NaN fails every bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwright.functions import geometry as G
from planwright.operators.rules import union_rules
from planwright.sources.lineage import spread

SCHEMA_VERSION = 2
#: Overlap of rooms that is let pass, in square metres, and tolerance of spans on walls.
ROOM_OVERLAP_TOLERANCE, SPAN_TOLERANCE = 0.02, 1e-3
ISSUE = "apartment_id", "floor_id"
Rules = dict[str, tuple[str, Column]]


def _bad(c: Column) -> Column:
    """Not a positive number."""
    return F.coalesce(F.isnan(c) | ~(c > 0), F.lit(True))


def _finite(p: Column) -> Column:
    ok = lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    return ok(p["x"]) & ok(p["z"])


def _found(df: DataFrame, kind: str, rules: Rules) -> DataFrame:
    hits = F.array_compact(F.array(*[F.when(broken, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"))) for c, (s, broken) in rules.items()]))
    return df.select(*ISSUE, F.explode(hits).alias("h"), F.lit(kind).alias("kind"), F.col("id").alias("entity")).select(*ISSUE, "h.severity", "h.code", "kind", "entity")


def _issue(df: DataFrame, severity: str, code: Column | str, kind: Column | str, entity: str = "id") -> DataFrame:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.select(*ISSUE, F.lit(severity).alias("severity"), lit(code).alias("code"), lit(kind).alias("kind"), F.col(entity).alias("entity"))


def id_issues(kinds: dict[str, DataFrame]) -> DataFrame:
    """Missing ids, and every use of an id after its first over all kinds of an apartment.

    ``kinds`` in order of precedence: relations with apartment_id, floor_id, floor_ord, ord, id.
    """
    rows = union_rules(*[d.select(*ISSUE, "floor_ord", F.lit(k).alias("kind_ord"), F.lit(name).alias("kind"), "ord", "id") for k, (name, d) in enumerate(kinds.items())])
    again = F.row_number().over(Window.partitionBy("apartment_id", "id").orderBy("floor_ord", "kind_ord", "ord"))
    missing = F.col("id").isNull() | (F.col("id") == "")
    return union_rules(_issue(rows.where(missing), "error", "missing-id", F.col("kind")), _issue(rows.where(~missing).withColumn("_k", again).where("_k > 1"), "error", "duplicate-id", F.col("kind")))


def apartment_issues(apartments: DataFrame, floors: DataFrame) -> DataFrame:
    """Apartments of another schema version or without floors, and floors without a height."""
    a = apartments.withColumn("floor_id", F.lit(None).cast("string")).withColumn("id", F.col("apartment_id"))
    version = _issue(a.where(~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION))), "error", "schema-version", "apartment")
    bare = _issue(a.join(floors.select("apartment_id").distinct(), "apartment_id", "left_anti"), "error", "no-floors", "apartment")
    return union_rules(version, bare, _found(floors.withColumn("id", F.col("floor_id")), "floor", {"floor-height": ("error", _bad(F.col("height")))}))


def provenance_issues(kinds: dict[str, DataFrame]) -> DataFrame:
    return union_rules(*[_issue(d.where(F.col("sources").isNull()), "error", "missing-provenance", k) for k, d in kinds.items()])


def room_issues(rooms: DataFrame, materials: DataFrame | None = None) -> DataFrame:
    """``rooms``: id, ord, polygon, ceiling_height, material_ids; unknown materials only where a library is given."""
    p = F.col("polygon")
    few = F.size(p) < 3
    wild = ~few & F.exists(p, lambda q: ~_finite(q))
    sound = ~few & ~wild
    close = F.exists(G.edges(p), lambda e: G.distance(e["a"], e["b"]) < 1e-4)
    own = _found(rooms, "room", {
        "room-polygon-vertices": ("error", few), "room-polygon-nan": ("error", wild), "room-area": ("error", sound & (G.area(p) < 0.05)), "room-self-intersection": ("error", sound & G.self_intersects(p)),
        "room-duplicate-vertex": ("error", sound & close), "room-ceiling": ("error", sound & _bad(F.col("ceiling_height"))),
    })
    whole = spread(rooms.where(~few), *ISSUE)
    if materials is not None:
        used = rooms.where(sound).select(*ISSUE, "id", F.explode("material_ids").alias("material_id"))
        own = union_rules(own, _issue(used.join(materials.select("material_id"), "material_id", "left_anti"), "warning", "unknown-material", "room"))
    a = whole.select(*ISSUE, "id", "ord", "polygon", G.bounds(p).alias("b"))
    b = a.select(*ISSUE, F.col("ord").alias("ord2"), F.col("polygon").alias("polygon2"), F.col("b").alias("b2"))
    near = (F.col("b.min_x") < F.col("b2.max_x")) & (F.col("b2.min_x") < F.col("b.max_x")) & (F.col("b.min_z") < F.col("b2.max_z")) & (F.col("b2.min_z") < F.col("b.max_z"))
    pairs = a.join(b, list(ISSUE)).where((F.col("ord") < F.col("ord2")) & near)
    return union_rules(own, _issue(pairs.where(G.approximate_overlap(p, F.col("polygon2")) > ROOM_OVERLAP_TOLERANCE), "error", "room-overlap", "room"))


def wall_issues(walls: DataFrame) -> DataFrame:
    """``walls``: id, ord, start, end, thickness, height."""
    finite = _finite(F.col("start")) & _finite(F.col("end"))
    own = _found(walls, "wall", {
        "wall-nan": ("error", ~finite), "wall-zero-length": ("error", finite & (G.distance(F.col("start"), F.col("end")) < 0.01)),
        "wall-thickness": ("error", _bad(F.col("thickness"))), "wall-height": ("error", _bad(F.col("height"))),
    })
    a = walls.where(finite).select(*ISSUE, "id", "ord", "start", "end", "thickness")
    b = a.select(*ISSUE, *[F.col(c).alias(f"{c}2") for c in ("ord", "start", "end", "thickness")])
    thick = F.greatest("thickness", "thickness2")
    reach = lambda c, f: f(F.col("start")[c], F.col("end")[c])
    other = lambda c, f: f(F.col("start2")[c], F.col("end2")[c])
    near = [(reach(c, F.least) <= other(c, F.greatest) + thick) & (other(c, F.least) <= reach(c, F.greatest) + thick) for c in ("x", "z")]
    shared = G.collinear_overlap(F.col("start"), F.col("end"), F.col("start2"), F.col("end2"), thick / 2)
    pairs = a.join(b, list(ISSUE)).where((F.col("ord") < F.col("ord2")) & near[0] & near[1])
    return union_rules(own, _issue(pairs.where(shared > thick + 0.01), "error", "wall-overlap", "wall"))


def opening_issues(doors: DataFrame, windows: DataFrame, walls: DataFrame) -> DataFrame:
    """``doors``, ``windows``: id, ord, wall_id, offset, width, height (sill_height); doors come before windows."""
    cols = [*ISSUE, "id", "ord", "wall_id", "offset", "width", "height"]
    o = doors.select(*cols, F.lit(0.0).alias("bottom"), F.lit("door").alias("kind"), F.lit(0).alias("rank"))
    o = o.unionByName(windows.select(*cols, F.col("sill_height").alias("bottom"), F.lit("window").alias("kind"), F.lit(1).alias("rank")))
    w = walls.select(*ISSUE, F.col("id").alias("wall_id"), "start", "end", F.col("height").alias("wall_height"))
    missing = o.join(w.select(*ISSUE, "wall_id"), [*ISSUE, "wall_id"], "left_anti")
    placed = o.join(w, [*ISSUE, "wall_id"]).withColumns({"from": F.col("offset") - F.col("width") / 2, "to": F.col("offset") + F.col("width") / 2, "span": G.distance(F.col("start"), F.col("end"))})
    named = lambda rule: F.concat("kind", F.lit(rule))
    rules = {"-width": _bad(F.col("width")), "-height": _bad(F.col("height")), "-outside-wall": (F.col("from") < -1e-3) | (F.col("to") > F.col("span") + 1e-3), "-too-tall": F.col("bottom") + F.col("height") > F.col("wall_height") + 1e-3}
    broken = F.explode(F.array_compact(F.array(*[F.when(c, named(r)) for r, c in rules.items()])))
    per_row = placed.select(*ISSUE, F.lit("error").alias("severity"), broken.alias("code"), "kind", F.col("id").alias("entity"))
    s = placed.select(*ISSUE, "wall_id", "rank", "ord", "from", "to", "id", "kind")
    t = s.select(*ISSUE, "wall_id", *[F.col(c).alias(f"{c}2") for c in ("rank", "ord", "from", "to")])
    later = F.struct("rank2", "ord2") < F.struct("rank", "ord")
    over = s.join(t, [*ISSUE, "wall_id"]).where(later & (F.least("to", "to2") - F.greatest("from", "from2") > SPAN_TOLERANCE))
    return union_rules(
        _issue(missing, "error", named("-missing-wall"), F.col("kind")), per_row, _issue(over, "error", "opening-overlap", F.col("kind")),
        _issue(windows.where(F.col("sill_height") < 0), "error", "window-sill", "window"),
    )


def _in_rooms(df: DataFrame, rooms: DataFrame) -> DataFrame:
    return df.join(rooms.select(*ISSUE, F.col("id").alias("room_id"), F.col("polygon").alias("room_polygon")), [*ISSUE, "room_id"], "left")


def fixture_issues(fixtures: DataFrame, rooms: DataFrame) -> DataFrame:
    """``fixtures``: id, room_id, footprint, height."""
    p = F.col("footprint")
    d = _in_rooms(fixtures, rooms)
    lost = F.col("room_polygon").isNull()
    return _found(d, "fixture", {
        "fixture-footprint": ("error", (F.size(p) < 3) | (G.area(p) < 1e-4)), "fixture-height": ("error", _bad(F.col("height"))), "fixture-no-room": ("warning", lost),
        "fixture-outside-room": ("warning", ~lost & ~G.contains_polygon(F.col("room_polygon"), p, 0.01)),
    })


def furniture_issues(furniture: DataFrame, rooms: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """``furniture``: id, catalog_id, room_id, position, rotation, width, depth, height; each item stops at its first broken rule of shape."""
    d = _in_rooms(furniture, rooms).withColumn("outline", G.oriented_rect(F.col("position"), F.col("width"), F.col("depth"), F.col("rotation")))
    sized = ~(_bad(F.col("width")) | _bad(F.col("depth")) | _bad(F.col("height")))
    placed = sized & _finite(F.col("position")) & F.coalesce(~F.isnan("rotation") & (F.abs("rotation") < float("inf")), F.lit(False))
    lost = F.col("room_polygon").isNull()
    own = _found(d, "furniture", {
        "furniture-dimensions": ("error", ~sized), "furniture-transform": ("error", sized & ~placed), "furniture-missing-room": ("error", placed & lost),
        "furniture-outside-room": ("warning", placed & ~lost & ~G.contains_polygon(F.col("room_polygon"), F.col("outline"), 0.005)),
    })
    if catalog is None:
        return own
    return union_rules(own, _issue(d.where(placed).join(catalog.select("catalog_id"), "catalog_id", "left_anti"), "warning", "furniture-catalog", "furniture"))


def validated(apartments: DataFrame, floors: DataFrame, rooms: DataFrame, walls: DataFrame, doors: DataFrame, windows: DataFrame, fixtures: DataFrame, furniture: DataFrame, materials: DataFrame | None = None, catalog: DataFrame | None = None) -> DataFrame:
    """All issues of all apartments."""
    order = floors.select(*ISSUE, F.col("ord").alias("floor_ord"))
    named = {"floor": floors.select(*ISSUE, F.col("floor_id").alias("id"), F.lit(0).alias("ord")), "room": rooms, "wall": walls, "door": doors, "window": windows, "fixture": fixtures, "furniture": furniture}
    return union_rules(
        apartment_issues(apartments, floors),
        id_issues({k: d.select(*ISSUE, "ord", "id").join(order, list(ISSUE)) for k, d in named.items()}),
        provenance_issues({"wall": walls, "door": doors, "window": windows, "room": rooms, "fixture": fixtures}),
        room_issues(rooms, materials), wall_issues(walls), opening_issues(doors, windows, walls), fixture_issues(fixtures, rooms), furniture_issues(furniture, rooms, catalog),
    )


def verdicts(apartments: DataFrame, issues: DataFrame) -> DataFrame:
    """Whether each apartment is without errors, with its counts of errors and warnings."""
    g = issues.groupBy("apartment_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    d = apartments.select("apartment_id").join(g, "apartment_id", "left").fillna(0, ["errors", "warnings"])
    return d.withColumn("ok", F.col("errors") == 0)
