"""Annotation files: strict checks of their JSON, scaling, and plans drawn as SVG."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most elements of a list, points of a polygon, characters of a text and errors reported; greatest coordinate.
MOST_ELEMENTS, MOST_POINTS, MOST_TEXT, MOST_ERRORS, MOST_PX = 2000, 500, 300, 50, 20_000.0
#: Fields of an annotation set, and those that must be there.
FIELDS = ("formatVersion", "id", "name", "building", "floorLabel", "level", "source", "image", "originPx", "reportedArea", "internalEnvelope", "footprint", "compass", "calibration", "defaults", "walls", "doors", "windows", "rooms", "fixtures", "labels", "drawingNotes", "inferredBoundaries")
REQUIRED = ("formatVersion", "id", "name", "level", "source", "image", "originPx", "footprint", "defaults", "walls", "doors", "windows", "rooms", "fixtures", "drawingNotes")
#: Kinds of elements.
ROOM_TYPES = ("living", "kitchen", "kitchen-living", "dining", "bedroom", "bathroom", "toilet", "hall", "balcony", "storage", "utility", "unknown")
WALL_KINDS = ("exterior", "interior", "railing")
DOOR_KINDS = ("hinged", "double", "sliding", "bifold", "opening")
WINDOW_KINDS = ("standard", "large", "sliding-door", "balcony-door")
FIXTURE_KINDS = ("bath", "shower", "toilet", "basin", "kitchen-counter", "sink", "hob", "built-in-unit", "column", "shaft")
#: Per list its fields (none: any), texts, choices, numbers that may be missing, and shapes.
LISTS: dict[str, dict] = {
    "walls": {"fields": ("id", "kind", "confidence", "note", "rect", "segment"), "texts": ("id",), "choices": {"kind": WALL_KINDS}, "ranges": {"confidence": (0, 1)}, "shape": ("rect", "segment")},
    "doors": {
        "fields": ("id", "wallId", "span", "kind", "hinge", "swing", "swingConfidence", "label", "heightMeters", "heightFromPlan", "confidence", "note"), "texts": ("id", "wallId"),
        "choices": {"kind": DOOR_KINDS, "hinge": ("min", "max"), "swing": ("up", "down", "left", "right")}, "ranges": {"swingConfidence": (0, 1), "heightMeters": (0.5, 5), "confidence": (0, 1)}, "span": True,
    },
    "windows": {"fields": ("id", "wallId", "span", "kind", "sillHeightMeters", "headHeightMeters", "heightsFromPlan", "confidence", "note"), "texts": ("id", "wallId"), "choices": {"kind": WINDOW_KINDS}, "ranges": {"confidence": (0, 1)}, "span": True},
    "rooms": {
        "fields": ("id", "name", "type", "labelSource", "label", "labelId", "polygon", "dimensions", "exterior", "confidence", "note", "geometryConfidence", "labelConfidence", "classificationConfidence", "classification"), "texts": ("id", "name"),
        "choices": {"type": ROOM_TYPES, "labelSource": ("plan-label", "inferred", "unknown")}, "ranges": {"geometryConfidence": (0, 1), "labelConfidence": (0, 1), "classificationConfidence": (0, 1), "confidence": (0, 1)}, "polygon": True,
    },
    "fixtures": {"texts": ("id", "label", "materialId"), "choices": {"kind": FIXTURE_KINDS}, "numbers": {"heightMeters": (0, 5)}, "ranges": {"confidence": (0, 1)}, "shape": ("rect", "polygon")},
    "labels": {"texts": ("id", "text"), "choices": {"role": ("room-name", "dimension", "title", "other")}},
    "drawingNotes": {"texts": ("id", "message")},
    "inferredBoundaries": {"texts": ("id", "reason")},
}


def _each(found: Column, text: Column | str) -> Column:
    return F.transform(found, lambda k: F.concat(F.lit(text) if isinstance(text, str) else text, k))


def _outside(value: Column, low: float, high: float) -> Column:
    return F.coalesce(F.isnan(value) | (value < low) | (value > high), F.lit(True))


def _points_broken(raw: Column, least: int) -> Column:
    points = F.from_json(raw, "array<struct<x:double,y:double>>")
    off = F.exists(points, lambda p: _outside(p["x"], -MOST_PX, MOST_PX) | _outside(p["y"], -MOST_PX, MOST_PX))
    return F.coalesce((F.size(points) < least) | (F.size(points) > MOST_POINTS) | off, F.lit(True))


def _element(rules: dict, e: Column, name: Column) -> Column:
    """Errors of one element, which is a JSON object as text."""
    keys = F.coalesce(F.json_object_keys(e), F.array().cast("array<string>"))
    field = lambda f: F.get_json_object(e, f"$.{f}")
    broken = [(f, F.coalesce((F.length(field(f)) < 1) | (F.length(field(f)) > MOST_TEXT), F.lit(True))) for f in rules.get("texts", ())]
    broken += [(f, ~F.coalesce(field(f).isin(*values), F.lit(False))) for f, values in rules.get("choices", {}).items()]
    broken += [(f, _outside(field(f).try_cast("double"), *bounds)) for f, bounds in rules.get("numbers", {}).items()]
    broken += [(f, F.array_contains(keys, f) & _outside(field(f).try_cast("double"), *bounds)) for f, bounds in rules.get("ranges", {}).items()]
    if rules.get("span"):
        span = F.from_json(field("span"), "array<double>")
        broken.append(("span", F.coalesce((F.size(span) != 2) | F.exists(span, lambda v: _outside(v, -MOST_PX, MOST_PX)), F.lit(True))))
    if rules.get("polygon"):
        broken.append(("polygon", _points_broken(field("polygon"), 3)))
    if "shape" in rules:
        first, second = rules["shape"]
        box = F.from_json(field("rect"), "struct<x0:double,y0:double,x1:double,y1:double>")
        wrong = F.coalesce(_outside(box["x0"], -MOST_PX, MOST_PX) | _outside(box["y0"], -MOST_PX, MOST_PX) | _outside(box["x1"], -MOST_PX, MOST_PX) | _outside(box["y1"], -MOST_PX, MOST_PX), F.lit(True))
        other = _points_broken(field("polygon"), 3) if second == "polygon" else ~F.array_contains(keys, second)
        broken.append((f"{first} or {second}", F.when(F.array_contains(keys, first), wrong).otherwise(other)))
    own = F.array_compact(F.array(*[F.when(bad, F.concat(name, F.lit(f))) for f, bad in broken]))
    if "fields" not in rules:
        return own
    return F.concat(_each(F.array_except(keys, F.array(*map(F.lit, rules["fields"]))), F.concat(name, F.lit("unexpected field "))), own)


def _numbered(name: str, rules: dict):
    """The check of a list's elements, each named by its place."""

    def check(e: Column, i: Column) -> Column:
        return _element(rules, e, F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]: ")))

    return check


def checked(files: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Errors of each annotation file: (id, ok, errors); nothing is repaired, all are reported together up to a bound."""
    raw = F.col(json_col)
    keys = F.json_object_keys(raw)
    top = F.concat(_each(F.array_except(keys, F.array(*map(F.lit, FIELDS))), "unexpected field "), _each(F.array_except(F.array(*map(F.lit, REQUIRED)), keys), "missing field "))
    listed = []
    for name, rules in LISTS.items():
        items = F.from_json(F.get_json_object(raw, f"$.{name}"), "array<string>")
        size = F.array_compact(F.array(F.when(F.array_contains(keys, name) & F.coalesce(F.size(items) > MOST_ELEMENTS, F.lit(True)), F.lit(f"{name}: expected an array"))))
        listed += [size, F.flatten(F.transform(F.coalesce(items, F.array().cast("array<string>")), _numbered(name, rules)))]
    errors = F.when(keys.isNull(), F.array(F.lit("not a JSON object"))).otherwise(F.concat(top, *listed))
    d = files.select(F.col(id_col).alias("id"), errors.alias("all"))
    return d.select("id", (F.size("all") == 0).alias("ok"), F.slice("all", 1, MOST_ERRORS).alias("errors"))


def scaled(polygon: Column, k: Column) -> Column:
    """Pixel coordinates times a factor."""
    return F.transform(polygon, lambda p: F.struct((p["x"] * k).alias("x"), (p["z"] * k).alias("z")))


def svg(shapes: DataFrame, width: int, height: int) -> DataFrame:
    """One SVG text per plan from its polygons (plan_id, ord, polygon, fill)."""
    points = F.array_join(F.transform("polygon", lambda p: F.concat_ws(",", p["x"].cast("string"), p["z"].cast("string"))), " ")
    shape = F.concat(F.lit('<polygon points="'), points, F.lit('" fill="'), F.col("fill"), F.lit('"/>'))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", shape.alias("s")))), lambda x: x["s"]), "\n")
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">\n'
    return shapes.groupBy("plan_id").agg(F.concat(F.lit(head), body, F.lit("\n</svg>")).alias("svg"))
