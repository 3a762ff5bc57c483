"""Answers of language models held against their contract: every error at once, references resolved, nothing repaired.

An answer is JSON text: one intent or a list of at most five.  It is read as VARIANT; types, fields and
numbers are rules on paths, rooms are looked up in the plan's, furniture and finishes in the catalogues.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, types
from pyspark.sql import functions as F

from planwright.functions import finishes as X
from planwright.operators.intents import _mentioned, matched_rooms
from planwright.sources import materials
from planwright.sources.furniture import ITEMS

#: Characters, intents, pieces of one kind and of all, and metres of a clearance.
MOST_CHARS, MOST_INTENTS, MOST_OF_ONE, MOST_ITEMS, CLEARANCE = 20_000, 5, 8, 12, (0.3, 2.0)
#: The fields of each intent, and its action.
FIELDS = {
    "fit_furniture": ("intent", "room", "items", "placement", "constraints"), "check_fit": ("intent", "room", "items", "constraints"), "renovate": ("intent", "room", "rooms", "style", "finishes"), "remove_furniture": ("intent", "room", "items"), "describe_room": ("intent", "room"),
}
ACTIONS = {"fit_furniture": "place_furniture"}
FINISHES = (("floor", "floor", "floorMaterialId"), ("walls", "wall", "wallMaterialId"), ("ceiling", "ceiling", "ceilingMaterialId"))
LIGHTING = ("warm", "neutral", "cool", "off")
LISTS = types.ArrayType(types.StringType())


@F.pandas_udf(LISTS)
def _furniture(names: pd.Series) -> pd.Series:
    """The one piece of the catalogue that each name means, or null."""
    known = {i[0] for i in ITEMS}

    def one(name: str | None) -> str | None:
        if name is None or name in known:
            return name
        found = _mentioned(name.replace("-", " ").replace("_", " "))
        return found[0] if len(found) == 1 else None

    return names.map(lambda a: None if a is None else [one(n) for n in a])


def _kind(v: Column) -> Column:
    """STRING, OBJECT, ARRAY, BOOLEAN, BIGINT, DECIMAL, DOUBLE or VOID; null if absent."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _at(path: str, kind: str = "variant", of: str = "v") -> Column:
    return F.try_variant_get(F.col(of), path, kind)


def _text(path: str, of: str = "v") -> Column:
    """A string at a path; null where it is absent or something else."""
    return F.when(_kind(_at(path, of=of)) == "STRING", _at(path, "string", of))


def _told(broken: Column, text: Column | str) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), F.lit(text) if isinstance(text, str) else text)


def _unexpected(of: Column, allowed: Column | tuple, form: str) -> Column:
    """Errors about the fields of an object that aren't allowed."""
    allowed = F.array(*map(F.lit, allowed)) if isinstance(allowed, tuple) else allowed
    keys = F.coalesce(F.json_object_keys(F.to_json(of)), F.array().cast("array<string>"))
    return F.transform(F.array_except(keys, allowed), lambda k: F.format_string(form, k))


def _number(v: Column) -> Column:
    return _kind(v).isin("BIGINT", "DECIMAL", "DOUBLE")


def checked(answers: DataFrame, rooms: DataFrame) -> DataFrame:
    """Each answer with ``ok``, its ``intents`` if all of them are sound, and otherwise all its ``errors``.

    ``answers``: answer_id, plan_id, text, selected_room_id or null; ``rooms``: plan_id, room_id, ord, name, type, area.
    """
    bare = F.regexp_replace(F.trim("text"), r"^```(?:json)?\s*|\s*```$", "")
    read = answers.select("answer_id", "plan_id", "selected_room_id", (F.length("text") > MOST_CHARS).alias("large"), F.try_parse_json(bare).alias("whole"))
    many = F.when(_kind(F.col("whole")) == "ARRAY", F.try_variant_get("whole", "$", "array<variant>")).otherwise(F.array("whole"))
    read = read.withColumn("parts", many)
    said = _told(F.col("large"), "Response too large.")
    for broken, text in ((F.col("whole").isNull(), "Response is not valid JSON."), (F.size("parts") == 0, "No intent returned."), (F.size("parts") > MOST_INTENTS, f"At most {MOST_INTENTS} intents per response.")):
        said = F.coalesce(said, _told(broken, text))
    read = read.withColumn("said", said)
    one = F.struct("ord", F.col("room_id").alias("id"), "name", "type", "area")
    context = rooms.groupBy("plan_id").agg(F.sort_array(F.collect_list(one)).alias("rooms"))
    d = read.where("said IS NULL").select("answer_id", "plan_id", "selected_room_id", F.size("parts").alias("n"), F.posexplode("parts").alias("i", "v"))

    # rooms that intents name: "room" at place -1, members of "rooms" from 0
    listed = F.when(_kind(_at("$.rooms")) == "ARRAY", _at("$.rooms", "array<variant>"))
    refs = F.concat(F.array(F.struct(F.lit(-1).alias("j"), _at("$.room").alias("ref"))), F.coalesce(F.transform(listed, lambda r, j: F.struct(j.alias("j"), r.alias("ref"))), F.array().cast("array<struct<j:int,ref:variant>>")))
    r = d.select("answer_id", "plan_id", "selected_room_id", "i", F.explode(refs).alias("r")).select("answer_id", "plan_id", "selected_room_id", "i", "r.j", "r.ref").join(context, "plan_id", "left")
    name = F.when(_kind(F.col("ref")) == "STRING", F.try_variant_get("ref", "$", "string"))
    r = r.withColumn("name", name).where("name IS NOT NULL")
    exact = F.get(F.filter("rooms", lambda x: (x["id"] == F.col("name")) | (F.lower(x["name"]) == F.lower(F.trim("name")))), 0)["id"]
    meant = matched_rooms(F.lower(F.regexp_replace("name", "[-_]", " ")), F.col("rooms"), F.col("selected_room_id"))
    r = r.withColumn("meant", meant).withColumn("id", F.coalesce(exact, F.when(F.size("meant.ids") == 1, F.get("meant.ids", 0))))
    found = r.groupBy("answer_id", "i").agg(F.map_from_entries(F.collect_list(F.struct("j", "id"))).alias("found"))
    d = d.join(context, "plan_id", "left").join(found, ["answer_id", "i"], "left")

    kind = _text("$.intent")
    d = d.withColumns({"kind": kind, "object": _kind(F.col("v")) == "OBJECT"})
    kind, known = F.col("kind"), F.coalesce(F.col("kind").isin(*FIELDS), F.lit(False))
    of = lambda *kinds: F.coalesce(kind.isin(*kinds), F.lit(False))
    given, no_room = _at("$.room"), F.col("selected_room_id").isNull()
    asks_room = of("fit_furniture", "check_fit", "describe_room") | (of("renovate") & _at("$.rooms").isNull()) | (of("remove_furniture") & given.isNotNull())
    named = F.coalesce(F.trim(_text("$.room")) != "", F.lit(False))
    room = F.when(given.isNull(), F.col("selected_room_id")).otherwise(F.element_at("found", F.lit(-1)))
    ids = F.array_join(F.transform("rooms", lambda x: x["id"]), ", ")
    room_errors = F.when(asks_room, F.array(
        _told(given.isNull() & no_room, '"room" is required.'), _told(given.isNotNull() & ~named, '"room" must be a non-empty string.'),
        _told(given.isNotNull() & named & room.isNull(), F.format_string('Unknown room "%s". Known rooms: %s.', _text("$.room"), ids)),
    ))

    # furniture
    items = F.when(_kind(_at("$.items")) == "ARRAY", _at("$.items", "array<variant>"))
    typed = lambda v: F.when(F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, "$.type", "variant")), "^[A-Z]+", 0) == "STRING", F.try_variant_get(v, "$.type", "string"))
    d = d.withColumn("items", F.when(of("fit_furniture", "check_fit", "remove_furniture"), items)).withColumn("names", F.transform("items", typed)).withColumn("pieces", _furniture("names"))

    def counted(v: Column) -> Column:
        q = F.try_variant_get(v, "$.quantity", "variant")
        n = F.try_variant_get(v, "$.quantity", "double")
        good = _number(q) & (n == F.floor(n)) & n.between(1, MOST_OF_ONE)
        return F.when(q.isNull(), F.lit(1)).when(good, n.cast("int"))

    d = d.withColumn("counts", F.transform("items", counted))
    at = lambda c, j: F.get(c, j)

    def item_errors(v: Column, j: Column) -> Column:
        name = at("names", j)
        extra = _unexpected(v, ("type", "quantity"), 'Unexpected item field "%s".')
        wrong = F.when(at("counts", j).isNull(), F.format_string(f'Quantity for "%s" must be an integer 1–{MOST_OF_ONE}.', name)).when(at("pieces", j).isNull(), F.format_string('Unknown furniture "%s".', name))
        return F.when(name.isNull(), F.array(F.lit('Each item needs a string "type".'))).otherwise(F.concat(extra, F.array_compact(F.array(wrong))))

    pieces = F.flatten(F.transform("items", lambda v, j: F.when(at("names", j).isNotNull() & at("counts", j).isNotNull() & at("pieces", j).isNotNull(), F.array_repeat(at("pieces", j), at("counts", j))).otherwise(F.array().cast("array<string>"))))
    d = d.withColumn("furniture", F.coalesce(pieces, F.array().cast("array<string>")))
    wants = of("fit_furniture", "check_fit", "remove_furniture")
    none = F.col("items").isNull() | (F.size("items") == 0)
    furniture_errors = F.when(wants, F.concat(F.array(_told(none, '"items" must be a non-empty array.')), F.coalesce(F.flatten(F.transform("items", item_errors)), F.array().cast("array<string>")), F.array(_told(F.size("furniture") > MOST_ITEMS, f"At most {MOST_ITEMS} items per request."))))

    # constraints and placement
    limits, low, high = _at("$.constraints"), *CLEARANCE
    clear = lambda k: _at(f"$.constraints.{k}")
    rule_errors = F.when(of("fit_furniture", "check_fit") & limits.isNotNull(), F.when(_kind(limits) != "OBJECT", F.array(F.lit('"constraints" must be an object.'))).otherwise(F.concat(
        _unexpected(limits, ("minimumWalkway", "doorClearance", "keepDoorsClear", "keepWindowsClear"), 'Unexpected constraint "%s".'),
        F.array(*[_told(clear(k).isNotNull() & ~F.coalesce(_number(clear(k)) & _at(f"$.constraints.{k}", "double").between(low, high), F.lit(False)), f"{k} must be a number of metres between {low:g} and {high:g}.") for k in ("minimumWalkway", "doorClearance")]),
        F.array(*[_told(clear(k).isNotNull() & (_kind(clear(k)) != "BOOLEAN"), f"{k} must be true or false.") for k in ("keepDoorsClear", "keepWindowsClear")]),
    )))
    placement = _text("$.placement")
    more = F.array(_told(of("fit_furniture") & _at("$.placement").isNotNull() & ~F.coalesce(placement.isin("longest_wall", "any"), F.lit(False)), '"placement" must be "longest_wall" or "any".'), _told(of("check_fit") & (F.size("furniture") > 1), "check_fit takes a single item."))

    # rooms, style and finishes
    every, list_ = _text("$.rooms") == "all", F.when(_kind(_at("$.rooms")) == "ARRAY", _at("$.rooms", "array<variant>"))
    several = F.when(every, F.transform(F.filter("rooms", lambda x: x["type"] != "storage"), lambda x: x["id"])).when(list_.isNotNull(), F.array_compact(F.transform(list_, lambda _, j: F.element_at("found", j))))
    rooms_errors = F.when(of("renovate"), F.concat(
        F.coalesce(F.array_compact(F.transform(list_, lambda x, j: F.when(F.element_at("found", j).isNull(), F.format_string("Unknown room %s.", F.to_json(x))))), F.array().cast("array<string>")),
        F.array(_told(_at("$.rooms").isNotNull() & ~F.coalesce(every, F.lit(False)) & list_.isNull(), '"rooms" must be an array or "all".')),
    ))
    style = _text("$.style")
    preset = F.lit(None).cast("string")
    for i, n, *_ in X.PRESETS:
        preset = F.when((style == i) | (F.lower(style) == n.lower()), i).otherwise(preset)
    f = _at("$.finishes")
    texture = {k: materials.material_named(_text(f"$.finishes.{k}"), use) for k, use, _ in FINISHES}
    colour, light = _text("$.finishes.wallColor"), _text("$.finishes.lighting")
    bad_colour = _at("$.finishes.wallColor").isNotNull() & ~F.coalesce(colour.rlike("(?i)^#[0-9a-f]{6}$"), F.lit(False))
    bad_light = _at("$.finishes.lighting").isNotNull() & ~F.coalesce(light.isin(*LIGHTING), F.lit(False))
    values = [(field, texture[k]) for k, _, field in FINISHES] + [("wallColor", F.when(~bad_colour, F.lower(colour))), ("lighting", F.when(~bad_light, light))]
    patch = F.when(_kind(f) == "OBJECT", F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k, _ in values]), F.array(*[v for _, v in values])), lambda _, v: v.isNotNull()))
    changes = preset.isNotNull() | F.coalesce(F.size(patch) > 0, F.lit(False))
    look_errors = F.when(of("renovate"), F.concat(
        F.array(_told(_at("$.style").isNotNull() & preset.isNull(), F.format_string("Unknown style %s.", F.to_json(_at("$.style")))), _told(f.isNotNull() & (_kind(f) != "OBJECT"), '"finishes" must be an object.')),
        F.coalesce(F.when(_kind(f) == "OBJECT", _unexpected(f, ("floor", "walls", "wallColor", "ceiling", "lighting"), 'Unexpected finish "%s".')), F.array().cast("array<string>")),
        F.array(*[_told(_at(f"$.finishes.{k}").isNotNull() & texture[k].isNull(), F.format_string(f"Unknown {k} material %s.", F.to_json(_at(f"$.finishes.{k}")))) for k, _, _ in FINISHES]),
        F.array(_told(bad_colour, "wallColor must be a colour like #aabbcc."), _told(bad_light, f"lighting must be one of {', '.join(LIGHTING)}."), _told(~changes, 'renovate needs "style" or "finishes".')),
    ))

    fields = F.create_map(*[x for k, names in FIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, names)))])[kind]
    shape = F.when(~F.col("object"), F.array(F.lit("Intent must be a JSON object."))).when(~known, F.array(F.format_string("Unknown intent %s. Allowed: " + ", ".join(FIELDS) + ".", F.coalesce(F.to_json(_at("$.intent")), F.lit("undefined")))))
    empty = F.array().cast("array<string>")
    keys = F.transform(F.array_except(F.coalesce(F.json_object_keys(F.to_json("v")), empty), fields), lambda k: F.format_string('Unexpected field "%s" for %s.', k, kind))
    whole = F.concat(*[F.coalesce(e, empty) for e in (keys, room_errors, furniture_errors, rule_errors, more, rooms_errors, look_errors)])
    targets = F.when(of("renovate") & _at("$.rooms").isNotNull(), several).when(room.isNotNull(), F.array(room))
    lacking = (of("renovate") & (F.coalesce(F.size(targets), F.lit(0)) <= 0)) | (of("describe_room", "fit_furniture", "check_fit") & room.isNull())
    errors = F.coalesce(shape, F.array_compact(whole))
    errors = F.when((F.size(errors) == 0) & lacking, F.array(F.lit("Incomplete intent."))).otherwise(errors)
    pick = lambda k, then: F.when(of(*k), then)
    rules = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, ("minimumWalkway", "doorClearance", "preserveDoorClearance", "preserveWindowAccess"))), F.array(*[_at(f"$.constraints.{k}", "string") for k in ("minimumWalkway", "doorClearance", "keepDoorsClear", "keepWindowsClear")])), lambda _, x: x.isNotNull())
    action = F.coalesce(F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])[kind], kind)
    intent = F.struct(
        action.alias("action"), targets.alias("room_ids"), pick(("fit_furniture",), F.col("furniture")).alias("all"), pick(("check_fit", "remove_furniture"), F.slice("furniture", 1, 1)).alias("first"), pick(("renovate",), preset).alias("preset"), pick(("renovate",), patch).alias("patch"),
        pick(("fit_furniture",), placement).alias("placement"), pick(("fit_furniture",), F.when(limits.isNotNull(), rules)).alias("constraints"),
    )
    d = d.withColumns({"errors": errors, "intent": intent})
    intent = F.struct("intent.action", "intent.room_ids", F.coalesce("intent.all", "intent.first").alias("furniture"), "intent.preset", "intent.patch", "intent.placement", "intent.constraints")
    told = F.transform("errors", lambda e: F.when(F.col("n") > 1, F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] "), e)).otherwise(e))
    g = d.select("answer_id", "i", told.alias("errors"), intent.alias("intent")).groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct("i", "errors"))).alias("e"), F.array_agg(F.struct("i", "intent")).alias("x"))
    ordered = F.transform(F.array_sort("x", lambda a, b: a["i"] - b["i"]), lambda x: x["intent"])
    g = g.select("answer_id", F.flatten(F.transform("e", lambda x: x["errors"])).alias("errors"), ordered.alias("intents"))
    out = read.select("answer_id", "said").join(g, "answer_id", "left")
    errors = F.when(F.col("said").isNotNull(), F.array("said")).otherwise(F.col("errors"))
    return out.select("answer_id", (F.size(errors) == 0).alias("ok"), F.when(F.size(errors) == 0, F.col("intents")).alias("intents"), errors.alias("errors"))
