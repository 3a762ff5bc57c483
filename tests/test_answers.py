"""Answers of language models against their contract."""

import json

from pyspark.sql import functions as F

from planwright.operators import answers
from planwright.sources import materials

ROOMS = [("kitchen-living", "Kitchen / Living", "kitchen-living", 28.0), ("bedroom-1", "Bedroom 1", "bedroom", 14.0), ("hall", "Hall", "hall", 6.0), ("bathroom", "Bathroom", "bathroom", 5.0), ("cupboard", "Cupboard", "storage", 1.0)]
KNOWN = "Known rooms: " + ", ".join(r[0] for r in ROOMS) + "."
FIT = {"intent": "fit_furniture", "room": "hall", "items": [{"type": "plant"}]}
GOOD = [
    ({"intent": "fit_furniture", "room": "living-room", "items": [{"type": "three-seat-sofa", "quantity": 1}, {"type": "coffee-table"}], "constraints": {"minimumWalkway": 0.7}}, [("place_furniture", ["kitchen-living"], ["sofa-3", "coffee-table"], None, None, None, {"minimumWalkway": "0.7"})]),
    ('```json\n{"intent":"describe_room","room":"bathroom"}\n```', [("describe_room", ["bathroom"], None, None, None, None, None)]),
    ({"intent": "check_fit", "room": "bedroom 1", "items": [{"type": "king size bed"}]}, [("check_fit", ["bedroom-1"], ["bed-king"], None, None, None, None)]),
    (FIT | {"placement": "any", "constraints": {"keepDoorsClear": True}, "items": [{"type": "plant", "quantity": 3}]}, [("place_furniture", ["hall"], ["plant"] * 3, None, None, "any", {"preserveDoorClearance": "true"})]),
    ({"intent": "renovate", "rooms": "all", "style": "Classic Luxe"}, [("renovate", ["kitchen-living", "bedroom-1", "hall", "bathroom"], None, "classic-luxe", None, None, None)]),
    ({"intent": "renovate", "rooms": ["hall", "bedroom"], "finishes": {"floor": "Walnut", "wallColor": "#AABBCC", "lighting": "off"}}, [("renovate", ["hall", "bedroom-1"], None, None, {"floorMaterialId": "floor-walnut", "wallColor": "#aabbcc", "lighting": "off"}, None, None)]),
    ([{"intent": "remove_furniture", "items": [{"type": "desk"}]}, {"intent": "describe_room", "room": "HALL "}], [("remove_furniture", None, ["desk"], None, None, None, None), ("describe_room", ["hall"], None, None, None, None, None)]),
]
BAD = [
    ('Sure! {"intent":"describe_room","room":"bathroom"}', ["Response is not valid JSON."]), ("x" * 30_000, ["Response too large."]), ([], ["No intent returned."]), ([FIT] * 6, ["At most 5 intents per response."]), ([7], ["Intent must be a JSON object."]),
    ({"intent": "delete_walls"}, ['Unknown intent "delete_walls". Allowed: fit_furniture, check_fit, renovate, remove_furniture, describe_room.']), ({"room": "hall"}, ["Unknown intent undefined. Allowed: fit_furniture, check_fit, renovate, remove_furniture, describe_room."]),
    ({"intent": "describe_room", "room": "bathroom", "script": "x"}, ['Unexpected field "script" for describe_room.']), ({"intent": "describe_room", "room": "garage"}, [f'Unknown room "garage". {KNOWN}']), ({"intent": "describe_room"}, ['"room" is required.']), ({"intent": "describe_room", "room": 5}, ['"room" must be a non-empty string.']),
    (FIT | {"items": [{"type": "grand piano"}]}, ['Unknown furniture "grand piano".']), (FIT | {"items": []}, ['"items" must be a non-empty array.']), (FIT | {"items": [{"type": "plant", "quantity": 500}, {"kind": 1}, {"type": "plant", "size": 2}]}, ['Quantity for "plant" must be an integer 1–8.', 'Each item needs a string "type".', 'Unexpected item field "size".']),
    (FIT | {"items": [{"type": "plant", "quantity": 8}, {"type": "desk", "quantity": 5}]}, ["At most 12 items per request."]), (FIT | {"constraints": {"minimumWalkway": -1, "keepDoorsClear": "yes", "speed": 1}}, ['Unexpected constraint "speed".', "minimumWalkway must be a number of metres between 0.3 and 2.", "keepDoorsClear must be true or false."]),
    (FIT | {"placement": "roof"}, ['"placement" must be "longest_wall" or "any".']), (FIT | {"intent": "check_fit", "items": [{"type": "plant", "quantity": 2}]}, ["check_fit takes a single item."]),
    ({"intent": "renovate", "room": "hall", "finishes": {"floor": "lava", "gloss": 1, "lighting": "disco"}}, ['Unexpected finish "gloss".', 'Unknown floor material "lava".', "lighting must be one of warm, neutral, cool, off.", 'renovate needs "style" or "finishes".']),
    ({"intent": "renovate", "rooms": ["hall", "garage", 3], "style": "baroque"}, ['Unknown room "garage".', "Unknown room 3.", 'Unknown style "baroque".', 'renovate needs "style" or "finishes".']), ({"intent": "renovate", "rooms": 4, "style": "industrial"}, ['"rooms" must be an array or "all".']),
    ({"intent": "fit_furniture", "room": "garage", "items": [{"type": "unicorn"}], "colour": "red"}, ['Unexpected field "colour" for fit_furniture.', f'Unknown room "garage". {KNOWN}', 'Unknown furniture "unicorn".']),
    ([FIT, {"intent": "describe_room", "room": "garage"}], [f'[1] Unknown room "garage". {KNOWN}']), (None, ["Response is not valid JSON."]),
]


def test_answers(spark):
    rooms = spark.createDataFrame([("p", r, i, *more) for i, (r, *more) in enumerate(ROOMS)], "plan_id string, room_id string, ord int, name string, type string, area double")
    cases = GOOD + BAD
    text = lambda c: c if c is None or isinstance(c, str) else json.dumps(c)
    asked = spark.createDataFrame([(i, "p", text(c), None) for i, (c, _) in enumerate(cases)] + [(99, "p", '{"intent":"describe_room"}', "hall")], "answer_id int, plan_id string, text string, selected_room_id string")
    got = {r.answer_id: r for r in answers.checked(asked, rooms).collect()}
    assert len(got) == len(cases) + 1 and got[99].ok and got[99].intents[0].room_ids == ["hall"]
    for i, (case, want) in enumerate(cases):
        if i < len(GOOD):
            assert got[i].ok and [tuple(x) for x in got[i].intents] == want, case
        else:
            assert (got[i].ok, got[i].errors, got[i].intents) == (False, want, None), case


def test_materials(spark):
    assert len({k for k, *_ in materials.MATERIALS}) == len(materials.MATERIALS) == spark.createDataFrame(materials.materials(spark).collect()).count()
    assert {r.material_id for r in materials.for_use(spark, "ceiling").collect()} == {"paint-white", "paint-cream", "ceiling-white", "ceiling-warm", "ceiling-wood"}
    r = spark.range(1).select(materials.first_finishes(F.lit("toilet")).alias("a"), materials.first_finishes(F.lit("living")).alias("b"), materials.shown_color(F.lit("steel"), F.lit(None)).alias("c"), materials.shown_color(F.lit("steel"), F.lit("#000000")).alias("d"), materials.material_named(F.lit("oak"), "floor").alias("e"), materials.material_named(F.lit("OAK"), "door").alias("f")).first()
    assert r.a["floorMaterialId"] == "floor-bath-tile" and r.b["floorMaterialId"] == "floor-oak" and (r.c, r.d, r.e, r.f) == ("#b4b7ba", "#000000", "floor-oak", "wood-oak")
