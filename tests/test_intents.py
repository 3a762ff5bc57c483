"""Sentences with known intents."""

import pytest
from pyspark.sql import functions as F

from planwright.operators import intents

ROOMS = [("kitchen-living", "Kitchen / Living", "kitchen-living", 28.0), ("bedroom-1", "Bedroom 1", "bedroom", 14.0), ("bedroom-2", "Bedroom 2", "bedroom", 11.0), ("hall", "Hall", "hall", 6.0), ("bathroom", "Bathroom", "bathroom", 5.0), ("cupboard", "Cupboard", "storage", 1.0)]
CASES = {
    "Put a 3-seat sofa against the longest wall in the living room.": [("place_furniture", ["kitchen-living"], ["sofa-3"], None, None, "longest_wall")],
    "Can I fit a king-size bed here?": [("check_fit", ["bedroom-2"], ["bed-king"], None, None, None)],
    "Renovate the bedroom with warm wood flooring and light beige walls.": [("renovate", ["bedroom-1"], None, None, {"floorMaterialId": "floor-oak", "wallMaterialId": "paint-beige"}, None)],
    "Replace the kitchen flooring with marble": [("renovate", ["kitchen-living"], None, None, {"floorMaterialId": "floor-marble"}, None)],
    "Make the living room Scandinavian": [("renovate", ["kitchen-living"], None, "scandinavian", None, None)],
    "Make the bedroom feel larger": [("renovate", ["bedroom-1"], None, "bright-airy", None, None)],
    "make bedroom 2 industrial": [("renovate", ["bedroom-2"], None, "industrial", None, None)],
    "paint the walls of the second bedroom #AABBCC and turn off the lights": [("renovate", ["bedroom-2"], None, None, {"wallColor": "#aabbcc", "lighting": "off"}, None)],
    "make it nicer": [("unknown", None, None, None, None, None)],
    "Remove the sofa and two dining chairs from the hallway": [("remove_furniture", ["hall"], ["sofa-3"], None, None, None), ("remove_furniture", ["hall"], ["dining-chair"], None, None, None)],
    "add 9 plants": [("place_furniture", ["bedroom-2"], ["plant"] * 8, None, None, None)],
    "How big is the bathroom": [("describe_room", ["bathroom"], None, None, None, None)],
    "Paint all rooms with cream walls": [("renovate", ["kitchen-living", "bedroom-1", "bedroom-2", "hall", "bathroom"], None, None, {"wallMaterialId": "paint-cream"}, None)],
    "Change the ceiling": [("unknown", None, None, None, None, None)],
    "": [],
    None: [],
}


def test_intents(spark):
    rooms = spark.createDataFrame([("p", r, i, *more) for i, (r, *more) in enumerate(ROOMS)], "plan_id string, room_id string, ord int, name string, type string, area double")
    asked = [(i, "p", t, "bedroom-2" if t and ("here" in t or "9 plants" in t) else None) for i, t in enumerate(CASES)] + [(99, "none", "add a sofa", None)]
    got = {r.ask_id: r for r in intents.parsed(spark.createDataFrame(asked, "ask_id int, plan_id string, text string, selected_room_id string"), rooms).collect()}
    for i, (text, want) in enumerate(CASES.items()):
        assert [(x.action, x.room_ids, x.furniture, x.preset, x.patch, x.placement) for x in got[i].intents] == want, text
    assert got[99].intents[0].reason == intents.ASKS["place"]
    assert got[2].note.startswith("There are 2 bedrooms; I used Bedroom 1 (the largest).") and got[7].note == "Using Bedroom 2 (the smaller bedroom)."


@pytest.mark.parametrize(
    "text,want",
    [("Fit a sofa, TV unit and coffee table", ["sofa-3", "tv-unit", "coffee-table"]), ("add 4 dining chairs and a king size bed", ["dining-chair"] * 4 + ["bed-king"]), ("a pair of lamps, six floor lamps", ["floor-lamp"] * 7), ("nothing of it", []), (None, [])],
)
def test_mentions(text, want):
    assert intents._mentioned(text) == want


def test_presets(spark):
    d = spark.createDataFrame([("classic-luxe", "bathroom"), ("industrial", "hall"), ("warm-modern", "balcony"), ("baroque", "hall")], "preset string, type string")
    got = [r.p for r in d.select(intents.preset_patch(d.preset, d.type).alias("p")).collect()]
    assert got[0]["floorMaterialId"] == "floor-marble" and got[0]["doorMaterialId"] == "wood-white" and got[1]["windowMaterialId"] == "aluminium-dark" and got[2] == {} and got[3] is None


def test_clauses_are_found_once(spark):
    d = spark.createDataFrame([("paint the walls sage, oak floor and white ceiling with warm light",)], "t string").select(intents.finish_patch(F.col("t")).alias("patch"))
    assert d.first().patch == {"floorMaterialId": "floor-oak", "wallMaterialId": "paint-sage", "ceilingMaterialId": "ceiling-white", "lighting": "warm"}
    assert d._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
