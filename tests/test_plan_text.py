"""Labels of plans: the known cases of names, dimensions, areas, floors and lines."""

import pytest
from pyspark.sql import functions as F

from planwright.functions import labels as L
from planwright.operators import plan_text

NAMES = {
    "BEDROOM": "bedroom", "BED ROOM": "bedroom", "BEDR00M": "bedroom", "Bedroom 2": "bedroom", "Kitchen/Lounge/Diner": "kitchen-living", "LIVING / DINING": "living",
    "En-suite": "bathroom", "W.C.": "toilet", "Balcony": "balcony", "Living Room": "living", "master bed": "bedroom", "bed 1": "bedroom", "BED R.": "bedroom", "w/c": "toilet",
    "t&b": "bathroom", "Reception": "living", "Utility Room": "utility", "Store": "storage", "CHAMBRE": "bedroom", "Küche": "kitchen", "SALON": "living", "Wohnzimmer": "living", "Study": "unknown",
}
NONE = ["3.84m x 2.66m", "Approx. 57.4 sq. metres", "(excluding Balcony)", "Ceiling height reduced in the kitchen area", "XQZT", "NE", ""]


def test_room_names(spark):
    texts = [*NAMES, *NONE, "bedroom 2 why", "MASTER BEDROOM", "Zimmer 4"]
    d = spark.createDataFrame([(i, t, 0.9) for i, t in enumerate(texts)], "id long, text string, confidence double")
    got = {r.raw: r for r in plan_text.room_names(d, ["id"]).collect()}
    assert {t: got[t].type for t in NAMES} == NAMES
    assert not set(NONE) & set(got)
    assert got["bedroom 2 why"].display == "Bedroom 2" and got["MASTER BEDROOM"].display == "Master Bedroom"
    assert got["Kitchen/Lounge/Diner"].display == "Kitchen / Lounge / Diner" and got["Zimmer 4"].type_weight < 0.6
    assert got["BEDR00M"].corrections > 0 and got["BEDR00M"].confidence < got["BEDROOM"].confidence == 0.9


def test_combined_names(spark):
    rows = [(1, 0, "Kitchen"), (1, 1, "Lounge"), (2, 0, "Bedroom"), (2, 1, "Bathroom"), (3, 0, "Hall"), (4, 0, "Hall"), (4, 1, "Hall")]
    d = spark.createDataFrame([(*r, 1.0) for r in rows], "room long, ord long, text string, confidence double")
    got = {r.room: r for r in plan_text.combined_names(plan_text.room_names(d, ["room", "ord"]), ["room"], "ord").collect()}
    assert (got[1].type, got[1].display, got[1].plausible) == ("kitchen-living", "Kitchen / Lounge", True)
    assert (got[2].type, got[2].plausible) == ("unknown", False)
    assert (got[3].type, got[3].plausible) == ("hall", True) and not got[4].plausible


@pytest.mark.parametrize(
    ("text", "values", "unit"),
    [("3.84m x 2.66m", [3.84, 2.66], "m"), ("6.39 x 3.77 m", [6.39, 3.77], "m"), ("3,20 x 2,95", [3.2, 2.95], "m"), ("4200 x 3100 mm", [4.2, 3.1], "mm"), ("5825 x 7250", [5.825, 7.25], "mm"), ("8.00m", [8], "m"), ("12.00 m", [12], "m"), ("4200", [4.2], "mm"), ("3.20", [3.2], "m"), ("12'7\" x 8'9\"", [3.8354, 2.667], "ft"), ("14'0\"X12'8\"", [4.2672, 3.8608], "ft"), ("10'-6\"", [3.2004], "ft"), ("9'", [2.7432], "ft"), ("KITCHEN", None, None), ("2", None, None), ("57", None, None), ("20 pi", None, None), ("250", None, None)],
)
def test_dimensions(spark, text, values, unit):
    got = spark.createDataFrame([(text,)], "t string").select(L.parse_dimension(F.col("t")).alias("d")).first().d
    assert (got is None) if values is None else (got.unit == unit and list(got["values"]) == pytest.approx(values))


def test_areas_floors_and_second_reads(spark):
    d = spark.createDataFrame([(t,) for t in ("Approx. 57.4 sq. metres", "Total area 68,6 m²", "Approx. 68.6 sq m", "Bedroom", "THIRD FLOOR", "Lower ground floor", "Floor plan", "3.7/m", "room 12345 here")], "t string")
    got = {r.t: (r.a, r.f, r.q) for r in d.select("t", L.parse_area(F.col("t")).alias("a"), L.parse_floor(F.col("t")).alias("f"), L.looks_like_dimension(F.col("t")).alias("q")).collect()}
    assert [got[t][0] for t in ("Approx. 57.4 sq. metres", "Total area 68,6 m²", "Approx. 68.6 sq m", "Bedroom")] == [57.4, 68.6, 68.6, None]
    assert [got[t][1] for t in ("THIRD FLOOR", "Lower ground floor", "Floor plan")] == ["Third Floor", "Lower Ground Floor", None]
    assert got["3.7/m"][2] and not got["Bedroom"][2] and not got["room 12345 here"][2]


def word(plan, ord, text, x0, y0, x1, y1, confidence=0.95):
    return (plan, ord, text, confidence, float(x0), float(y0), float(x1), float(y1))


def test_lines(spark):
    words = [word("a", 0, "DINING", 70, 10, 120, 22), word("a", 1, "LIVING", 10, 10, 55, 22), word("a", 2, "/", 58, 10, 62, 22), word("a", 3, "KITCHEN", 400, 11, 460, 23), word("a", 4, "3.84m", 10, 30, 50, 40), word("a", 5, "x", 54, 32, 60, 40), word("a", 6, "2.66m", 64, 30, 104, 40), word("a", 7, " ", 0, 0, 5, 5)]
    words += [word("b", 0, "KITCHEN", 10, 10, 70, 21), word("b", 1, "3325x2825", 10, 28, 80, 38), word("b", 2, "I", 120, 0, 130, 50, 0.4)]
    d = spark.createDataFrame(words, "plan_id string, ord long, text string, confidence double, x0 double, y0 double, x1 double, y1 double")
    lines = plan_text.group_lines(d).orderBy("plan_id", "line").collect()
    assert [r.text for r in lines if r.plan_id == "a"] == ["LIVING / DINING", "KITCHEN", "3.84m x 2.66m"]
    assert {"KITCHEN", "3325x2825"} <= {r.text for r in lines if r.plan_id == "b"}


def test_read_lines(spark):
    texts = ["Approx. 57.4 sq. metres", "THIRD FLOOR", "12.5 m²", "3.84m x 2.66m", "3.7/m", "Bedroom"]
    d = spark.createDataFrame([("p", i, t, 0.9) for i, t in enumerate(texts)], "plan_id string, line long, text string, confidence double")
    got = plan_text.read_lines(d).orderBy("line").collect()
    assert [r.kind for r in got] == ["area", "floor", "area", "dimension", "unread", "text"]
    assert [r.first for r in got] == [True, True, False, False, False, False] and got[3].dimension.unit == "m"


def test_label_recall(spark):
    found = spark.createDataFrame([(1, "Küche"), (1, "MASTER BEDROOM 2"), (2, "Bad")], "plan long, label string")
    expected = spark.createDataFrame([(1, "kuche"), (1, "Master Bedroom"), (1, "Hall"), (2, "BAD."), (3, "x")], "plan long, label string")
    assert {r.plan: r.hits for r in plan_text.label_recall(found, expected, "plan").collect()} == {1: 2, 2: 1, 3: 0}
