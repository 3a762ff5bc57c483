"""The furniture catalogue: its rows, searches and placement rules."""

from planwright.sources import furniture


def test_catalogue(spark):
    rows = {r.catalog_id: r for r in furniture.catalog(spark).collect()}
    assert len(rows) == 20 and rows["wardrobe"].most.width == 2.0 and rows["sofa-3"].least.width == 1.54 and not rows["rug"].collides


def test_search_and_rules(spark):
    asked = spark.createDataFrame([("Couch",), ("a big nightstand please",), ("",), ("zzz",)], "query string")
    got = {}
    for r in furniture.searched(asked).collect():
        got.setdefault(r["query"], []).append(r.catalog_id)
    assert got["Couch"] == ["sofa-3"] and got["a big nightstand please"] == ["bedside-table"] and len(got[""]) == 20 and "zzz" not in got
    placed = spark.createDataFrame([("rug",), ("tv-unit",), ("throne",)], "catalog_id string")
    assert {r.catalog_id: (r.collides, r.front_clearance) for r in furniture.with_rules(placed, furniture.catalog(spark)).collect()} == {"rug": (False, 0.0), "tv-unit": (True, 1.5), "throne": (True, 0.0)}
