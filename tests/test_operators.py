"""Small cases of operators with known results."""

import math

import pytest
from pyspark.sql import functions as F

from planwright.functions import geometry as G
from planwright.functions import labels as L
from planwright.operators import calibration, editing, spans, spatial, statistics
from planwright.plans import catalogue, registry  # noqa: F401 (catalogue registers its queries)
from planwright.streaming import documents


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def ring(*points):
    return F.array(*[G.point(F.lit(float(x)), F.lit(float(z))) for x, z in points])


def test_polygon_functions(spark):
    square, bow = ring((0, 0), (2, 0), (2, 2), (0, 2)), ring((0, 0), (2, 2), (2, 0), (0, 2))
    at = lambda x, z: G.point(F.lit(float(x)), F.lit(float(z)))
    r = one(
        spark, G.signed_area(square), G.perimeter(square), G.centroid(square)["x"], G.contains(square, at(2, 1)), G.strictly_contains(square, at(2, 1)),
        G.strictly_contains(square, at(1, 1)), G.self_intersects(bow), G.self_intersects(square), G.is_convex(square), G.distance_to_boundary(at(1, 0.5), square), G.contains(square, at(3, 3)),
    )
    assert list(r) == [4.0, 8.0, 1.0, True, False, True, True, False, True, 0.5, False]


def test_degenerate_and_empty_polygons(spark):
    line = ring((0, 0), (1, 0), (2, 0))
    empty = F.array().cast("array<struct<x:double,z:double>>")
    r = one(spark, G.area(line), G.centroid(line)["x"], G.bounds(empty)["min_x"], G.normalize(G.point(F.lit(0.0), F.lit(0.0)))["x"])
    assert list(r) == [0.0, 1.0, math.inf, 0.0]


@pytest.mark.parametrize("text,width,depth", [("3,50 m x 4.20 m", 3.5, 4.2), ("3500 x 4200 mm", 3.5, 4.2), ("2.75 m", 2.75, None), ("12'6\"", 3.81, None), ("Kitchen", None, None)])
def test_parse_dimension(spark, text, width, depth):
    got = one(spark, L.parse_dimension(F.lit(text)).alias("d")).d
    assert [round(v, 6) for v in (got.values if got else [])] == [v for v in (width, depth) if v]


def test_labels(spark):
    assert list(one(spark, L.parse_area(F.lit("57.4 sq. metres")), L.parse_floor(F.lit("THIRD FLOOR")), L.normalized(F.lit("b-1 a")))) == [57.4, "Third Floor", "B1A"]


def test_calibration_rejects_outliers(spark):
    refs = spark.createDataFrame([("a", 1.0, 100.0), ("a", 2.0, 201.0), ("a", 1.0, 99.0), ("a", 1.0, 150.0), ("b", 0.0, 5.0), ("c", 1.0, 10.0)], "plan string, m double, px double")
    got = {r.plan: r for r in calibration.from_references(refs, "plan", "m", "px").collect()}
    assert got["a"].n_used == 3 and got["a"].n_rejected == 1 and got["a"].confidence == "high"
    assert "b" not in got and got["c"].confidence == "low"


def test_wall_pieces_and_merge(spark):
    s = spark.createDataFrame([("w", 1, 1.0, 2.0), ("w", 2, 1.5, 3.0), ("w", 3, 4.0, 5.0)], "wall string, ord long, start double, stop double")
    merged = sorted((r.start, r.stop, r.n) for r in spans.merged(s, ["wall"]).collect())
    assert merged == [(1.0, 3.0, 2), (4.0, 5.0, 1)]
    pieces = sorted((r.start, r.stop, r.kind) for r in spans.wall_pieces(s, ["wall"], F.lit(6.0)).collect())
    assert pieces == [(0.0, 1.0, "solid"), (1.0, 2.0, "opening"), (2.0, 3.0, "opening"), (3.0, 4.0, "solid"), (4.0, 5.0, "opening"), (5.0, 6.0, "solid")]
    assert [(r.first, r.second) for r in spans.overlaps(s, ["wall"]).collect()] == [(1, 2)]


def test_nearest_unique_and_components(spark):
    a = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.5)], "k long, id long, at double")
    b = spark.createDataFrame([(1, 7, 0.4), (1, 8, 5.0)], "k long, id long, at double")
    assert [(r.left_id, r.right_id) for r in statistics.nearest_unique(a, b, "k", 0.6).collect()] == [(2, 7)]
    e = spark.createDataFrame([(1, 2), (2, 3), (8, 9)], "u long, v long")
    assert {r.node: r.label for r in spatial.components(e).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(150)] + [(500, 501)], "u long, v long")
    assert {r.node: r.label for r in spatial.components(e).collect()} == {**dict.fromkeys(range(151), 0), 500: 500, 501: 500}


def test_components_over_every_customer(spark):
    sf = "/root/testdata/sf0.001"
    label = {}
    for c in spark.read.parquet(f"{sf}/customer.parquet").collect():
        u, v = c.c_nationkey, 1000 + c.c_custkey % 40
        a, b = label.setdefault(u, u), label.setdefault(v, v)
        label = {n: min(a, b) if x in (a, b) else x for n, x in label.items()}
    assert {r.node: r.label for r in registry.queries()["connected_components_whole"](spark, sf).collect()} == label


def test_sequential_fit_blocks_later_items(spark):
    d = spark.createDataFrame([("r", 1, 1.0, 2.0), ("r", 2, 0.5, 2.0), ("r", 3, 1.0, 2.0)], "room string, ord long, width double, length double")
    got = {r.ord: (r.ok, r.position) for r in editing.sequential_fit(d, "room", "length").collect()}
    assert got[1] == (True, 0.5) and got[2][0] and not got[3][0]


def test_document_stream_equals_fold(spark, tmp_path):
    rows = [(1, 1, "move", 1.0), (1, 2, "paint", 2.0), (1, 3, "undo", None), (2, 1, "move", 5.0), (1, 4, "redo", None), (1, 5, "undo", None)]
    spark.createDataFrame(rows, "doc long, seq long, type string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc long, seq long, type string, value double").parquet(str(tmp_path / "in"))
    q = documents.document_stream(stream).writeStream.format("memory").queryName("docs").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r.doc: (r.version, r.last_type, r.last_value, r.n_undo, r.n_redo) for r in spark.table("docs").collect()}
    assert got == {1: (5, "move", 1.0, 1, 1), 2: (1, "move", 5.0, 1, 0)}
