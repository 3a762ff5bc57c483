"""Spatial joins: points in polygons and near pairs through a uniform grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwright.functions import geometry as G
from planwright.sources.lineage import cut, shuffled


def room_at(points: DataFrame, rooms: DataFrame, key: str, point_id: str, room_id: str) -> DataFrame:
    """The first room (least ``ord``) of the same plan that strictly contains each point.

    ``points``: key, point_id, at; ``rooms``: key, room_id, ord, polygon.  The plan is an equi-key and
    the bounding box a cheap residual before the polygon test.
    """
    r = rooms.withColumn("_b", G.bounds(F.col("polygon")))
    at = F.col("at")
    inside = (at["x"] >= F.col("_b.min_x")) & (at["x"] <= F.col("_b.max_x")) & (at["z"] >= F.col("_b.min_z")) & (at["z"] <= F.col("_b.max_z"))
    hits = points.join(r, key).where(inside).where(G.strictly_contains(F.col("polygon"), at))
    found = shuffled(hits.groupBy(key, point_id).agg(F.min_by(room_id, "ord").alias(room_id)))
    return points.select(key, point_id).join(found, [key, point_id], "left")


def near(left: DataFrame, right: DataFrame, key: str, value: str, radius: float) -> DataFrame:
    """Pairs of one key whose values differ by at most ``radius``.

    Values fall in cells as wide as the radius; the left side visits its cell and both neighbours, so
    the join is on (key, cell) and every pair meets once.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    a = left.withColumn("_at", cell(value)).withColumn("_cell", F.explode(F.array(F.col("_at") - 1, F.col("_at"), F.col("_at") + 1))).drop("_at")
    b = right.withColumnRenamed(value, f"{value}_right").withColumn("_cell", cell(f"{value}_right"))
    return a.join(b, [key, "_cell"]).where(F.abs(F.col(value) - F.col(f"{value}_right")) <= radius).drop("_cell")


def box_cells(p: Column, pad: Column, size: float) -> Column:
    """Cells (cx, cz) of a square grid that a point's surroundings, ``pad`` to each side, lie in."""
    span = lambda v: F.sequence(F.floor((v - pad) / size), F.floor((v + pad) / size))
    return F.flatten(F.transform(span(p["x"]), lambda cx: F.transform(span(p["z"]), lambda cz: F.struct(cx.alias("cx"), cz.alias("cz")))))


def segment_cells(a: Column, b: Column, reach: Column, size: float) -> Column:
    """Cells (cx, cz) of a square grid that hold every point within ``reach`` of a segment.

    A walk along the columns of the grid: in each, the rows that the piece of the segment near it spans.
    """
    x0, x1 = F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])
    slope = F.when(x1 - x0 > G.TINY, (b["z"] - a["z"]) / (b["x"] - a["x"]))

    def rows(cx: Column) -> Column:
        near = lambda x: F.least(x1, F.greatest(x0, x))
        at = lambda x: a["z"] + (x - a["x"]) * slope
        left, right = near(cx * size - reach), near((cx + 1) * size + reach)
        low = F.coalesce(F.least(at(left), at(right)), F.least(a["z"], b["z"]))
        high = F.coalesce(F.greatest(at(left), at(right)), F.greatest(a["z"], b["z"]))
        span = F.sequence(F.floor((low - reach) / size), F.floor((high + reach) / size))
        return F.transform(span, lambda cz: F.struct(cx.alias("cx"), cz.alias("cz")))

    return F.flatten(F.transform(F.sequence(F.floor((x0 - reach) / size), F.floor((x1 + reach) / size)), rows))


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label): least node of each connected component, for every node of ``edges`` (u, v).

    Large and small stars by turns: every node's neighbours are hung on the least of them, first those
    above it, then those below.  A chain shortens by a factor in every round, so rounds grow with the
    logarithm of its length; lineage is cut after each, and it ends when the edges stay as they are.
    """
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now, seen = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(below, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = cut(hung.unionByName(below.select("u", F.col("m").alias("v"))).distinct())
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
