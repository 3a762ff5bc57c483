"""Walls as boxes: solid between openings, sills below and lintels above them, with their place in space and volume.

``walls``: floor_id, wall_id, start, end, thickness, height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwright.functions import geometry as G

#: Fixed value: shortest piece, in metres.
LEAST = 1e-3
WALL = "floor_id", "wall_id"


def opening_spans(doors: DataFrame, windows: DataFrame) -> DataFrame:
    """Stretches of walls that openings take, and their height: floor_id, wall_id, id, rank, ord, from, to, bottom, top.

    ``doors``, ``windows``: floor_id, id, ord, wall_id, offset, width, height (windows: sill_height).
    """
    half = F.col("width") / 2
    cols = lambda rank, bottom: [*WALL, "id", F.lit(rank).alias("rank"), "ord", (F.col("offset") - half).alias("from"), (F.col("offset") + half).alias("to"), bottom.alias("bottom"), (bottom + F.col("height")).alias("top")]
    return doors.select(*cols(0, F.lit(0.0))).unionByName(windows.select(*cols(1, F.col("sill_height"))))


def pieces(walls: DataFrame, spans: DataFrame) -> DataFrame:
    """Boxes of each wall along its length: floor_id, wall_id, kind (solid, sill, lintel), from, to, bottom, top.

    Openings are cut to the wall and taken in order; what an earlier one has passed isn't taken again.
    """
    w = walls.select(*WALL, G.distance(F.col("start"), F.col("end")).alias("length"), F.col("height").cast("double").alias("high"))
    s = spans.select(*WALL, "rank", "ord", F.greatest(F.lit(0.0), "from").alias("from"), "to", "bottom", "top").join(w, [*WALL]).withColumn("to", F.least("length", "to"))
    s = s.where(F.col("to") - F.col("from") > LEAST)
    order = Window.partitionBy(*WALL).orderBy("from", "rank", "ord")
    cursor = F.coalesce(F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumns({"cursor": cursor, "last": F.lead("from").over(order).isNull(), "reach": F.max("to").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    begin, high, zero = F.greatest("from", "cursor"), F.col("high"), F.lit(0.0)
    box = lambda kind, a, b, low, top, when: F.when(when & (b - a > LEAST), F.struct(F.lit(kind).alias("kind"), a.alias("from"), b.alias("to"), low.cast("double").alias("bottom"), top.cast("double").alias("top")))
    parts = F.array_compact(F.array(
        box("solid", F.col("cursor"), F.col("from"), zero, high, F.lit(True)), box("sill", begin, F.col("to"), zero, F.least("bottom", "high"), F.col("bottom") > LEAST),
        box("lintel", begin, F.col("to"), F.col("top"), high, high - F.col("top") > LEAST), box("solid", F.col("reach"), F.col("length"), zero, high, F.col("last")),
    ))
    made = s.select(*WALL, F.explode(parts).alias("p")).select(*WALL, "p.*")
    whole = w.join(s.select(*WALL).distinct(), [*WALL], "left_anti").where(F.col("length") > LEAST)
    return made.unionByName(whole.select(*WALL, F.lit("solid").alias("kind"), zero.alias("from"), F.col("length").alias("to"), zero.alias("bottom"), high.alias("top")))


def placed(walls: DataFrame, boxes: DataFrame, elevation: Column | float = 0.0) -> DataFrame:
    """``boxes`` with centre (x, y, z), size (length, height, thickness) and rotation about the vertical axis."""
    lift = elevation if isinstance(elevation, Column) else F.lit(elevation)
    d = boxes.join(walls.select(*WALL, "start", "end", "thickness"), [*WALL])
    d = d.withColumns({"_p": G.point_along_wall(F.col("start"), F.col("end"), (F.col("from") + F.col("to")) / 2, F.lit(0.0)), "_d": G.wall_direction(F.col("start"), F.col("end"))})
    centre = F.struct(F.col("_p.x").alias("x"), (lift + (F.col("bottom") + F.col("top")) / 2).alias("y"), F.col("_p.z").alias("z"))
    size = F.struct((F.col("to") - F.col("from")).alias("length"), (F.col("top") - F.col("bottom")).alias("height"), F.col("thickness"))
    return d.select(*boxes.columns, centre.alias("centre"), size.alias("size"), F.atan2(-F.col("_d.z"), F.col("_d.x")).alias("rotation"))


def volumes(walls: DataFrame, boxes: DataFrame) -> DataFrame:
    """Solid volume of each wall."""
    d = boxes.join(walls.select(*WALL, "thickness"), [*WALL])
    return d.groupBy(*WALL).agg(F.sum((F.col("to") - F.col("from")) * (F.col("top") - F.col("bottom")) * F.col("thickness")).alias("volume"))
