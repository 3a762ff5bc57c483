"""Repairing what an extractor drew: one bad element must not spoil its plan, and every repair is noted.

A wall without geometry goes, and with it the openings on it; openings are cut to their wall; of openings
that overlap, equal kinds become one and of unlike kinds the weaker goes; outlines that are no polygons go.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwright.functions import geometry as G
from planwright.operators.annotated import wall_geometry
from planwright.operators.rules import union_rules

#: Fixed values, in pixels: least stretch of an opening within its wall, and overlap that is let pass.
LEAST_SPAN, OVERLAP = 2.0, 0.5
#: Columns of a note: what was done to which element because of which other one.
NOTE = ("plan_id", "repair", "element_id", "other_id", "impact")
UNCERTAIN, MEANING = "geometry-uncertain", "semantic-uncertainty"
OPENING = "struct<from:double,rank:int,ord:int,to:double,id:string,what:string,kind:string,confidence:double>"


class Sanitized(NamedTuple):
    """The repaired relations and the notes."""

    walls: DataFrame
    doors: DataFrame
    windows: DataFrame
    rooms: DataFrame
    fixtures: DataFrame
    outlines: DataFrame
    notes: DataFrame


def sound(polygon: Column) -> Column:
    """Whether points make a polygon: three of them, finite, of some area, and no edges that cross."""
    finite = F.forall(polygon, lambda p: F.coalesce(~F.isnan(p["x"]) & ~F.isnan(p["z"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["z"]) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(polygon) >= 3) & finite & (G.area(polygon) >= 1) & ~G.self_intersects(polygon), F.lit(False))


def _strength(o: Column) -> Column:
    """A door with a symbol beats a window, a window a plain opening; confidence decides between neighbours."""
    return F.when(o["what"] == "window", 1.0).when(o["kind"] == "opening", 0.0).otherwise(2.0) + F.coalesce(o["confidence"], F.lit(1.0)) * 0.5


def _settled(openings: Column) -> Column:
    """Openings of one wall in order, each against the last one kept: struct of kept openings and notes."""
    note = "struct<repair:string,element_id:string,other_id:string,impact:string>"
    start = F.struct(F.array().cast(f"array<{OPENING}>").alias("kept"), F.array().cast(f"array<{note}>").alias("notes"))

    def told(repair: str, one: Column, other: Column, impact: str) -> Column:
        return F.struct(F.lit(repair).alias("repair"), one["id"].alias("element_id"), other["id"].alias("other_id"), F.lit(impact).alias("impact"))

    def step(acc: Column, o: Column) -> Column:
        kept, notes = acc["kept"], acc["notes"]
        last = F.try_element_at(kept, F.lit(-1))
        but_last = lambda new: F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(new))
        apart = last.isNull() | (o["from"] >= last["to"] - OVERLAP)
        alike = (last["what"] == o["what"]) & last["kind"].eqNullSafe(o["kind"])
        joined = last.withField("to", F.greatest(last["to"], o["to"])).withField("confidence", F.greatest(F.coalesce(last["confidence"], F.lit(1.0)), F.coalesce(o["confidence"], F.lit(1.0))))
        wins = _strength(o) > _strength(last)
        return F.struct(
            F.when(apart, F.array_append(kept, o)).when(alike, but_last(joined)).when(wins, but_last(o)).otherwise(kept).cast(f"array<{OPENING}>").alias("kept"),
            F.when(apart, notes).when(alike, F.array_append(notes, told("merged", last, o, MEANING))).when(wins, F.array_append(notes, told("weaker-dropped", o, last, UNCERTAIN))).otherwise(F.array_append(notes, told("weaker-dropped", last, o, UNCERTAIN))).cast(f"array<{note}>").alias("notes"),
        )

    # where each stands apart from the one before it, the fold would keep them all
    n = F.size(openings) - 1
    clear = F.forall(F.zip_with(F.slice(openings, 1, n), F.slice(openings, 2, n), lambda a, b: b["from"] >= a["to"] - OVERLAP), lambda c: F.coalesce(c, F.lit(False)))
    whole = F.struct(openings.cast(f"array<{OPENING}>").alias("kept"), F.array().cast(f"array<{note}>").alias("notes"))
    return F.when(clear, whole).otherwise(F.aggregate(openings, start, step))


def sanitized(walls: DataFrame, doors: DataFrame, windows: DataFrame, rooms: DataFrame, fixtures: DataFrame, outlines: DataFrame) -> Sanitized:
    """Repaired plans.

    ``walls``: plan_id, id, rect, segment; ``doors``, ``windows``: plan_id, id, ord, wall_id, kind, confidence, span_from, span_to;
    ``rooms``: plan_id, id, polygon; ``fixtures``: plan_id, id, polygon (null where another shape is given);
    ``outlines``: plan_id, polygon (empty for none).  All further columns stay.
    """
    none = F.lit(None).cast("string")
    noted = lambda d, repair, element="id", other=none, impact=UNCERTAIN: d.select("plan_id", F.lit(repair).alias("repair"), (F.col(element) if element else none).alias("element_id"), other.alias("other_id"), F.lit(impact).alias("impact"))
    drawn = wall_geometry(walls)
    usable = F.col("length_px").isNotNull()
    g = drawn.where(usable).select("plan_id", F.col("id").alias("wall_id"), "a", "dir", "dominant", "length_px")
    cols = ["plan_id", "id", "ord", "wall_id", "kind", "confidence", "span_from", "span_to"]
    both = doors.select(*cols, F.lit("door").alias("what"), F.lit(0).alias("rank")).unionByName(windows.select(*cols, F.lit("window").alias("what"), F.lit(1).alias("rank")))
    lost = both.join(g.select("plan_id", "wall_id"), ["plan_id", "wall_id"], "left_anti")
    axis = lambda v: F.when(F.col("dominant") == "x", F.col(f"{v}.x")).otherwise(F.col(f"{v}.z"))
    on = both.join(g, ["plan_id", "wall_id"]).withColumns({"from": (F.least("span_from", "span_to") - axis("a")) / axis("dir"), "to": (F.greatest("span_from", "span_to") - axis("a")) / axis("dir")})
    low, high = F.greatest(F.lit(0.0), "from"), F.least("length_px", "to")
    fits = F.coalesce(high - low >= F.greatest(F.lit(LEAST_SPAN), 0.5 * (F.col("to") - F.col("from"))), F.lit(False))
    one = F.struct(low.alias("from"), "rank", F.col("ord").cast("int").alias("ord"), high.alias("to"), "id", "what", "kind", F.col("confidence").cast("double").alias("confidence"))
    settled = on.where(fits).groupBy("plan_id", "wall_id").agg(F.sort_array(F.collect_list(one)).alias("o")).select("plan_id", "wall_id", _settled(F.col("o")).alias("s"))
    kept = settled.select("plan_id", "wall_id", F.explode("s.kept").alias("o")).join(g, ["plan_id", "wall_id"])
    ends = F.sort_array(F.array(*[axis("a") + axis("dir") * F.col(f"o.{k}") for k in ("from", "to")]))
    kept = kept.select("plan_id", "o.id", "o.what", F.col("o.confidence").alias("_confidence"), F.round(F.get(ends, 0), 2).alias("_from"), F.round(F.get(ends, 1), 2).alias("_to"))

    def repaired(d: DataFrame, what: str) -> DataFrame:
        new = {"confidence": "_confidence", "span_from": "_from", "span_to": "_to"}
        return d.join(kept.where(F.col("what") == what).drop("what"), ["plan_id", "id"]).select(*[F.col(new.get(c, c)).alias(c) for c in d.columns])

    whole, shaped = sound(F.col("polygon")), F.col("polygon").isNull() | sound(F.col("polygon"))
    blank = F.size("polygon") == 0
    notes = union_rules(
        noted(drawn.where(~usable), "wall-without-geometry"), noted(lost, "wall-gone", other=F.col("wall_id")), noted(on.where(~fits), "outside-wall", other=F.col("wall_id")),
        settled.select("plan_id", F.explode("s.notes").alias("n")).select("plan_id", "n.*"), noted(rooms.where(~whole), "room-dropped"), noted(outlines.where(~blank & ~whole), "outline-dropped", None),
    )
    empty = F.array().cast("array<struct<x:double,z:double>>")
    clean = walls.join(drawn.where(usable).select("plan_id", "id"), ["plan_id", "id"], "left_semi").select(*walls.columns)
    return Sanitized(clean, repaired(doors, "door"), repaired(windows, "window"), rooms.where(whole), fixtures.where(shaped), outlines.withColumn("polygon", F.when(whole, F.col("polygon")).otherwise(empty)), notes.select(*NOTE))
