"""Openings on walls: overlaps, merged spans and the solid pieces between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST = 1e-3


def overlaps(spans: DataFrame, wall: list[str], ord_col: str = "ord") -> DataFrame:
    """Pairs of spans of one wall that overlap: an equi-join on the wall with the rest as residual."""
    a, b = spans.alias("a"), spans.alias("b")
    same = [F.col(f"a.{w}") == F.col(f"b.{w}") for w in wall]
    on = [*same, F.col("a.start") < F.col("b.stop"), F.col("b.start") < F.col("a.stop"), F.col(f"a.{ord_col}") < F.col(f"b.{ord_col}")]
    depth = F.least("a.stop", "b.stop") - F.greatest("a.start", "b.start")
    return a.join(b, on).select(*[F.col(f"a.{w}").alias(w) for w in wall], F.col(f"a.{ord_col}").alias("first"), F.col(f"b.{ord_col}").alias("second"), depth.alias("depth"))


def _before(wall: list[str], ord_col: str) -> Column:
    w = Window.partitionBy(*wall).orderBy("start", "stop", ord_col).rowsBetween(Window.unboundedPreceding, -1)
    return F.max("stop").over(w)


def merged(spans: DataFrame, wall: list[str], ord_col: str = "ord") -> DataFrame:
    """Spans of each wall with overlapping and touching ones made one (gaps and islands)."""
    order = Window.partitionBy(*wall).orderBy("start", "stop", ord_col)
    opens = F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), 1).otherwise(0)
    marked = spans.withColumn("_reach", _before(wall, ord_col)).withColumn("_island", F.sum(opens).over(order))
    return marked.groupBy(*wall, "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("n")).drop("_island")


def wall_pieces(spans: DataFrame, wall: list[str], length: Column, ord_col: str = "ord") -> DataFrame:
    """Pieces of each wall from 0 to its length: solid between openings, then the openings."""
    order = Window.partitionBy(*wall).orderBy("start", "stop", ord_col)
    s = spans.withColumn("_cursor", F.coalesce(_before(wall, ord_col), F.lit(0.0))).withColumn("_last", F.lead("start").over(order).isNull()).withColumn("_length", length)
    piece = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("stop"))
    start, stop = F.greatest("start", "_cursor"), F.col("stop")
    pieces = F.array(
        piece("solid", F.col("_cursor"), F.col("start")),
        piece("opening", start, stop),
        piece("solid", F.when(F.col("_last"), F.greatest("_cursor", "stop")), F.col("_length")),
    )
    return s.select(*wall, F.explode(pieces).alias("p")).select(*wall, "p.*").where(F.col("stop") - F.col("start") > LEAST)
