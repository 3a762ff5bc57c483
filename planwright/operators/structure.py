"""Walls among all that is drawn with heavy ink: contacts between ends, clusters, and a score for every stroke."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwright.functions import geometry as G
from planwright.operators.spatial import box_cells, components, segment_cells
from planwright.sources.lineage import cut

#: Width of a cell, in pixels.
CELL = 64.0
#: Slack of a contact in pixels; share of the largest cluster below which one is detached.
CONTACT, DETACHED = 2.0, 0.15
#: Scores below which a stroke is weak, and doubtful.
WEAK, DOUBTFUL = 0.35, 0.45
KEY = "plan_id", "wall_id"


def contacts(walls: DataFrame) -> DataFrame:
    """Ends of walls that touch other walls of their plan: plan_id, wall_id, key (0 or 1), other_id.

    ``walls``: plan_id, wall_id, a, b, thickness.  Ends and walls meet in cells of the plane.
    """
    t, o, p = F.col("thickness"), F.col("o"), F.col("p")
    ends = walls.select(*KEY, "thickness", F.explode(F.array(F.struct(F.lit(0).alias("key"), F.col("a").alias("p")), F.struct(F.lit(1).alias("key"), F.col("b").alias("p")))).alias("e")).select(*KEY, "thickness", "e.key", "e.p")
    ends = ends.withColumn("cell", F.explode(box_cells(p, t / 2, CELL)))
    d = walls.withColumn("d", G.wall_direction(F.col("a"), F.col("b"))).withColumn("cell", F.explode(segment_cells(F.col("a"), F.col("b"), t * 1.5 + CONTACT, CELL)))
    other = d.select("plan_id", "cell", F.struct("wall_id", "a", "d", G.distance(F.col("a"), F.col("b")).alias("length"), t.alias("thickness")).alias("o"))
    v = G.sub(p, o["a"])
    along, off = G.dot(v, o["d"]), F.abs(G.cross(o["d"], v))
    met = ends.join(other, ["plan_id", "cell"]).where((F.col("wall_id") != o["wall_id"]) & (off <= o["thickness"] / 2 + t / 2 + CONTACT) & (along >= -o["thickness"]) & (along <= o["length"] + o["thickness"]))
    return met.select(*KEY, "key", o["wall_id"].alias("other_id")).distinct()


def _nearest_class(thickness: Column) -> Column:
    """The plan's thickness nearest to a wall's; the main one where several are as near."""
    classes = F.concat(F.array("major"), F.col("modes"))
    return F.array_min(F.transform(classes, lambda m, i: F.struct(F.abs(m - thickness).alias("far"), i.alias("i"), m.alias("m"))))["m"]


def assessed(walls: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every wall with its fate: kept, doubtful (kept with less confidence) or removed.

    ``walls``: plan_id, wall_id, a, b, thickness, confidence; ``profiles``: plan_id, major, modes (thicknesses
    in pixels).  Columns: plan_id, wall_id, fate, confidence, score, connectivity, cluster (its share of the largest).
    """
    met = cut(contacts(walls))
    node = lambda wall: F.struct(F.col("plan_id"), F.col(wall).alias("wall_id"))
    label = components(met.select(node("wall_id").alias("u"), node("other_id").alias("v"))).select("node.plan_id", "node.wall_id", F.col("label.wall_id").alias("root"))
    links = met.groupBy(*KEY).agg(F.countDistinct("key").alias("links"))
    t, span = F.col("thickness"), G.distance(F.col("a"), F.col("b"))
    dx, dz = F.abs(F.col("b.x") - F.col("a.x")), F.abs(F.col("b.z") - F.col("a.z"))
    d = walls.join(label, [*KEY], "left").join(links, [*KEY], "left").join(profiles.select("plan_id", "major", "modes"), "plan_id")
    d = d.withColumns({"root": F.coalesce("root", "wall_id"), "links": F.coalesce("links", F.lit(0)), "span": span, "mode": _nearest_class(t)})
    short, oblique = F.col("span") < F.greatest(6 * t, 2.5 * F.col("major")), F.least(dx, dz) > 0.2 * F.greatest(dx, dz)
    low = lambda c: F.min(F.least(f"a.{c}", f"b.{c}"))
    high = lambda c: F.max(F.greatest(f"a.{c}", f"b.{c}"))
    clusters = d.groupBy("plan_id", "root").agg(
        F.sum("span").alias("length"), F.count(F.lit(1)).alias("n"), F.hypot(high("x") - low("x"), high("z") - low("z")).alias("diagonal"),
        F.avg(short.cast("double")).alias("short"), F.count_if(oblique).alias("oblique"), F.first("major").alias("_major"),
    )
    glyph = (F.col("n") >= 3) & (F.col("diagonal") < 10 * F.col("_major")) & (F.col("short") >= 0.7) & (F.col("oblique") >= 1)
    largest = clusters.groupBy("plan_id").agg(F.max("length").alias("largest"))
    clusters = clusters.select("plan_id", "root", "length", glyph.alias("glyph"))
    d = d.join(clusters, ["plan_id", "root"]).join(largest, "plan_id")
    mode = F.col("mode")
    fit = F.greatest(F.lit(0.0), 1 - F.abs(t - mode) / (F.when(t > mode, 1.0).otherwise(0.5) * mode))
    connectivity, proportion, share = F.col("links") / 2, F.least(F.lit(1.0), F.col("span") / (3 * t)), F.col("length") / F.col("largest")
    d = d.withColumns({"fit": fit, "connectivity": connectivity, "cluster": share})
    d = d.withColumn("score", F.col("confidence") * (0.5 + 0.5 * F.col("fit")) * (0.55 + 0.45 * F.col("connectivity")) * proportion)
    weak, detached = (F.col("score") < WEAK) | (F.col("fit") < 0.5), F.col("cluster") < DETACHED
    alone = (F.col("connectivity") == 0) & (weak | (F.col("span") < 3 * t))
    fate = F.when((detached & weak) | alone | F.col("glyph"), "removed").when((F.col("score") < DOUBTFUL) | detached, "doubtful").otherwise("kept")
    d = d.withColumn("fate", fate)
    trusted = F.when(F.col("fate") == "doubtful", F.round(F.least("confidence", F.col("score") + 0.1), 3)).otherwise(F.col("confidence"))
    return d.select(*KEY, "fate", trusted.alias("confidence"), "score", "connectivity", "cluster")


def suppressed(items: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Non-maximum suppression: the items (id, rank) that no better item kept before them conflicts with.

    The least rank is best and no two items in conflict share one; ``conflicts``: u, v.  An item that is
    better than all undecided ones it conflicts with is kept, those go, and the rest is looked at again.
    """
    both = conflicts.select("u", "v").unionByName(conflicts.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    ranks = items.select("id", "rank")
    edges = cut(both.join(ranks.select(F.col("id").alias("u"), F.col("rank").alias("own")), "u").join(ranks.select(F.col("id").alias("v"), F.col("rank").alias("other")), "v"))
    kept = cut(ranks.join(edges.select(F.col("u").alias("id")).distinct(), "id", "left_anti").select("id"))
    while edges.take(1):
        best = edges.groupBy("u", "own").agg(F.min("other").alias("other")).where("own < other").select("u")
        best = cut(best)
        gone = edges.join(best, "u").select(F.col("v").alias("u")).distinct()
        out = cut(best.unionByName(gone))
        left = edges.join(out, "u", "left_anti").join(out.select(F.col("u").alias("v")), "v", "left_anti").select("u", "v", "own", "other")
        left = cut(left)
        # an undecided item whose rivals are all decided has none left to lose to
        free = edges.select("u").distinct().join(out, "u", "left_anti").join(left.select("u"), "u", "left_anti")
        kept = kept.unionByName(best.select(F.col("u").alias("id"))).unionByName(free.select(F.col("u").alias("id")))
        edges = left
    return items.join(cut(kept), "id", "left_semi")


def strongest_spans(spans: DataFrame, key: list[str], start: str, stop: str, strength: str, ord_: str) -> DataFrame:
    """Of spans that overlap on one wall (``key``), the strongest; the first of equals.

    A span's rivals are those that begin within it or within which it begins, found by cells as wide as
    the key's mean span.
    """
    ids = spans.withColumn("id", F.struct(*key, ord_)).withColumn("rank", F.struct((-F.col(strength)).alias("weak"), *key, F.col(ord_)))
    mean = spans.groupBy(*key).agg(F.greatest(F.avg(F.col(stop) - F.col(start)), F.lit(1e-6)).alias("_w"))
    d = ids.join(mean, key)
    cells = F.sequence(F.floor(F.col(start) / F.col("_w")), F.floor(F.col(stop) / F.col("_w")))
    d = d.select(*key, F.col("id"), F.col(start).alias("s"), F.col(stop).alias("t"), F.explode(cells).alias("cell"))
    e = d.select(*key, "cell", F.col("id").alias("v"), F.col("s").alias("s2"), F.col("t").alias("t2"))
    met = d.join(e, [*key, "cell"]).where((F.col("id") < F.col("v")) & (F.least("t", "t2") - F.greatest("s", "s2") > 0))
    return suppressed(ids, met.select(F.col("id").alias("u"), "v").distinct()).select(*spans.columns)
