"""Accuracy of extracted plans against the truth: walls covered, openings matched, rooms compared, reports.

Relations as in ``annotated``, from truth and extraction; ``scales``: plan_id, ppm of the truth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwright.functions import geometry as G
from planwright.operators.annotated import DIRECTION, _on_walls, kept, wall_geometry

#: Distance within which openings match, in metres; cosine of parallel walls; step of probes in pixels.
NEAR, PARALLEL, STEP = 0.6, 0.96, 2
#: Shares of a wall that make it found, or a false one.
FOUND, FALSE = 0.8, 0.5


def _segment_distance(p: Column, a: Column, direction: Column, length: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(length, G.dot(G.sub(p, a), direction)))
    return G.distance(p, G.add(a, G.scale(direction, t)))


def coverage(walls: DataFrame, by: DataFrame) -> DataFrame:
    """Share of each wall's centre line that parallel walls of ``by`` cover, and the one that covers most.

    Rows: plan_id, id, kind, share, best_id, best_kind.  Every wall is probed each STEP pixels; walls meet
    within a plan where their boxes do.
    """
    cols = ("a", "b", "dir", "length_px", "thickness_px")
    one = kept(wall_geometry(walls)).where("length_px IS NOT NULL").select("plan_id", "id", "ord", "kind", *cols)
    two = kept(wall_geometry(by)).where("length_px IS NOT NULL").select("plan_id", F.col("id").alias("id2"), F.col("ord").alias("ord2"), F.col("kind").alias("kind2"), *[F.col(c).alias(f"{c}2") for c in cols])
    reach = F.greatest(F.lit(3.0), 0.6 * F.greatest("thickness_px", "thickness_px2"))
    near = [(F.least(F.col("a")[c], F.col("b")[c]) <= F.greatest(F.col("a2")[c], F.col("b2")[c]) + reach) & (F.least(F.col("a2")[c], F.col("b2")[c]) <= F.greatest(F.col("a")[c], F.col("b")[c]) + reach) for c in ("x", "z")]
    pairs = one.join(two, "plan_id").where((F.abs(G.dot(F.col("dir"), F.col("dir2"))) > PARALLEL) & near[0] & near[1])
    probes = F.sequence(F.lit(0), F.floor(F.col("length_px") / STEP).cast("int"))
    hits = pairs.withColumn("k", F.explode(probes)).where(_segment_distance(G.add(F.col("a"), G.scale(F.col("dir"), F.col("k") * STEP)), F.col("a2"), F.col("dir2"), F.col("length_px2")) <= reach)
    n = F.floor(F.col("length_px") / STEP) + 1
    each = hits.groupBy("plan_id", "id", "id2", "ord2", "kind2").agg(F.count(F.lit(1)).alias("c"))
    best = each.groupBy("plan_id", "id").agg(F.max_by(F.struct("id2", "kind2"), F.struct("c", -F.col("ord2"))).alias("best"))
    any_ = hits.groupBy("plan_id", "id").agg(F.count_distinct("k").alias("hit"))
    d = one.join(any_, ["plan_id", "id"], "left").join(best, ["plan_id", "id"], "left")
    return d.select("plan_id", "id", "kind", (F.coalesce("hit", F.lit(0)) / n).alias("share"), F.col("best.id2").alias("best_id"), F.col("best.kind2").alias("best_kind"))


def wall_metrics(truth: DataFrame, extracted: DataFrame) -> DataFrame:
    """Counts, precision and recall of each plan's walls, and how many found ones have the right kind."""
    t = coverage(truth, extracted).groupBy("plan_id").agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("share") >= FOUND).alias("detected"), F.count_if((F.col("share") >= FOUND) & F.col("best_kind").eqNullSafe(F.col("kind"))).alias("kind_correct"))
    e = coverage(extracted, truth).groupBy("plan_id").agg(F.count(F.lit(1)).alias("extracted"), F.count_if(F.col("share") < FALSE).alias("false_positives"))
    d = t.join(e, "plan_id", "full").fillna(0)
    return d.withColumn("precision", F.when(F.col("extracted") > 0, (F.col("extracted") - F.col("false_positives")) / F.col("extracted")).otherwise(0.0)).withColumn("recall", F.col("detected") / F.greatest("expected", F.lit(1)))


def opening_geometry(openings: DataFrame, walls: DataFrame) -> DataFrame:
    """Openings with centre, width in pixels and the point of their hinge; those without a wall drop out."""
    d = kept(_on_walls(openings, kept(wall_geometry(walls))))
    at = lambda t: G.add(F.col("a"), G.scale(F.col("dir"), t))
    d = d.withColumns({"center": at((F.col("from") + F.col("to")) / 2), "width_px": F.col("to") - F.col("from")})
    return d.withColumn("hinge_at", at(F.when(F.col("hinge") == "min", F.col("from")).otherwise(F.col("to")))) if "hinge" in openings.columns else d


def opening_matches(truth: DataFrame, truth_walls: DataFrame, extracted: DataFrame, extracted_walls: DataFrame, scales: DataFrame) -> DataFrame:
    """Matches (plan_id, id, match_id, gap, width_error in metres, swing_correct), one to one.

    Truth's openings choose in their order, each the nearest within NEAR that is left, the first in
    extraction's order among equals.  Only near pairs reach that choice: centres lie in cells of NEAR
    and meet through neighbouring cells, so a plan's choice runs over few rows.
    """
    t, e = opening_geometry(truth, truth_walls).join(scales.select("plan_id", "ppm"), "plan_id"), opening_geometry(extracted, extracted_walls).join(scales.select("plan_id", "ppm"), "plan_id")
    cell = lambda c: F.floor(F.col("center")[c] / F.col("ppm") / NEAR)
    extra = [c for c in ("kind", "swing", "hinge_at") if c in t.columns and c in e.columns]
    around = F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("z") + j).alias("cz")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    t = t.withColumn("c", F.explode(around)).select("plan_id", "ppm", "c.cx", "c.cz", "id", "ord", "center", "width_px", *extra)
    e = e.select("plan_id", cell("x").alias("cx"), cell("z").alias("cz"), F.col("id").alias("id2"), F.col("ord").alias("ord2"), F.col("center").alias("center2"), F.col("width_px").alias("width2"), *[F.col(c).alias(f"{c}2") for c in extra])
    p = t.join(e, ["plan_id", "cx", "cz"]).withColumn("gap", G.distance(F.col("center"), F.col("center2")) / F.col("ppm")).where(F.col("gap") <= NEAR)
    swing = F.lit(None).cast("boolean")
    if "hinge_at" in extra:
        table = F.create_map(*[x for k, (x, z) in DIRECTION.items() for x in (F.lit(k), G.point(F.lit(x), F.lit(z)))])
        right = (G.dot(table[F.col("swing")], table[F.col("swing2")]) > 0) & (G.distance(F.col("hinge_at"), F.col("hinge_at2")) / F.col("ppm") < 0.25)
        swing = F.when((F.col("kind") == "hinged") & (F.col("kind2") == "hinged"), right)
    p = p.select("plan_id", F.struct("ord", "id").alias("t"), F.struct("gap", "ord2", "id2", (F.abs(F.col("width2") - F.col("width_px")) / F.col("ppm")).alias("width_error"), swing.alias("swing_correct")).alias("c"))
    rows = p.groupBy("plan_id", "t").agg(F.sort_array(F.collect_list("c")).alias("cs")).groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("t", "cs"))).alias("rows"))
    start = F.struct(F.array().cast("array<struct<id:string,match_id:string,gap:double,width_error:double,swing_correct:boolean>>").alias("out"), F.array().cast("array<string>").alias("used"))

    def choose(acc: Column, row: Column) -> Column:
        free = F.filter(row["cs"], lambda c: ~F.array_contains(acc["used"], c["id2"].cast("string")))
        c = F.get(free, 0)
        one = F.struct(row["t"]["id"].cast("string").alias("id"), c["id2"].cast("string").alias("match_id"), c["gap"].alias("gap"), c["width_error"].alias("width_error"), c["swing_correct"].alias("swing_correct"))
        return F.struct(F.when(F.size(free) > 0, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"), F.when(F.size(free) > 0, F.array_append(acc["used"], c["id2"].cast("string"))).otherwise(acc["used"]).alias("used"))

    return rows.select("plan_id", F.explode(F.aggregate("rows", start, choose)["out"]).alias("m")).select("plan_id", "m.*")


def opening_metrics(truth: DataFrame, extracted: DataFrame, matches: DataFrame) -> DataFrame:
    """Counts, precision, recall and errors of each plan's doors or windows."""
    t, e = (d.groupBy("plan_id").agg(F.count(F.lit(1)).alias(n)) for d, n in ((truth, "expected"), (extracted, "extracted")))
    m = matches.groupBy("plan_id").agg(F.count(F.lit(1)).alias("detected"), F.avg("gap").alias("position_error"), F.avg("width_error").alias("width_error"), F.count("swing_correct").alias("hinged_compared"), F.count_if("swing_correct").alias("swing_correct"))
    d = t.join(e, "plan_id", "full").join(m, "plan_id", "left").fillna(0, ["expected", "extracted", "detected", "hinged_compared", "swing_correct"])
    return d.withColumns({"false_positives": F.col("extracted") - F.col("detected"), "precision": F.when(F.col("extracted") > 0, F.col("detected") / F.col("extracted")).otherwise(0.0), "recall": F.col("detected") / F.greatest("expected", F.lit(1))})


def room_matches(truth: DataFrame, extracted: DataFrame, least: float = 0.5, cell: float = 1.0) -> DataFrame:
    """Each true room's best room by intersection over union: (plan_id, id, match_id, iou, type_right, label_right).

    Shares are taken on a grid of ``cell`` pixels; the first in extraction's order wins among equals.
    """
    b = lambda c: G.bounds(F.col(c))
    t = truth.select("plan_id", "id", "type", "label_source", "polygon", b("polygon").alias("box"))
    e = extracted.select("plan_id", F.col("id").alias("id2"), F.col("ord").alias("ord2"), F.col("type").alias("type2"), F.col("label_source").alias("source2"), F.col("polygon").alias("polygon2"), b("polygon").alias("box2"))
    near = (F.col("box.min_x") < F.col("box2.max_x")) & (F.col("box2.min_x") < F.col("box.max_x")) & (F.col("box.min_z") < F.col("box2.max_z")) & (F.col("box2.min_z") < F.col("box.max_z"))
    both = G.approximate_overlap(F.col("polygon"), F.col("polygon2"), cell, 1_000_000)
    p = t.join(e, "plan_id").where(near).withColumn("both", both).withColumn("iou", F.col("both") / (G.area(F.col("polygon")) + G.area(F.col("polygon2")) - F.col("both")))
    best = p.groupBy("plan_id", "id").agg(F.max_by(F.struct("id2", "iou", "type2", "source2"), F.struct("iou", -F.col("ord2"))).alias("m"))
    d = truth.select("plan_id", "id", "type", "label_source").join(best, ["plan_id", "id"], "left")
    iou = F.coalesce("m.iou", F.lit(0.0))
    right = (iou >= least) & F.col("m.type2").eqNullSafe(F.col("type"))
    labelled = F.when((iou >= least) & (F.col("label_source") == "plan-label"), right & (F.col("m.source2") == "plan-label"))
    return d.select("plan_id", "id", F.when(iou >= least, F.col("m.id2")).alias("match_id"), F.round(iou, 4).alias("iou"), right.alias("type_right"), labelled.alias("label_right"))


def room_metrics(matches: DataFrame) -> DataFrame:
    """Rates of each plan's rooms; types are judged over matched rooms, labels over matched rooms with a printed one."""
    hit = F.col("match_id").isNotNull()
    g = matches.groupBy("plan_id").agg(F.count(F.lit(1)).alias("expected"), F.count_if(hit).alias("matched"), F.avg(F.when(hit, F.col("iou"))).alias("mean_iou"), F.min(F.when(hit, F.col("iou"))).alias("min_iou"), F.avg("iou").alias("mean_iou_all"), F.count_if("type_right").alias("types_right"), F.count("label_right").alias("labelled"), F.count_if("label_right").alias("labels_right"))
    return g.withColumns({"detection_rate": F.col("matched") / F.greatest("expected", F.lit(1)), "classification_accuracy": F.try_divide("types_right", "matched"), "label_accuracy": F.try_divide("labels_right", "labelled")})


def _percent(x: Column) -> Column:
    return F.coalesce(F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit(" %")), F.lit("—"))


def report_rows(outcomes: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Lines of a Markdown table of outcomes, by category and id: (ord, line).

    ``outcomes``: id, category, status, seconds, rooms, wall_precision, wall_recall, room_rate, door_precision,
    door_recall; figures that were not taken show as a dash.
    """
    rank = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    cells = [F.col("id"), F.col("category"), F.col("status"), F.format_string("%.1f", F.col("seconds")), F.col("rooms").cast("string")]
    cells += [F.concat(_percent(F.col("wall_precision")), F.lit(" / "), _percent(F.col("wall_recall"))), _percent(F.col("room_rate")), F.concat(_percent(F.col("door_precision")), F.lit(" / "), _percent(F.col("door_recall")))]
    order = Window.orderBy(F.coalesce(rank[F.col("category")], F.lit(len(ranks))), "id")
    return outcomes.select(F.row_number().over(order).alias("ord"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def problem_counts(problems: DataFrame) -> DataFrame:
    """Plans affected and problems in all by category, without mere information."""
    return problems.where("severity <> 'info'").groupBy("category").agg(F.count_distinct("plan_id").alias("plans"), F.count(F.lit(1)).alias("problems"))
