"""Review of extracted plans: problems with category and impact, the plan's status, and its parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwright.operators.rules import union_rules

#: Confidences below which an element is uncertain, and the categories of problems.
THRESHOLDS = {"wall": 0.6, "door": 0.6, "window": 0.6, "room": 0.6, "swing": 0.5, "geometry": 0.7}
CATEGORIES = ("wall_detection", "room_detection", "room_boundary", "room_label", "room_classification", "door_detection", "window_detection", "scale", "annotation_conflict", "unsupported_symbol", "image_quality", "structural_ambiguity")
COLUMNS = ("plan_id", "severity", "code", "category", "impact", "element_id")
FAILURE, UNCERTAIN, MEANING, OPTIONAL = "geometry-failure", "geometry-uncertain", "semantic-uncertainty", "missing-optional"


def category_of(code: Column) -> Column:
    """Category of a structural issue, by the element that its code names."""
    starts = lambda *names: F.lit(False) if not names else code.rlike("^(?:" + "|".join(names) + ")")
    return (
        F.when(code.contains("scale") | starts("dimension"), "scale").when(starts("room", "footprint", "envelope"), "room_boundary").when(starts("wall"), "wall_detection")
        .when(starts("door"), "door_detection").when(starts("window"), "window_detection").otherwise("annotation_conflict")
    )


def room_titles(rooms: DataFrame) -> DataFrame:
    """A room's printed name in quotes, or its number in the plan."""
    return rooms.select("plan_id", "id", F.when(F.col("label_source") == "plan-label", F.concat(F.lit('"'), "name", F.lit('"'))).otherwise(F.concat(F.lit("Room "), (F.col("ord") + 1).cast("string"))).alias("title"))


def _problems(df: DataFrame, element: str | None, rules: dict[str, tuple[str, str, str, Column]]) -> DataFrame:
    """One row per rule (severity, category, impact, when) that a row breaks."""
    hits = F.array_compact(F.array(*[F.when(broken, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), F.lit(g).alias("category"), F.lit(i).alias("impact"))) for c, (s, g, i, broken) in rules.items()]))
    name = F.col(element) if element else F.lit(None)
    return df.select("plan_id", F.explode(hits).alias("h"), name.cast("string").alias("element_id")).select("plan_id", "h.severity", "h.code", "h.category", "h.impact", "element_id")


def problems(plans: DataFrame, issues: DataFrame, walls: DataFrame, rooms: DataFrame, doors: DataFrame, windows: DataFrame, fixtures: DataFrame, scales: DataFrame, unplaced: DataFrame, stage: DataFrame | None = None, limits: dict[str, float] = THRESHOLDS) -> DataFrame:
    """All problems of all plans: (plan_id, severity, code, category, impact, element_id).

    ``issues`` come from the annotation checks, ``stage`` from earlier stages (same columns as the result);
    ``scales``: plan_id, strategy, samples_rejected; ``unplaced``: plan_id, text, labels outside all rooms;
    ``plans``: plan_id, document_verdict.  Geometry and meaning are judged apart: a name that can't be
    read never blocks a sound outline.  A room that an earlier problem names isn't reported again for
    its outline.
    """
    one = F.lit(1.0)
    single = F.col("code") == "single-scale-reference"
    structural = issues.where("code <> 'estimated-scale'").select(
        "plan_id", F.when(F.col("severity") == "error", "error").otherwise("warning").alias("severity"), F.concat(F.lit("annotation-"), "code").alias("code"), category_of(F.col("code")).alias("category"),
        F.when(F.col("severity") == "error", FAILURE).when(single, MEANING).otherwise(UNCERTAIN).alias("impact"), "element_id",
    )
    before = structural if stage is None else union_rules(stage.select(*COLUMNS), structural)
    bare = plans.join(rooms.select("plan_id").distinct(), "plan_id", "left_anti")
    none = _problems(bare, None, {"no-rooms": ("error", "room_detection", FAILURE, F.lit(True))})
    weak = walls.where(F.coalesce("confidence", one) < limits["wall"]).select("plan_id").distinct()
    thin = _problems(weak, None, {"low-confidence-walls": ("warning", "wall_detection", UNCERTAIN, F.lit(True))})

    named = before.where("element_id IS NOT NULL").select("plan_id", F.col("element_id").alias("id")).distinct().withColumn("mentioned", F.lit(True))
    r = rooms.join(named, ["plan_id", "id"], "left")
    source, read = F.col("label_source"), F.coalesce("label_confidence", "confidence", one)
    printed = ~source.isin("unknown", "inferred")
    room = _problems(r, "id", {
        "uncertain-room-boundary": ("warning", "room_boundary", UNCERTAIN, (F.coalesce("geometry_confidence", one) < limits["geometry"]) & F.col("mentioned").isNull()),
        "unnamed-room": ("warning", "room_label", MEANING, source == "unknown"),
        "inferred-room": ("info", "room_classification", MEANING, source == "inferred"),
        "uncertain-room-label": ("warning", "room_label", MEANING, printed & (read < limits["room"])),
        "unclassified-label": ("warning", "room_classification", MEANING, printed & (F.col("type") == "unknown")),
    })
    sure = F.coalesce("confidence", one)
    plain = F.col("kind") == "opening"
    door = _problems(doors, "id", {
        "unclassified-opening": ("warning", "door_detection", MEANING, plain), "possible-door": ("warning", "door_detection", MEANING, ~plain & (sure < limits["door"])),
        "uncertain-swing": ("warning", "door_detection", MEANING, ~plain & (sure >= limits["door"]) & (F.coalesce("swing_confidence", one) < limits["swing"])),
    })
    window = _problems(windows, "id", {"possible-window": ("warning", "window_detection", MEANING, sure < limits["window"])})
    scale = _problems(scales, None, {
        "scale-estimated": ("warning", "scale", UNCERTAIN, F.col("strategy") == "estimated"), "scale-manual": ("info", "scale", OPTIONAL, F.col("strategy") == "manual"),
        "dimension-mismatch": ("warning", "scale", MEANING, F.col("samples_rejected") > 0),
    })
    lost = _problems(unplaced, None, {"label-outside-rooms": ("warning", "room_detection", UNCERTAIN, F.lit(True))})
    bald = _problems(plans.join(fixtures.select("plan_id").distinct(), "plan_id", "left_anti"), None, {"no-fixtures": ("info", "unsupported_symbol", OPTIONAL, F.lit(True))})
    paper = _problems(plans, None, {"document-uncertain": ("warning", "image_quality", UNCERTAIN, F.col("document_verdict") != "LIKELY_FLOOR_PLAN")})
    return union_rules(before, none, thin, room, lost, door, window, scale, bald, paper)


def statuses(plans: DataFrame, found: DataFrame) -> DataFrame:
    """Status of each plan from its problems: failed, needs-review, ok-with-warnings or ok."""
    told = F.col("severity") != "info"
    rank = F.when(F.col("impact") == FAILURE, 3).when((F.col("impact") == UNCERTAIN) & told, 2).when(told, 1).otherwise(0)
    g = found.groupBy("plan_id").agg(F.max(rank).alias("rank"), F.count(F.lit(1)).alias("n_problems"))
    d = plans.select("plan_id").join(g, "plan_id", "left").fillna(0, ["rank", "n_problems"])
    return d.select("plan_id", F.element_at(F.array(*map(F.lit, ("ok", "ok-with-warnings", "needs-review", "failed"))), F.col("rank") + 1).alias("status"), "n_problems")


def components(plans: DataFrame, found: DataFrame, walls: DataFrame, rooms: DataFrame, doors: DataFrame, windows: DataFrame, scales: DataFrame) -> DataFrame:
    """Status and confidence of each part of each plan: (plan_id, component, status, confidence, n).

    ``scales``: plan_id, strategy, confidence (high, medium or low).
    """
    told = F.col("severity") != "info"
    broken = F.col("impact") == FAILURE
    flag = lambda *c: F.max((told & F.col("category").isin(*c)).cast("int"))
    fail = lambda *c: F.max((broken & F.col("category").isin(*c, "structural_ambiguity", "image_quality")).cast("int"))
    flags = found.groupBy("plan_id").agg(
        flag("wall_detection", "annotation_conflict").alias("walls_flag"), fail("wall_detection").alias("walls_fail"), flag("room_detection", "room_boundary").alias("rooms_flag"), fail("room_detection", "room_boundary").alias("rooms_fail"),
        flag("room_label", "room_classification").alias("labels_flag"), flag("door_detection").alias("doors_flag"), flag("window_detection").alias("windows_flag"),
    )
    one = F.lit(1.0)
    sure = F.coalesce("confidence", one)
    counted = lambda df, name, c, *more: df.groupBy("plan_id").agg(F.count(F.lit(1)).alias(f"{name}_n"), F.avg(c).alias(f"{name}_c"), *more)
    guess = F.coalesce("classification_confidence", F.when(F.col("type") == "unknown", 0.0).otherwise(sure))
    parts = [counted(walls, "walls", sure), counted(rooms, "rooms", F.coalesce("geometry_confidence", "confidence", one), F.avg(guess).alias("labels_c"), F.count_if(F.col("label_source") == "plan-label").alias("named"), F.count_if(F.col("type") != "unknown").alias("typed")), counted(doors, "doors", sure), counted(windows, "windows", sure)]
    d = plans.select("plan_id").join(flags, "plan_id", "left")
    for p in parts:
        d = d.join(p, "plan_id", "left")
    d = d.join(scales.select("plan_id", "strategy", F.col("confidence").alias("grade")), "plan_id", "left")
    whole = [c for c in d.columns if c.endswith(("_flag", "_fail", "_n")) or c in ("named", "typed")]
    d = d.fillna(0, whole).fillna(0.0, [c for c in d.columns if c.endswith("_c")])

    def judged(name: str) -> Column:
        good = F.when(F.col(f"{name}_flag") == 1, "uncertain").otherwise("good")
        return F.when((F.col(f"{name}_n") == 0) | (F.col(f"{name}_fail") == 1), "failed").otherwise(good)

    seen = lambda name: F.when(F.col(f"{name}_n") == 0, "missing").when(F.col(f"{name}_flag") == 1, "uncertain").otherwise("good")
    labels = F.when((F.col("rooms_n") == 0) | (F.col("typed") == 0), "missing").when((F.col("named") < F.col("rooms_n")) | (F.col("labels_flag") == 1), "uncertain").otherwise("good")
    scale = F.when(F.col("strategy").isNull(), "missing").when((F.col("strategy") == "estimated") | (F.col("grade") == "low"), "uncertain").otherwise("good")
    trust = F.when(F.col("strategy").isNull(), 0.0).when(F.col("grade") == "high", 0.95).when(F.col("grade") == "medium", 0.75).otherwise(0.4)
    row = lambda name, status, c, n: F.struct(F.lit(name).alias("component"), status.alias("status"), F.round(c, 3).alias("confidence"), n.cast("long").alias("n"))
    rows = F.array(
        row("walls", judged("walls"), F.col("walls_c"), F.col("walls_n")), row("rooms", judged("rooms"), F.col("rooms_c"), F.col("rooms_n")), row("roomLabels", labels, F.col("labels_c"), F.col("named")),
        row("doors", seen("doors"), F.col("doors_c"), F.col("doors_n")), row("windows", seen("windows"), F.col("windows_c"), F.col("windows_n")), row("scale", scale, trust, F.when(F.col("strategy").isNull(), 0).otherwise(1)),
    )
    return d.select("plan_id", F.explode(rows).alias("c")).select("plan_id", "c.*")
