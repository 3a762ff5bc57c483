"""Reading a plan's words: lines, room names, dimensions, areas and floor labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwright.functions import labels as L
from planwright.functions import lexicon as X


def group_lines(words: DataFrame) -> DataFrame:
    """Text lines of each plan: (plan_id, line, text, n_words, x0, y0, x1, y1, confidence), in reading order.

    ``words``: plan_id, ord, text, confidence, x0, y0, x1, y1.  Bands are anchored by the tallest
    words first, which is sequential, so a plan is one small group; lines are split at gaps over 1.6
    times the band's median height.
    """
    banded = words.where(F.trim("text") != "").groupBy("plan_id").applyInPandas(_bands, "plan_id string, ord long, text string, confidence double, x0 double, y0 double, x1 double, y1 double, band int")
    h = F.col("y1") - F.col("y0")
    in_band = Window.partitionBy("plan_id", "band").orderBy("x0", "ord")
    heights = banded.groupBy("plan_id", "band").agg(F.sort_array(F.collect_list(h)).alias("hs"))
    height = F.get("hs", F.floor(F.size("hs") / 2).cast("int"))
    d = banded.join(heights.select("plan_id", "band", height.alias("h")), ["plan_id", "band"])
    gap = F.col("x0") - F.lag("x1").over(in_band)
    d = d.withColumn("cut", F.sum(F.when(gap > 1.6 * F.col("h"), 1).otherwise(0)).over(in_band))
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    ordered = F.sort_array(F.collect_list(F.struct("x0", "ord", "text")))
    lines = d.groupBy("plan_id", "band", "cut").agg(F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"), F.count(F.lit(1)).alias("n_words"), *box, F.min("confidence").alias("confidence"))
    place = F.row_number().over(Window.partitionBy("plan_id").orderBy("y0", "x0", "band", "cut"))
    return lines.select("plan_id", place.alias("line"), "text", "n_words", "x0", "y0", "x1", "y1", "confidence")


def _bands(group: pd.DataFrame) -> pd.DataFrame:
    """Numbers the bands of one plan; the smaller height decides whether centres agree."""
    group = group.assign(h=group.y1 - group.y0, plan_id=group.plan_id.astype(str)).sort_values(["h", "ord"], ascending=[False, True], kind="stable")
    found: list[tuple[float, float]] = []
    bands = []
    for h, y in zip(group.h, (group.y0 + group.y1) / 2, strict=True):
        k = next((i for i, (at, tall) in enumerate(found) if abs(y - at) < 0.5 * min(h, tall)), len(found))
        if k == len(found):
            found.append((y, h))
        bands.append(k)
    return group.assign(band=bands).drop(columns="h")[["plan_id", "ord", "text", "confidence", "x0", "y0", "x1", "y1", "band"]]


def _shown(names: Column) -> Column:
    """Names in order, each once; a master bedroom stands for a bedroom; numbers follow a name."""

    def add(seen: Column, n: Column) -> Column:
        master, plain = F.lit("Master Bedroom"), F.lit("Bedroom")
        here = F.array_contains(seen, n["shown"]) | ((n["shown"] == plain) & F.array_contains(seen, master))
        swapped = F.transform(seen, lambda s, i: F.when(i == F.array_position(seen, plain) - 1, master).otherwise(s))
        named = F.when(here, seen).when((n["shown"] == master) & F.array_contains(seen, plain), swapped).otherwise(F.array_append(seen, n["shown"]))
        numbered = F.when(F.size(seen) > 0, F.array_append(seen, n["shown"])).otherwise(seen)
        return F.when(n["number"], numbered).otherwise(named)

    return F.aggregate(names, F.array().cast("array<string>"), add)


def nearest_words(tokens: DataFrame, token: str = "token") -> DataFrame:
    """Rows (token, best) of the tokens near a word of the vocabulary: best is the least (edits, ord, ...).

    The tokens are made distinct first.  The vocabulary is a table of fixed size, a row for every
    length that a word's edits allow, and meets the tokens on the length; the edit distance stops at 2.
    """
    words = [
        (length, i, w, t, s or w.capitalize(), float(g), bound)
        for i, (w, t, s, g) in enumerate(X.LEXICON)
        for bound in (0 if len(w) <= 3 else 1 if len(w) <= 5 else 2,)
        for length in range(len(w) - bound, len(w) + bound + 1)
    ]
    vocabulary = tokens.sparkSession.createDataFrame(words, "length int, ord int, word string, type string, shown string, weight double, bound int")
    own = tokens.select(F.col(token).alias("token")).distinct().withColumn("own", L.as_letters(F.col("token")))
    d = own.join(F.broadcast(vocabulary), F.length("own") == F.col("length")).withColumn("edits", F.levenshtein("own", "word", 2))
    d = d.where(F.col("edits").between(0, F.col("bound")))
    best = F.struct("edits", "ord", "word", "type", "shown", "weight", (F.col("own") != F.col("token")).cast("int").alias("changed"))
    return d.groupBy("token").agg(F.min(best).alias("best"))


def room_names(lines: DataFrame, key: list[str], text: str = "text", confidence: str = "confidence") -> DataFrame:
    """Room names among labels: key, raw, words, display, type, confidence, type_weight, corrections.

    Every distinct token is held against the vocabulary once, then joined back to the labels it
    occurs in.  Labels that name no room, or have more unknown words than known ones, give no row.
    """
    base = lines.select(*key, F.col(text).alias("raw"), F.col(confidence).alias("given"))
    tokens = base.select(*key, "raw", "given", F.posexplode(L.label_tokens(F.col("raw"))).alias("pos", "token"))
    number = F.col("token").rlike(r"^\d{1,2}$")
    known = tokens.where(~number & (F.length("token") >= 2)).select("token")
    known = nearest_words(known)
    d = tokens.join(known, "token", "left").withColumn("number", number)
    odd = F.col("best").isNull() & F.col("token").rlike("^[A-Z]{3,}$") & ~F.col("token").isin(*X.NEUTRAL_WORDS)
    part = F.when(F.col("number") | F.col("best").isNotNull(), F.struct("pos", F.col("number").alias("number"), F.coalesce("best.shown", "token").alias("shown"), F.col("best.word").alias("word"), F.col("best.type").alias("type")))
    g = d.groupBy(*key, "raw", "given").agg(
        F.sort_array(F.collect_list(part)).alias("parts"), F.count_if(odd).alias("unmatched"), F.count("best").alias("n"), F.min("best.weight").alias("type_weight"),
        F.coalesce(F.sum(F.col("best.edits") + F.col("best.changed")), F.lit(0)).alias("corrections"),
    ).where((F.col("n") > 0) & (F.col("unmatched") <= F.col("n")))
    matched = F.filter("parts", lambda p: ~p["number"])
    types = F.array_distinct(F.transform(matched, lambda p: p["type"]))
    g = g.withColumn("types", types).withColumn("known", F.sort_array(F.filter("types", lambda t: t != "unknown")))
    both = (F.size("types") > 1) & (F.size("known") > 1)
    shown = F.array_join(_shown(F.col("parts")), "\u0001")
    display = F.regexp_replace(F.replace(shown, F.lit("\u0001"), F.when(both, F.lit(" / ")).otherwise(F.lit(" "))), r" / (\d+)", " $1")
    score = F.round(F.col("given") * F.greatest(F.lit(0.3), 1 - 0.12 * F.col("corrections")), 3)
    return g.select(*key, "raw", F.transform(matched, lambda p: p["word"]).alias("words"), display.alias("display"), _combined(F.col("known")).alias("type"), score.alias("confidence"), "type_weight", F.col("corrections").cast("long").alias("corrections"))


def _combined(known: Column) -> Column:
    """The type of a label from the sorted distinct types it names."""
    table = F.create_map(*[F.lit(x) for pair in X.COMBINED_TYPES.items() for x in pair])
    several = F.coalesce(F.try_element_at(table, F.array_join(known, "+")), F.when(F.array_contains(known, "kitchen"), F.lit("kitchen-living")).otherwise(F.lit("unknown")))
    return F.when(F.size(known) == 0, F.lit("unknown")).when(F.size(known) == 1, F.get(known, 0)).otherwise(several)


def combined_names(matches: DataFrame, room: list[str], ord_col: str) -> DataFrame:
    """One name per room from all that stand in it; ``plausible`` unless they belong to several rooms."""
    first = F.row_number().over(Window.partitionBy(*room, "display").orderBy(ord_col))
    m = matches.withColumn("_k", first)
    one = F.struct(ord_col, "raw", "words", "display", "type", "confidence", "type_weight", "corrections")
    g = m.groupBy(*room).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("_k") == 1, one))).alias("d"))
    types = F.sort_array(F.array_distinct(F.filter(F.transform("d", lambda x: x["type"]), lambda t: t != "unknown")))
    g = g.withColumn("types", types)
    flat = F.flatten(F.transform("types", lambda t: F.when(t == "kitchen-living", F.array(F.lit("kitchen"), F.lit("living"))).otherwise(F.array(t))))
    key = F.array_join(F.sort_array(F.array_distinct(flat)), "+")
    table = F.create_map(*[F.lit(x) for pair in X.COMBINED_TYPES.items() for x in pair])
    open_plan = F.forall("types", lambda t: t.isin(*X.OPEN_PLAN))
    several = F.when(F.size("types") == 1, F.get("types", 0)).when(open_plan, F.coalesce(F.try_element_at(table, key), F.lit("kitchen-living"))).otherwise(F.lit("unknown"))
    alone = F.size("d") == 1
    join = lambda f: F.array_join(F.transform("d", lambda x: x[f]), " / ")
    least = lambda f: F.array_min(F.transform("d", lambda x: x[f]))
    return g.select(
        *room, join("raw").alias("raw"), F.flatten(F.transform("d", lambda x: x["words"])).alias("words"), join("display").alias("display"), F.when(alone, F.get("d", 0)["type"]).otherwise(several).alias("type"),
        least("confidence").alias("confidence"), least("type_weight").alias("type_weight"), F.aggregate("d", F.lit(0).cast("long"), lambda a, x: a + x["corrections"]).alias("corrections"),
        F.when(alone, F.col("n") == 1).otherwise(open_plan).alias("plausible"),
    )


def read_lines(lines: DataFrame) -> DataFrame:
    """What each line says: kind (area, floor, dimension, unread or text), value, label and dimension.

    A line is an area or a floor label before it is a dimension; ``unread`` lines look like
    dimensions and are worth a second reading, whose words enter as further lines; of a plan's
    areas and floor labels the first in reading order count, told by ``first``.
    """
    area, floor, dimension = L.parse_area(F.col("text")), L.parse_floor(F.col("text")), L.parse_dimension(F.col("text"))
    d = lines.withColumns({"area": area, "floor": floor, "dimension": dimension})
    said = F.col("area").isNotNull() | F.col("floor").isNotNull()
    kind = F.when(F.col("area").isNotNull(), "area").when(F.col("floor").isNotNull(), "floor").when(F.col("dimension").isNotNull(), "dimension").when(L.looks_like_dimension(F.col("text")), "unread").otherwise("text")
    by = Window.partitionBy("plan_id")
    first = ((F.col("line") == F.min(F.when(F.col("area").isNotNull(), F.col("line"))).over(by)) & F.col("area").isNotNull()) | ((F.col("line") == F.min(F.when(F.col("floor").isNotNull(), F.col("line"))).over(by)) & F.col("floor").isNotNull())
    return d.select("plan_id", "line", "text", "confidence", kind.alias("kind"), "area", "floor", F.when(~said, F.col("dimension")).alias("dimension"), F.coalesce(first, F.lit(False)).alias("first"))


def label_recall(found: DataFrame, expected: DataFrame, by: str) -> DataFrame:
    """Share of each plan's expected labels that a found text holds or is held by, both normalised."""
    f = found.select(by, L.normalized(F.col("label")).alias("f")).where("f <> ''").distinct().groupBy(by).agg(F.collect_set("f").alias("fs"))
    e = expected.select(by, L.normalized(F.col("label")).alias("e")).join(f, by, "left")
    hit = F.exists(F.coalesce("fs", F.array().cast("array<string>")), lambda x: F.contains(x, F.col("e")) | F.contains(F.col("e"), x))
    return e.groupBy(by).agg(F.count(F.lit(1)).alias("expected"), F.count_if(hit).alias("hits")).withColumn("recall", F.col("hits") / F.col("expected"))

