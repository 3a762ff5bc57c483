"""Sentences as intents: which rooms and furniture they mean, which finishes, and what is to be done."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, types
from pyspark.sql import functions as F

from planwright.functions import finishes as X
from planwright.functions.geometry import let
from planwright.sources.furniture import ITEMS

#: Most pieces of one kind that a mention counts.
MOST = 8
#: What a sentence that can't be followed is answered with.
ASKS = {
    "fit": "Which room should I check?", "renovate": "Which room should I renovate?", "finish": 'I could not tell which finish to change. Try "oak flooring" or "light beige walls".',
    "place": "Which room should it go in?", "else": "I can place furniture, check whether something fits, remove furniture, or renovate a room.",
}
FIELDS = ("floorMaterialId", "wallMaterialId", "ceilingMaterialId", "wallColor", "lighting")
INTENT = "struct<action:string,room_ids:array<string>,furniture:array<string>,preset:string,patch:map<string,string>,placement:string,reason:string>"


@functools.cache
def _phrases() -> list[tuple[str, re.Pattern, str]]:
    """All names and keywords of the catalogue with their patterns, longest first."""
    named = [(p, item[0]) for item in ITEMS for p in (item[1].lower(), *item[4])]
    number = "|".join(X.NUMBER_WORDS)
    return [(p, re.compile(rf"(?:\b(\d|{number})\s+)?\b{re.escape(p)}(?:e?s)?(?:\s+{X.NOUNS})?\b", re.ASCII), i) for p, i in sorted(named, key=lambda x: -len(x[0]))]


def _mentioned(text: str | None) -> list[str]:
    """Furniture in the order of its mentions; a longer phrase claims its words before shorter ones are tried."""
    t = " " + re.sub("[,.!?;]", " ", (text or "").lower()) + " "
    claimed: list[tuple[int, int]] = []
    found = []
    for phrase, pattern, item in _phrases():
        # most phrases don't occur, which is cheaper to see without their pattern
        for m in pattern.finditer(t) if phrase in t else ():
            if not any(m.start() < b and a < m.end() for a, b in claimed):
                claimed.append(m.span())
                count = m[1] or "1"
                found.append((m.start(), item, min(max(int(count) if count.isdigit() else X.NUMBER_WORDS[count], 1), MOST)))
    return [item for _, item, n in sorted(found) for _ in range(n)]


@F.pandas_udf(types.ArrayType(types.StringType()))
def mentioned_furniture(text: pd.Series) -> pd.Series:
    return text.map(_mentioned)


def _first(text: Column, table: tuple) -> Column:
    out = F.lit(None).cast("string")
    for pattern, value in reversed(table):
        out = F.when(text.rlike(pattern), value).otherwise(out)
    return out


def finish_patch(text: Column) -> Column:
    """The finishes that a sentence names, as a map; empty if none.

    A surface takes the words of its own clause, else those of the next, unless that is about another surface.
    """
    def clauses(parts: Column, k: int) -> Column:
        def around(about: Column) -> Column:
            own, after = F.get(parts, about - 1), F.get(parts, about)
            other = F.lit(False)
            for j, s in enumerate(X.SUBJECTS):
                other = other | after.rlike(s) if j != k else other
            return F.struct(F.when(about > 0, own).alias("own"), F.when((about > 0) & ~other, after).alias("after"))

        return let(F.array_position(F.transform(parts, lambda p: p.rlike(X.SUBJECTS[k])), True).cast("int"), around)

    # clauses are found once: Spark would find them again for every word that is looked for
    pick = lambda parts, k, table: let(clauses(parts, k), lambda c: F.coalesce(_first(c["own"], table), _first(c["after"], table)))
    coloured = lambda parts: let(clauses(parts, 1), lambda c: F.regexp_extract(F.concat_ws(" ", c["own"], c["after"]), r"(?i)#[0-9a-f]{6}\b", 0))
    colour = lambda parts: let(coloured(parts), lambda c: F.when(c != "", F.lower(c)))
    values = let(F.split(text, r",|\band\b|\bwith\b|\bto\b|;"), lambda parts: F.array(pick(parts, 0, X.FLOOR_WORDS), pick(parts, 1, X.WALL_WORDS), pick(parts, 2, X.CEILING_WORDS), colour(parts), _first(text, X.LIGHT_WORDS)))
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, FIELDS)), values), lambda _, v: v.isNotNull())


def preset_of(text: Column) -> Column:
    """The first style one of whose keywords occurs."""
    return _first(text, tuple((r"\b(?:" + "|".join(words) + r")\b", i) for i, _, words, _, _ in X.PRESETS))


def preset_patch(preset: Column, room_type: Column) -> Column:
    """What a style changes in a room, as a map: other finishes in wet rooms, nothing outdoors; null for an unknown style."""
    as_map = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    out = F.lit(None).cast("map<string,string>")
    for i, _, _, dry, wet in X.PRESETS:
        finishes = F.when(room_type == "balcony", F.create_map().cast("map<string,string>")).when(room_type.isin("bathroom", "toilet"), as_map(dry | wet)).otherwise(as_map(dry))
        out = F.when(preset == i, finishes).otherwise(out)
    return out


def matched_rooms(text: Column, rooms: Column, selected: Column) -> Column:
    """The rooms a lower-case sentence means: struct of ids and note, or null.

    ``rooms``: array of structs (id, name, type, area) in order.  All rooms, the selected one, the longest name that
    occurs, a bedroom by size or number, a kind of room.
    """
    ids = lambda a: F.transform(a, lambda r: r["id"])
    meant = lambda a, note=None: F.struct(a.alias("ids"), (F.lit(None).cast("string") if note is None else note).alias("note"))
    ranked = F.array_min(F.transform(F.filter(rooms, lambda r: F.contains(text, F.lower(r["name"]))), lambda r, i: F.struct((-F.length(r["name"])).alias("n"), i.alias("i"), r["id"].alias("id"), F.lower(r["name"]).alias("name"))))
    beds = F.transform(F.array_sort(F.transform(F.filter(rooms, lambda r: r["type"] == "bedroom"), lambda r, i: F.struct((-r["area"]).alias("a"), i.alias("i"), r["id"].alias("id"), r["name"].alias("name")))), lambda b: b)
    def chosen(v: Column) -> Column:
        ranked, beds, word, number = (v[k] for k in ("ranked", "beds", "word", "number"))
        place = F.create_map(*[F.lit(x) for pair in X.ORDINALS.items() for x in pair])[number]
        numbered = F.get(F.filter(beds, lambda b: F.endswith(F.lower(b["name"]), F.concat(F.lit(" "), place.cast("string")))), 0)
        least, largest = F.get(beds, F.least(F.lit(1), F.size(beds) - 1)), F.get(beds, 0)
        several = F.format_string("There are %d bedrooms; I used %s (the largest). Say \"%s\" for the other.", F.size(beds), largest["name"], F.get(beds, 1)["name"])
        bedroom = (
            F.when((number != "") & numbered.isNotNull(), meant(F.array(numbered["id"])))
            .when(word.rlike("small|second|spare"), meant(F.array(least["id"]), F.concat(F.lit("Using "), least["name"], F.lit(" (the smaller bedroom)."))))
            .otherwise(meant(F.array(largest["id"]), F.when((F.size(beds) > 1) & (word == ""), several)))
        )
        out = F.when(text.rlike(X.EVERYWHERE), meant(ids(F.filter(rooms, lambda r: r["type"] != "storage")))).when(text.rlike(r"\bhere\b|\bthis room\b") & selected.isNotNull(), meant(F.array(selected)))
        out = out.when(ranked.isNotNull() & (ranked["name"] != "bedroom"), meant(F.array(ranked["id"]))).when(text.rlike(X.BEDROOM) & (F.size(beds) > 0), bedroom)
        for alias, kinds in X.TYPE_ALIASES:
            first = F.get(F.filter(rooms, lambda r: r["type"].isin(*kinds)), 0)  # noqa: B023
            out = out.when(text.rlike(rf"\b{alias}\b") & first.isNotNull(), meant(F.array(first["id"])))
        return out

    found = F.struct(ranked.alias("ranked"), beds.alias("beds"), F.regexp_extract(text, X.BEDROOM, 1).alias("word"), F.regexp_extract(text, X.BEDROOM, 2).alias("number"))
    return let(found, chosen)


def parsed(asked: DataFrame, rooms: DataFrame) -> DataFrame:
    """The intents of each sentence: ask_id and ``intents``, an array of structs (see INTENT); empty for an empty sentence.

    ``asked``: ask_id, plan_id, text, selected_room_id or null; ``rooms``: plan_id, room_id, ord, name, type, area.
    """
    one = F.struct("ord", F.col("room_id").alias("id"), "name", "type", "area")
    context = rooms.groupBy("plan_id").agg(F.sort_array(F.collect_list(one)).alias("rooms"))
    d = asked.join(context, "plan_id", "left").withColumn("rooms", F.coalesce("rooms", F.array().cast("array<struct<ord:int,id:string,name:string,type:string,area:double>>")))
    d = d.withColumn("t", F.lower(F.trim(F.coalesce("text", F.lit(""))))).withColumn("furniture", mentioned_furniture("t"))
    t, furniture, selected = F.col("t"), F.col("furniture"), F.col("selected_room_id")
    d = d.withColumns({"meant": matched_rooms(t, F.col("rooms"), selected), "patch": finish_patch(t), "preset": preset_of(t)})
    kinds = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)).cast("array<string>") for item in ITEMS for x in (item[0], item[11])])[F.get(furniture, 0)]
    suited = F.get(F.filter("rooms", lambda r: F.array_contains(kinds, r["type"])), 0)["id"]
    room = F.coalesce(F.get("meant.ids", 0), selected, suited)
    d = d.withColumns({"room": room})
    room, patch, preset = F.col("room"), F.col("patch"), F.col("preset")
    null = {k: F.lit(None).cast(k2) for k, k2 in (("room_ids", "array<string>"), ("furniture", "array<string>"), ("preset", "string"), ("patch", "map<string,string>"), ("placement", "string"), ("reason", "string"))}
    intent = lambda action, **more: F.struct(F.lit(action).alias("action"), *[more.get(k, v).alias(k) for k, v in null.items()])
    unknown = lambda why: F.array(intent("unknown", reason=F.lit(ASKS[why])))
    some = F.size(furniture) > 0
    check = F.when(room.isNull(), unknown("fit")).otherwise(F.array(intent("check_fit", room_ids=F.array(room), furniture=F.slice(furniture, 1, 1))))
    removed = F.transform(F.array_distinct(furniture), lambda f: intent("remove_furniture", room_ids=F.when(F.col("meant").isNotNull(), F.slice("meant.ids", 1, 1)), furniture=F.array(f)))
    targets = F.coalesce("meant.ids", F.when(selected.isNotNull(), F.array(selected)), F.array().cast("array<string>"))
    finishes = F.size(F.map_filter(patch, lambda k, _: k != "lighting"))
    styled = intent("renovate", room_ids=targets, preset=preset, patch=F.when(F.size(patch) > 0, patch))
    changed = F.when(F.size(targets) == 0, unknown("renovate")).when((finishes == 0) & preset.isNotNull(), F.array(styled)).when(F.size(patch) > 0, F.array(intent("renovate", room_ids=targets, patch=patch))).otherwise(unknown("finish"))
    placed = F.when(room.isNull(), unknown("place")).otherwise(F.array(intent("place_furniture", room_ids=F.array(room), furniture=furniture, placement=F.when(t.rlike(X.LONGEST_WALL), "longest_wall"))))
    out = (
        F.when(t == "", F.array().cast(f"array<{INTENT}>")).when(t.rlike(X.QUESTION) & some, check).when(t.rlike(X.REMOVAL) & some, removed)
        .when(t.rlike(X.CHANGE) & t.rlike(X.FINISH) & (~some | t.rlike(X.SURFACE)), changed).when(some & t.rlike(X.PLACING), placed)
        .when(t.rlike(X.DESCRIPTION) & F.col("meant").isNotNull(), F.array(intent("describe_room", room_ids=F.slice("meant.ids", 1, 1)))).otherwise(unknown("else"))
    )
    return d.select("ask_id", out.alias("intents"), "meant.note")
