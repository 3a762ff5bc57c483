"""Edits of a document, placements and text commands."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY = 200


def folded(commands: DataFrame, doc: str, order: list[str], fields: dict[str, Column]) -> DataFrame:
    """State after all commands of each document: the last patch of each field wins.

    A field's column is null where a command leaves it alone.
    """
    key = F.struct(*order)
    last = [F.max_by(v, F.when(v.isNotNull(), key)).alias(k) for k, v in fields.items()]
    return commands.groupBy(doc).agg(F.count(F.lit(1)).alias("version"), *last)


def coalesced(commands: DataFrame, doc: str, order: list[str], key: str, limit: int = HISTORY) -> DataFrame:
    """History entries: runs of commands with one key become one entry; the last ``limit`` remain."""
    w = Window.partitionBy(doc).orderBy(*order)
    d = commands.withColumn("_new", F.when(F.lag(key).over(w).eqNullSafe(F.col(key)), 0).otherwise(1))
    d = d.withColumn("entry", F.sum("_new").over(w))
    entries = d.groupBy(doc, "entry").agg(F.first(key).alias("key"), F.count(F.lit(1)).alias("n_commands"))
    newest = Window.partitionBy(doc).orderBy(F.col("entry").desc())
    return entries.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= limit).drop("_r")


def best_candidate(candidates: DataFrame, request: list[str], total: Column, ord_col: str, *values: str) -> DataFrame:
    """The candidate of least total per request; the first of equals wins."""
    best = F.min_by(F.struct(total.alias("total"), *values), F.struct(total, ord_col)).alias("b")
    return candidates.groupBy(*request).agg(best).select(*request, "b.*")


def sequential_fit(requests: DataFrame, room: str, length: str, step: float = 0.1) -> DataFrame:
    """Places requests of each room along its wall in order (the narrower first of equals); each placed item blocks the later ones.

    ``requests``: room, ord, width, and the wall's length.  Placement depends on earlier placements,
    so a room is one group in Python.  A room only fills up: what is as wide as an item that found no
    place there, or wider, finds none either and isn't looked at.
    """
    kind = requests.schema[room].dataType.simpleString()

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ord", "width"])
        starts: list[float | None] = []
        free, hopeless = None, {}
        for room_length, width in zip(group[length].astype(float).tolist(), group["width"].astype(float).tolist(), strict=True):
            if width >= hopeless.get(room_length, np.inf):
                starts.append(None)
                continue
            if free is None:
                free = np.arange(int(room_length / step + 1e-9) + 1) * step
                taken = np.zeros(0), np.zeros(0)
            slots = free[free + width <= room_length + 1e-9] if width <= room_length else free[:0]
            if len(taken[0]):
                # a slot is blocked where the last item that starts before its end reaches past its start
                at = np.searchsorted(taken[0], slots + width - 1e-9)
                reach = np.maximum.accumulate(np.append(-np.inf, taken[1]))
                slots = slots[reach[at] <= slots + 1e-9]
            if len(slots):
                start = float(slots[np.argmin(np.round(np.abs(slots + width / 2 - room_length / 2), 9))])
                k = int(np.searchsorted(taken[0], start))
                taken = np.insert(taken[0], k, start), np.insert(taken[1], k, start + width)
            else:
                hopeless[room_length] = min(hopeless.get(room_length, np.inf), width)
            starts.append(start if len(slots) else None)
        position = pd.Series(starts, index=group.index, dtype=object)
        return pd.DataFrame({room: group[room], "ord": group["ord"], "ok": position.notna(), "position": position})

    return requests.groupBy(room).applyInPandas(place, f"{room} {kind}, ord long, ok boolean, position double")


#: Intents in order of precedence, with the words that show them.
INTENTS = (
    ("question", r"\?|^(?:what|how|which|where|why)\b"),
    ("remove", r"\b(?:remove|delete|clear)\b"),
    ("renovate", r"\b(?:paint|renovate|floor|wall)\b"),
    ("place", r"\b(?:add|put|place|fit)\b"),
    ("describe", r"\b(?:describe|list|show|the)\b"),
)


def intent(text: Column) -> Column:
    """First intent, by precedence, whose words occur; else ``unknown``."""
    low = F.lower(text)
    out = F.when(low.rlike(INTENTS[0][1]), INTENTS[0][0])
    for name, words in INTENTS[1:]:
        out = out.when(low.rlike(words), name)
    return out.otherwise("unknown")


def json_contract(df: DataFrame, id_col: str, json_col: str, allowed: list[str], required: list[str]) -> DataFrame:
    """Checks a JSON object's keys: parse errors, unexpected and missing fields, all reported."""
    keys = F.json_object_keys(F.col(json_col))
    known, must = F.array(*map(F.lit, allowed)), F.array(*map(F.lit, required))
    d = df.select(F.col(id_col).alias("id"), keys.alias("keys"))
    return d.select(
        "id",
        F.col("keys").isNotNull().alias("parsed"),
        F.array_join(F.array_sort(F.array_except("keys", known)), ",").alias("unexpected"),
        F.array_join(F.array_sort(F.array_except(must, "keys")), ",").alias("missing"),
    )


def catalog_search(items: DataFrame, text: Column, query: str) -> DataFrame:
    """Items whose text holds the query's words; an empty query gives all."""
    words = query.lower().split()
    out = items
    for w in words:
        out = out.where(F.lower(text).contains(w))
    return out
