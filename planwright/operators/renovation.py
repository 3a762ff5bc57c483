"""Renovations as commands: a room's finishes, with those of its doors and windows; styles over rooms.

A door that two rooms share takes the finish of the later one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwright.functions import finishes as X
from planwright.operators.intents import preset_patch


def commands(asked: DataFrame, rooms: DataFrame) -> DataFrame:
    """Commands in order: plan_id, ask_id, ord, sub, type, id, patch (a map); unknown rooms give none.

    ``asked``: plan_id, ask_id, ord, room_id, patch; ``rooms``: plan_id, room_id, door_ids, window_ids.
    """
    d = asked.select("plan_id", "ask_id", "ord", "room_id", "patch").join(rooms.select("plan_id", "room_id", "door_ids", "window_ids"), ["plan_id", "room_id"])
    one = lambda kind, i, patch: F.struct(F.lit(kind).alias("type"), i.alias("id"), patch.cast("map<string,string>").alias("patch"))

    def openings(kind: str, field: str, ids: str) -> Column:
        finish = F.element_at("patch", F.lit(field))
        own = F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda i: one(kind, i, F.create_map(F.lit("materialId"), finish)))
        return F.when(finish.isNotNull(), own).otherwise(F.array().cast("array<struct<type:string,id:string,patch:map<string,string>>>"))

    every = F.concat(F.array(one("room/renovate", F.col("room_id"), F.col("patch"))), openings("door/update", "doorMaterialId", "door_ids"), openings("window/update", "windowMaterialId", "window_ids"))
    return d.select("plan_id", "ask_id", "ord", F.posexplode(every).alias("sub", "c")).select("plan_id", "ask_id", "ord", "sub", "c.*")


def styled(asked: DataFrame, rooms: DataFrame) -> DataFrame:
    """The commands of a style over rooms in the order given; rooms that it leaves alone give none.

    ``asked``: plan_id, ask_id, preset, room_ids; ``rooms``: plan_id, room_id, type, door_ids, window_ids.
    """
    d = asked.select("plan_id", "ask_id", "preset", F.posexplode("room_ids").alias("ord", "room_id")).join(rooms.select("plan_id", "room_id", "type"), ["plan_id", "room_id"])
    d = d.withColumn("patch", preset_patch(F.col("preset"), F.col("type"))).where(F.size("patch") > 0)
    return commands(d, rooms)


def finished(found: DataFrame) -> DataFrame:
    """What the commands leave: plan_id, ask_id, type, id, field, value; the last command on a field decides."""
    d = found.select("plan_id", "ask_id", "ord", "sub", "type", "id", F.explode("patch").alias("field", "value"))
    return d.groupBy("plan_id", "ask_id", "type", "id", "field").agg(F.max_by("value", F.struct("ord", "sub")).alias("value"))


def batch(found: DataFrame, label: Column) -> DataFrame:
    """Each asking's commands as one batch command (JSON text), for ``documents``."""
    target = F.when(F.col("type") == "room/renovate", F.to_json(F.struct("type", F.col("id").alias("roomId"), "patch"))).otherwise(F.to_json(F.struct("type", "id", "patch")))
    g = found.withColumn("c", target).groupBy("plan_id", "ask_id").agg(F.sort_array(F.collect_list(F.struct("ord", "sub", "c"))).alias("cs"))
    head = F.to_json(F.struct(F.lit("batch").alias("type"), label.alias("label")))
    whole = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"commands":['), F.array_join(F.transform("cs", lambda x: x["c"]), ","), F.lit("]}"))
    return g.select("plan_id", "ask_id", whole.alias("command"))


def style_name(preset: Column) -> Column:
    """What a history calls a style."""
    return F.concat(F.create_map(*[F.lit(x) for i, n, *_ in X.PRESETS for x in (i, n)])[preset], F.lit(" style"))
