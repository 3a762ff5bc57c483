"""Saved plans as documents that commands edit: nine typed commands, undo and redo, refusals, fixed labels.

A document is JSON: ``floors``, each with lists of ``rooms``, ``walls``, ``doors``, ``windows`` and
``furniture`` whose members have an ``id``.  A command changes some members; the history keeps what was
there before and after, not whole documents, so that undo and redo cost what the edit cost.

``folded`` replays whole logs in batch, ``planwright.streaming.projects`` keeps the same state in a
stream.  A wall move needs the geometry of the whole floor, so ``with_wall_moves`` judges it with
``wall_moves`` between the edits, for all documents at once, and hands its outcome to the replay; inside
a batch it is refused.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwright.operators import wall_moves
from planwright.sources.lineage import cut

#: Fixed value: undo steps that are kept.
HISTORY_LIMIT = 200
#: Tolerance of openings on walls, in metres.
SPAN_TOLERANCE = 1e-3
KINDS = ("rooms", "walls", "doors", "windows", "furniture")
#: The measurements whose source becomes the user when the user enters them.
MEASURED = {"doors": {"width": "geometry", "height": "height"}, "windows": {"sillHeight": "sillHeight", "height": "height"}}
#: Labels by what a command's patch touches, the first that fits.
FURNITURE_LABELS = (("position", "Move furniture"), ("rotation", "Rotate furniture"), ("dimensions", "Resize furniture"), ("materialId", "Change furniture material"), ("color", "Change furniture material"))
RENOVATION_LABELS = (("floor", "Change flooring"), ("wall", "Change walls"), ("ceiling", "Change ceiling"), ("lighting", "Change lighting"))
LABELS = {"furniture/remove": "Delete furniture", "room/rename": "Rename room", "door/update": "Change door", "window/update": "Change window", "wall/move": "Move wall"}
#: Log entries besides commands.
ACTIONS = ("dispatch", "undo", "redo", "end", "load", "revert", "saved")

LOG = "doc, seq, action, command, key"
FOLDED = "doc string, seq long, action string, ok boolean, error string, label string, state string"


class Refused(Exception):
    """A command that can't be carried out."""


class Waiting(Exception):
    """A wall move that has not been judged yet."""


def command_label(command: Column) -> Column:
    """What a history calls a command (a VARIANT)."""
    text = lambda path: F.try_variant_get(command, path, "string")
    kind, keys = text("$.type"), F.json_object_keys(F.to_json(F.try_variant_get(command, "$.patch", "variant")))
    has = lambda k: F.array_contains(keys, k)
    starts = lambda p: F.exists(keys, lambda k: k.startswith(p))
    furniture, room = F.lit("Edit furniture"), F.lit("Renovate room")
    for k, label in reversed(FURNITURE_LABELS):
        furniture = F.when(has(k), label).otherwise(furniture)
    for k, label in reversed(RENOVATION_LABELS):
        room = F.when(starts(k) if k != "lighting" else has(k), label).otherwise(room)
    out = F.when(kind == "furniture/add", F.concat(F.lit("Add "), text("$.item.name"))).when(kind == "batch", text("$.label"))
    for k, label in LABELS.items():
        out = out.when(kind == k, label)
    return out.when(kind == "furniture/update", furniture).when(kind == "room/renovate", room)


def opening_errors(document: dict) -> int:
    """Openings without size or wall, beyond their wall, or over another one on it."""
    found = 0
    for floor in document["floors"]:
        spans: dict[str, list[tuple[float, float]]] = {}
        length = {w["id"]: math.dist(w["start"], w["end"]) for w in floor.get("walls", [])}
        for o in (*floor.get("doors", []), *floor.get("windows", [])):
            a, b = o["offset"] - o["width"] / 2, o["offset"] + o["width"] / 2
            if not o["width"] > 0 or not o.get("height", 1) > 0 or o["wallId"] not in length:
                found += 1
            elif a < -SPAN_TOLERANCE or b > length[o["wallId"]] + SPAN_TOLERANCE:
                found += 1
            spans.setdefault(o["wallId"], []).append((a, b))
        for on_wall in spans.values():
            reach = -math.inf
            for a, b in sorted(on_wall):
                found += a < reach - SPAN_TOLERANCE
                reach = max(reach, b)
    return found


class Project:
    """One document with its history."""

    def __init__(self, state: dict | None = None):
        self.state = state or {"document": {"floors": []}, "baseline": {"floors": []}, "past": [], "future": [], "key": None, "dirty": False, "errors": 0, "version": 0}

    def load(self, document: dict) -> None:
        same = json.dumps(document)
        self.state |= {"document": json.loads(same), "baseline": json.loads(same), "past": [], "future": [], "key": None, "dirty": False, "errors": opening_errors(document)}

    # a change: [floor, kind, place, before, after]; nothing before is an insertion, nothing after a removal
    def _turn(self, changes: list, back: bool = False) -> None:
        for floor, kind, place, before, after in reversed(changes) if back else changes:
            members = self.state["document"]["floors"][floor].setdefault(kind, [])
            old, new = (after, before) if back else (before, after)
            if old is None:
                members.insert(place, new)
            elif new is None:
                del members[place]
            else:
                members[place] = new

    def _find(self, kind: str, of: str, what: str) -> tuple[int, int, dict]:
        for f, floor in enumerate(self.state["document"]["floors"]):
            for i, member in enumerate(floor.get(kind, [])):
                if member["id"] == of:
                    return f, i, member
        raise Refused(f"{what} {of} not found")

    def _change(self, kind: str, of: str, what: str, patch: dict, sources: dict | None = None) -> list:
        f, i, old = self._find(kind, of, what)
        new = {**old, **patch}
        if sources:
            new["sources"] = {**old.get("sources", {}), **sources}
        return [[f, kind, i, old, new]]

    def _changes(self, c: dict[str, Any]) -> list:
        kind = c["type"]
        if kind == "furniture/add":
            item = c["item"]
            f, _, _ = self._find("rooms", item["roomId"], "Room")
            if any(x["id"] == item["id"] for floor in self.state["document"]["floors"] for x in floor.get("furniture", [])):
                raise Refused(f"Furniture {item['id']} already exists")
            return [[f, "furniture", len(self.state["document"]["floors"][f].get("furniture", [])), None, item]]
        if kind == "furniture/update":
            return self._change("furniture", c["id"], "Furniture", c["patch"])
        if kind == "furniture/remove":
            f, i, old = self._find("furniture", c["id"], "Furniture")
            return [[f, "furniture", i, old, None]]
        if kind == "room/rename":
            if not c["name"].strip():
                raise Refused("A room name cannot be empty")
            return self._change("rooms", c["roomId"], "Room", {"name": c["name"], "labelSource": "user"}, {"name": "user"})
        if kind == "room/renovate":
            _, _, room = self._find("rooms", c["roomId"], "Room")
            return self._change("rooms", c["roomId"], "Room", {"renovation": {**room.get("renovation", {}), **c["patch"]}})
        if kind in ("door/update", "window/update"):
            of, what = ("doors", "Door") if kind == "door/update" else ("windows", "Window")
            entered = {source: "user" for field, source in MEASURED[of].items() if c["patch"].get(field) is not None}
            _, _, old = self._find(of, c["id"], what)
            return self._change(of, c["id"], what, c["patch"], {**old.get("sources", {}), **entered})
        if kind == "wall/move":
            self._find("walls", c["id"], "Wall")
            if "outcome" not in c:
                raise Waiting
            if "refused" in c["outcome"]:
                raise Refused(c["outcome"]["refused"])
            out = []
            for of, field in (("walls", None), ("rooms", None), ("doors", "offset"), ("windows", "offset")):
                for name, patch in c["outcome"].get(of, {}).items():
                    out += self._change(of, name, of, patch, None if field else {"geometry": "user"})
            return out
        raise Refused(f"Unknown command {kind}")

    def _apply(self, c: dict) -> list:
        """Carries a command out and returns its changes; a refused batch leaves nothing behind."""
        done: list = []
        for part in c["commands"] if c["type"] == "batch" else [c]:
            try:
                if part is not c and part["type"] == "wall/move" and "outcome" not in part:
                    raise Refused("A wall moves by a command of its own")
                if part["type"] == "batch":
                    changes = self._apply(part)
                else:
                    changes = self._changes(part)
                    self._turn(changes)
            except Exception:
                self._turn(done, back=True)
                raise
            done += changes
        return done

    def dispatch(self, command: dict, label: str, key: str | None) -> None:
        s = self.state
        try:
            changes = self._apply(command)
        except (KeyError, TypeError, AttributeError) as e:
            raise Refused(f"The command lacks {e}") from e
        errors = s["errors"]
        if _touches_geometry(command):
            errors = opening_errors(s["document"])
            if errors > s["errors"]:
                self._turn(changes, back=True)
                raise Refused("Change would make the model invalid.")
        if key is not None and key == s["key"] and s["past"]:
            s["past"][-1]["changes"] += changes
        else:
            s["past"] = [*s["past"], {"changes": changes, "label": label, "errors": s["errors"]}][-HISTORY_LIMIT:]
        s |= {"future": [], "key": key, "dirty": True, "errors": errors, "version": s["version"] + 1}

    def _step(self, source: str, target: str, back: bool) -> None:
        s = self.state
        if s[source]:
            entry = s[source].pop()
            self._turn(entry["changes"], back)
            s[target].append({**entry, "errors": s["errors"]})
            s |= {"errors": entry["errors"], "key": None, "dirty": True, "version": s["version"] + 1}

    def act(self, action: str, command: str | None, label: str | None, key: str | None) -> tuple[bool, str | None]:
        """One entry of a log; whether it was carried out, else why not."""
        s = self.state
        try:
            if action == "dispatch":
                self.dispatch(json.loads(command or "{}"), label or "", key)
            elif action == "load":
                self.load(json.loads(command or "{}"))
            elif action == "undo":
                self._step("past", "future", True)
            elif action == "redo":
                self._step("future", "past", False)
            elif action == "end":
                s["key"] = None
            elif action == "saved":
                s |= {"dirty": False, "baseline": json.loads(json.dumps(s["document"]))}
            elif action == "revert":
                self.load(s["baseline"])
            else:
                raise Refused(f"Unknown action {action}")
        except Refused as e:
            return False, str(e)
        except (ValueError, KeyError, TypeError) as e:
            return False, f"Unreadable: {e}"
        return True, None


def _touches_geometry(c: dict) -> bool:
    return c["type"] in ("wall/move", "door/update", "window/update") or c["type"] == "batch" and any(map(_touches_geometry, c["commands"]))


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replays logs that come sorted by document and place; a row per entry, and one per document with its state."""
    now, project, stopped = None, None, False
    columns = ["doc", "seq", "action", "ok", "error", "label", "state"]
    for batch in batches:
        rows = []
        for doc, seq, action, command, label, key in batch.itertuples(index=False):
            if doc != now:
                if project:
                    rows.append((now, None, "state", None, None, None, json.dumps(project.state)))
                now, project, stopped = doc, Project(), False
            if action == "resume":
                project = Project(json.loads(command))
                continue
            if stopped:
                continue
            try:
                ok, error = project.act(action, command, label, key)
                rows.append((doc, seq, action, ok, error, label, None))
            except Waiting:
                stopped = True
                rows.append((doc, seq, "waits", None, None, label, None))
        yield pd.DataFrame(rows, columns=columns)
    if project:
        yield pd.DataFrame([(now, None, "state", None, None, None, json.dumps(project.state))], columns=columns)


def folded(log: DataFrame) -> DataFrame:
    """Every log replayed: a row per entry with ``ok`` and ``error``, and one (action ``state``) per document.

    ``log``: doc, seq, action (dispatch, undo, redo, end, load, revert, saved), command (JSON text: the
    command, or the document to load), key (edits in a row with one key are one undo step).  Logs are
    sorted, not gathered, so a task holds one document however long its log is.
    """
    typed = log.select(F.col("doc").cast("string").alias("doc"), F.col("seq").cast("long").alias("seq"), "action", F.col("command").cast("string").alias("command"), F.col("key").cast("string").alias("key"))
    label = F.when(F.col("action") == "dispatch", command_label(F.try_parse_json("command")))
    d = typed.withColumn("label", label).select("doc", "seq", "action", "command", "label", "key")
    return d.repartition("doc").sortWithinPartitions("doc", "seq").mapInPandas(_replay, FOLDED)


_FLOOR = (
    "struct<floors:array<struct<footprint:array<array<double>>,walls:array<struct<id:string,kind:string,start:array<double>,end:array<double>,thickness:double>>,"
    "rooms:array<struct<id:string,polygon:array<array<double>>>>,doors:array<struct<id:string,wallId:string,offset:double>>,windows:array<struct<id:string,wallId:string,offset:double>>>>>"
)


def _relations(documents: DataFrame) -> dict[str, DataFrame]:
    """The geometry of documents (doc, document as JSON text), one floor_id per document and floor."""
    p = lambda a: F.struct(F.get(a, 0).alias("x"), F.get(a, 1).alias("z"))
    floors = documents.select("doc", F.posexplode(F.from_json("document", _FLOOR)["floors"]).alias("floor", "f"))
    floors = floors.select(F.to_json(F.array("doc", F.col("floor").cast("string"))).alias("floor_id"), "f")
    each = lambda kind: floors.select("floor_id", F.posexplode(f"f.{kind}").alias("ord", "v"))
    openings = [each(kind).select("floor_id", F.concat(F.lit(f"{kind}:"), F.col("v.id")).alias("id"), F.col("v.wallId").alias("wall_id"), "v.offset") for kind in ("doors", "windows")]
    return {
        "walls": each("walls").select("floor_id", F.col("v.id").alias("wall_id"), "ord", "v.kind", p(F.col("v.start")).alias("start"), p(F.col("v.end")).alias("end"), "v.thickness"),
        "rooms": each("rooms").select("floor_id", F.col("v.id").alias("room_id"), "ord", F.transform("v.polygon", p).alias("polygon")),
        "openings": openings[0].unionByName(openings[1]),
        "outlines": floors.select("floor_id", F.transform("f.footprint", p).alias("outline")),
    }


def with_wall_moves(log: DataFrame) -> DataFrame:
    """``folded`` with every wall move judged: rounds of replaying up to the next move, then moving all walls that wait.

    There are as many rounds as the log with the most wall moves has of them.
    """
    typed = cut(log.select(F.col("doc").cast("string").alias("doc"), F.col("seq").cast("long").alias("seq"), "action", F.col("command").cast("string").alias("command"), F.col("key").cast("string").alias("key")))
    entries, done = typed, None
    while True:
        out = cut(folded(entries))
        part = out.where("action <> 'waits'")
        waits = out.where("action = 'waits'").select("doc", "seq")
        state = part.where("action = 'state'").join(waits.select("doc"), "doc", "left_semi")
        fresh = part.join(state.select("doc").withColumn("action", F.lit("state")), ["doc", "action"], "left_anti").select(*out.columns)
        done = fresh if done is None else done.unionByName(fresh)
        if not waits.take(1):
            return done
        asked = entries.join(waits, ["doc", "seq"])
        document = state.select("doc", F.get_json_object("state", "$.document").alias("document"))
        r = _relations(document)
        owner = r["walls"].select("floor_id", "wall_id", F.get(F.from_json("floor_id", "array<string>"), 0).alias("doc"))
        owner = owner.groupBy("doc", "wall_id").agg(F.min("floor_id").alias("floor_id"))
        wish = asked.select("doc", "seq", F.get_json_object("command", "$.id").alias("wall_id"), F.get_json_object("command", "$.distance").try_cast("double").alias("distance"))
        wish = wish.join(owner, ["doc", "wall_id"]).select("floor_id", F.col("seq").alias("request_id"), "wall_id", "distance")
        got = wall_moves.moved(wish, r["walls"], r["rooms"], r["openings"], r["outlines"])
        outcome = _outcomes(got)
        judged = asked.join(outcome, ["doc", "seq"], "left")
        text = F.concat(F.regexp_replace("command", r"\}\s*$", ""), F.lit(',"outcome":'), F.coalesce("outcome", F.lit('{"refused":"It could not be judged."}')), F.lit("}"))
        judged = judged.select("doc", "seq", "action", text.alias("command"), "key")
        later = entries.join(waits.withColumnRenamed("seq", "at"), "doc").where("seq > at").select(*entries.columns)
        resume = state.select("doc", F.lit(-(2**62)).cast("long").alias("seq"), F.lit("resume").alias("action"), F.col("state").alias("command"), F.lit(None).cast("string").alias("key"))
        entries = cut(resume.unionByName(judged).unionByName(later))


def _outcomes(got: wall_moves.Moves) -> DataFrame:
    """(doc, seq, outcome): what each judged move does, as JSON text."""
    pair = lambda p: F.array(p["x"], p["z"])
    kind, name = F.split_part("id", F.lit(":"), F.lit(1)), F.regexp_replace("id", "^[a-z]+:", "")
    rows = [
        got.walls.select("floor_id", "request_id", F.lit("walls").alias("kind"), F.col("wall_id").alias("name"), F.to_json(F.struct(pair(F.col("start")).alias("start"), pair(F.col("end")).alias("end"))).alias("patch")),
        got.rooms.select("floor_id", "request_id", F.lit("rooms").alias("kind"), F.col("room_id").alias("name"), F.to_json(F.struct(F.transform("polygon", pair).alias("polygon"))).alias("patch")),
        got.openings.select("floor_id", "request_id", kind.alias("kind"), name.alias("name"), F.to_json(F.struct("offset")).alias("patch")),
    ]
    quoted = F.regexp_extract(F.to_json(F.struct("name")), r'^\{"name":(.*)\}$', 1)
    members = F.array_join(F.sort_array(F.collect_list(F.concat(quoted, F.lit(":"), "patch"))), ",")
    whole = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("floor_id", "request_id", "kind").agg(members.alias("m"))
    whole = whole.groupBy("floor_id", "request_id").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat(F.lit('"'), "kind", F.lit('":{'), "m", F.lit("}"))), ","), F.lit("}")).alias("outcome"))
    refused = got.refused.select("floor_id", "request_id", F.to_json(F.struct(F.col("message").alias("refused"))).alias("outcome"))
    return whole.unionByName(refused).select(F.get(F.from_json("floor_id", "array<string>"), 0).alias("doc"), F.col("request_id").alias("seq"), "outcome")
