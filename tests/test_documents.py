"""Documents under commands: known outcomes, batch against stream, restart from a checkpoint, wall moves."""

import json
import random

import pytest
from pyspark.sql import functions as F

from planwright.operators import documents
from planwright.streaming import projects

LOG = "doc string, seq long, action string, command string, key string"


def apartment():
    box = lambda a, b, c, d: [[a, b], [c, b], [c, d], [a, d]]
    wall = lambda n, k, a, b, t=0.1: {"id": n, "kind": k, "start": a, "end": b, "thickness": t, "sources": {"geometry": "plan"}}
    return {"floors": [{
        "footprint": box(-0.15, -0.15, 8.15, 6.15),
        "walls": [wall("south", "exterior", [0, 0], [8, 0], 0.3), wall("north", "exterior", [0, 6], [8, 6], 0.3), wall("west", "exterior", [0, 0], [0, 6], 0.3), wall("east", "exterior", [8, 0], [8, 6], 0.3),
                  wall("mid", "interior", [4, 0.15], [4, 5.85]), wall("arm", "interior", [4.05, 3], [7.85, 3])],
        "rooms": [{"id": "left", "name": "Living", "labelSource": "ocr", "sources": {"name": "ocr"}, "polygon": box(0.15, 0.15, 3.95, 5.85), "renovation": {"lighting": "cold"}}, {"id": "lower", "name": "Bed", "polygon": box(4.05, 0.15, 7.85, 2.95)},
                  {"id": "upper", "name": "Bath", "polygon": box(4.05, 3.05, 7.85, 5.85)}],
        "doors": [{"id": "d1", "wallId": "mid", "offset": 1.0, "width": 0.8, "height": 2, "sources": {"geometry": "plan"}}, {"id": "d2", "wallId": "arm", "offset": 1.0, "width": 0.8, "height": 2}],
        "windows": [{"id": "w1", "wallId": "west", "offset": 2.0, "width": 1.0, "height": 1.2, "sillHeight": 0.9, "sources": {"sillHeight": "assumed", "height": "assumed"}}],
        "furniture": [],
    }]}


CHAIR = {"id": "chair", "name": "Armchair", "roomId": "left", "position": {"x": 1, "z": 1}, "rotation": 0}
ADD = {"type": "furniture/add", "item": CHAIR}
turn = lambda **patch: {"type": "furniture/update", "id": "chair", "patch": patch}
D = lambda command, key=None: ("dispatch", command, key)
UNDO, REDO, END, SAVED, REVERT = (("undo", None, None), ("redo", None, None), ("end", None, None), ("saved", None, None), ("revert", None, None))
LOGS = {
    "edits": [D(ADD), D(turn(rotation=1)), UNDO, UNDO, UNDO, REDO, REDO, REDO],
    "drag": [D(ADD), *[D(turn(position={"x": i, "z": 4}), "drag") for i in range(5)], END, D(turn(position={"x": 9, "z": 9}), "drag"), UNDO, UNDO],
    "invalid": [D({"type": "door/update", "id": "d1", "patch": {"width": 20}}), D({"type": "furniture/remove", "id": "ghost"}), D({"type": "room/rename", "roomId": "left", "name": " "}), D({"type": "room/fly"}), ("dispatch", "{", None), ("jump", None, None), D({"type": "furniture/add"})],
    "names": [D({"type": "room/rename", "roomId": "left", "name": "Study"}), D({"type": "room/renovate", "roomId": "left", "patch": {"floorMaterialId": "oak"}}), D({"type": "window/update", "id": "w1", "patch": {"sillHeight": 0.8}})],
    "saved": [D(ADD), SAVED, D(turn(rotation=2)), D(turn(rotation=3)), REVERT],
    "batch": [D({"type": "batch", "label": "Both", "commands": [ADD, turn(rotation=7)]}), D({"type": "batch", "label": "Half", "commands": [turn(rotation=9), {"type": "furniture/remove", "id": "ghost"}]}), D({"type": "furniture/remove", "id": "chair"}), UNDO],
    "long": [D(ADD), *[D(turn(rotation=i)) for i in range(1, 231)], *[UNDO] * 230],
    "nothing": [],
}


def log_of(spark, logs):
    rows = [(doc, 0, "load", json.dumps(apartment()), None) for doc in logs]
    rows += [(doc, i + 1, action, c if isinstance(c, str) else c and json.dumps(c), key) for doc, entries in logs.items() for i, (action, c, key) in enumerate(entries)]
    return spark.createDataFrame(random.Random(1).sample(rows, len(rows)), LOG)


@pytest.fixture(scope="module")
def replayed(spark):
    rows = documents.folded(log_of(spark, LOGS)).collect()
    return {r.doc: json.loads(r.state) for r in rows if r.action == "state"}, {(r.doc, r.seq): r for r in rows if r.action != "state"}


def furniture(state):
    return state["document"]["floors"][0]["furniture"]


def labels(state):
    return [p["label"] for p in state["past"]]


def test_undo_and_redo(replayed):
    s = replayed[0]["edits"]
    assert furniture(s) == [{**CHAIR, "rotation": 1}] and labels(s) == ["Add Armchair", "Rotate furniture"] and not s["future"]
    assert all(r.ok for (doc, _), r in replayed[1].items() if doc == "edits")
    assert replayed[0]["nothing"]["document"] == apartment() and not replayed[0]["nothing"]["dirty"]


def test_a_drag_is_one_step(replayed):
    s = replayed[0]["drag"]
    assert furniture(s)[0]["position"] == CHAIR["position"] and labels(s) == ["Add Armchair"] and len(s["future"]) == 2


def test_refused_commands_leave_all_as_it_was(replayed):
    s = replayed[0]["invalid"]
    assert s["document"] == apartment() and not s["past"] and not s["dirty"]
    errors = [replayed[1]["invalid", i].error for i in range(1, 8)]
    assert not any(replayed[1]["invalid", i].ok for i in range(1, 8))
    assert [e[:18] for e in errors] == ["Change would make ", "Furniture ghost no", "A room name cannot", "Unknown command ro", "Unreadable: Expect", "Unknown action jum", "The command lacks "]


def test_names_and_measurements_become_the_users(replayed):
    s = replayed[0]["names"]
    floor = s["document"]["floors"][0]
    assert (floor["rooms"][0]["name"], floor["rooms"][0]["labelSource"], floor["rooms"][0]["sources"]) == ("Study", "user", {"name": "user"})
    assert floor["rooms"][0]["renovation"] == {"lighting": "cold", "floorMaterialId": "oak"}
    assert floor["windows"][0]["sources"] == {"sillHeight": "user", "height": "assumed"}
    assert labels(s) == ["Rename room", "Change flooring", "Change window"]


def test_saving_reverting_and_batches(replayed):
    s = replayed[0]["saved"]
    assert furniture(s) == [CHAIR] and not s["past"] and not s["dirty"]
    b = replayed[0]["batch"]
    assert furniture(b) == [{**CHAIR, "rotation": 7}] and labels(b) == ["Both"] and not replayed[1]["batch", 2].ok


def test_history_is_bounded(replayed):
    s = replayed[0]["long"]
    assert furniture(s)[0]["rotation"] == 30 and not s["past"] and len(s["future"]) == 200


def test_a_stream_with_a_restart_equals_the_batch(spark, tmp_path, replayed):
    log = log_of(spark, LOGS)
    source, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    found = {}

    def run():
        def keep(df, _):
            for r in df.where("action = 'state'").collect():
                found[r.doc] = json.loads(r.state)

        stream = projects.project_stream(spark.readStream.schema(LOG).parquet(source))
        stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination(240)

    log.where("seq < 3").write.parquet(source)
    run()
    assert found["edits"] != replayed[0]["edits"]
    log.where("seq >= 3").write.mode("append").parquet(source)
    run()
    assert found == replayed[0]


def test_wall_moves_are_judged_between_edits(spark):
    move = lambda n, d: D({"type": "wall/move", "id": n, "distance": d})
    logs = {"walls": [D(ADD), move("mid", 0.5), move("south", 1), move("arm", 0.2), UNDO, move("mid", -0.25), move("ghost", 1)], "pair": [D({"type": "batch", "label": "x", "commands": [{"type": "wall/move", "id": "mid", "distance": 1}]}), D(ADD)]}
    rows = documents.with_wall_moves(log_of(spark, logs)).collect()
    states = {r.doc: json.loads(r.state) for r in rows if r.action == "state"}
    assert sorted((r.seq, r.ok) for r in rows if r.doc == "walls" and r.seq is not None) == [(0, True), (1, True), (2, True), (3, False), (4, True), (5, True), (6, True), (7, False)]
    s = states["walls"]
    walls = {w["id"]: w for w in s["document"]["floors"][0]["walls"]}
    assert walls["mid"]["start"] == pytest.approx([3.75, 0.15]) and walls["mid"]["sources"]["geometry"] == "user"
    assert walls["arm"]["start"] == pytest.approx([3.8, 3]) and walls["south"]["sources"]["geometry"] == "plan"
    assert s["document"]["floors"][0]["doors"][1]["offset"] == pytest.approx(1.25)
    assert labels(s) == ["Add Armchair", "Move wall", "Move wall"]
    assert labels(states["pair"]) == ["Add Armchair"]


def test_labels(spark):
    cases = [(turn(position=1, rotation=1), "Move furniture"), (turn(color="red"), "Change furniture material"), (turn(name="x"), "Edit furniture"), ({"type": "room/renovate", "patch": {"wallColor": 1, "ceiling": 2}}, "Change walls"),
             ({"type": "room/renovate", "patch": {"lighting": 1}}, "Change lighting"), ({"type": "room/renovate", "patch": {}}, "Renovate room"), ({"type": "wall/move"}, "Move wall"), ({"type": "batch", "label": "L"}, "L"), ({"type": "door/update"}, "Change door"), (ADD, "Add Armchair")]
    d = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, c string")
    got = {r.i: r.label for r in d.select("i", documents.command_label(F.try_parse_json("c")).alias("label")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
