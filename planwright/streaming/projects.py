"""Projects as streams of log entries: the state of ``documents.Project``, kept per document in the state store."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from planwright.operators.documents import Project, Waiting, command_label

UPDATED = "doc string, seq long, action string, ok boolean, error string, label string, state string"


class ProjectState(StatefulProcessor):
    """Replays each document's new entries on what it kept; a row per entry and one with the state.

    A wall move must come with its ``outcome`` (see ``documents.with_wall_moves``); one without is refused.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("project", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        project = Project(json.loads(self.kept.get()[0]) if self.kept.exists() else None)
        out = []
        for e in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            try:
                ok, error = project.act(e.action, e.command, e.label, e.key)
            except Waiting:
                ok, error = False, "A wall move must come with its outcome."
            out.append((key[0], e.seq, e.action, ok, error, e.label, None))
        state = json.dumps(project.state)
        self.kept.update((state,))
        yield pd.DataFrame([*out, (key[0], None, "state", None, None, None, state)], columns=["doc", "seq", "action", "ok", "error", "label", "state"])

    def close(self) -> None:
        pass


def project_stream(log: DataFrame) -> DataFrame:
    """The rows of ``documents.folded`` for a stream of log entries; needs the RocksDB state store."""
    label = F.when(F.col("action") == "dispatch", command_label(F.try_parse_json("command")))
    d = log.select(F.col("doc").cast("string").alias("doc"), F.col("seq").cast("long").alias("seq"), "action", "command", "key").withColumn("label", label)
    return d.groupBy("doc").transformWithStateInPandas(ProjectState(), outputStructType=UPDATED, outputMode="Update", timeMode="None")
