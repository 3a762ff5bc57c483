"""Documents as streams of commands: state after each batch, with undo and redo."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from planwright.operators.editing import HISTORY

STATE = "doc long, version long, n_undo long, n_redo long, last_type string, last_value double"


class DocumentState(StatefulProcessor):
    """Keeps each document's version, histories and last patch.

    Commands arrive as (doc, seq, type, value); types ``undo`` and ``redo`` move along the history,
    any other type is an edit, which drops what could be redone.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "version long, type string, value double")
        self.undo = handle.getListState("undo", "type string, value double")
        self.redo = handle.getListState("redo", "type string, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, kind, value = self.current.get() if self.current.exists() else (0, None, None)
        undo = list(self.undo.get()) if self.undo.exists() else []
        redo = list(self.redo.get()) if self.redo.exists() else []
        commands = pd.concat(list(rows)).sort_values("seq")
        for c in commands.itertuples(index=False):
            if c.type == "undo":
                if undo:
                    redo.append((kind, value))
                    kind, value = undo.pop()
            elif c.type == "redo":
                if redo:
                    undo.append((kind, value))
                    kind, value = redo.pop()
            else:
                undo = [*undo, (kind, value)][-HISTORY:]
                redo, kind, value = [], c.type, None if pd.isna(c.value) else float(c.value)
            version += 1
        self.current.update((version, kind, value))
        for state, items in ((self.undo, undo), (self.redo, redo)):
            state.clear()
            if items:
                state.put(items)
        yield pd.DataFrame([(key[0], version, len(undo), len(redo), kind, value)], columns=["doc", "version", "n_undo", "n_redo", "last_type", "last_value"])

    def close(self) -> None:
        pass


def document_stream(commands: DataFrame) -> DataFrame:
    """One row per document and batch with its state; needs the RocksDB state store."""
    return commands.groupBy("doc").transformWithStateInPandas(DocumentState(), outputStructType=STATE, outputMode="Update", timeMode="None")
