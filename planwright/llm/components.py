"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a join on the edges; lineage is cut by a checkpoint in the shared folder; nothing is
gathered on the driver but a row count and a checksum per round.  Each partition first replaces its
edges by a spanning star forest, which shortens paths before anything is shuffled.  Tasks are as
many as the edges need, ``PER_TASK`` each, so a small table doesn't pay for hundreds of empty tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed

PER_TASK = 20_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition as stars around each local component's least node."""
    for batch in batches:
        u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = place[: len(u)], place[len(u) :]
        label = np.arange(len(nodes))
        while True:
            least = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], least)
            np.minimum.at(new, label[b], least)
            new = new[new]
            new = np.minimum(new, new[label])
            if (new == label).all():
                break
            label = new
        away = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[away]), pa.array(nodes[label[away]])], names=["u", "v"])


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks)


def components(edges: DataFrame, rows: int) -> DataFrame:
    """Rows (node, label) for every node of ``edges`` (u, v); the label is the component's least node.

    ``rows`` is about the number of edges.
    """
    tasks = 1 + rows // PER_TASK
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = checkpointed(down.coalesce(tasks).mapInArrow(_forest, "u long, v long"))
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        edges = checkpointed(_small_star(_large_star(edges, tasks), tasks))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
