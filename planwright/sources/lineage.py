"""Cutting lineage: intermediate relations that several steps read are written once where all executors see them."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to the folder of ``spark.checkpoint.dir`` and read from there on.

    A session on one machine without such a folder gets a temporary one; on a cluster it must be named.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="planwright-lineage-"))
    return shuffled(df.checkpoint(eager=True))


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, which joins deal by key instead of copying it to the driver and all executors.

    Spark judges a relation by the compressed files behind it, however many rows its functions make of
    theirs: a few megabytes may stand for gigabytes.  A relation small whatever the tables, under
    ``broadcast`` on the other side of a join, still goes to all executors.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str, tasks: int = 0) -> DataFrame:
    """``df`` over as many tasks as the session's shuffles have, or its cores or ``tasks`` if these are more.

    For rows that are few bytes but much work, which Spark would otherwise gather in a few tasks by size.
    """
    spark = df.sparkSession
    return shuffled(df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, tasks), *keys))
