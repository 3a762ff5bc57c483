"""Session helpers: shared checkpoints, partition counts and table loading."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a session on one machine without one gets a temporary folder."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="planwright-checkpoint-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def whole_rows(docs: DataFrame, **keys: Column) -> DataFrame:
    """Every row as one struct ``row`` beside the named keys, so no column of the user's can clash with them."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in keys.items()])


def fields(docs: DataFrame, **replaced: Column) -> list[Column]:
    """The columns of ``docs`` out of ``row``, some of them replaced."""
    return [replaced.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes to be no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage with files in the shared folder, removed with the DataFrame where Spark is set to."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage with a Parquet table in the shared folder, for rows too wide for a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
