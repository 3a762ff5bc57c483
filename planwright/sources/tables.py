"""Reading plan tables and migrating saved documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwright.sources.lineage import shuffled, spread

#: Tables that stay as they are, however large the others.
FIXED = ("nation", "region")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df if name in FIXED else shuffled(df)


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table over many tasks by its key: for queries that make much of each of its rows, which may be few bytes in few files."""
    return spread(load(spark, sf_dir, name), key)


def manifests(spark: SparkSession, folder: str, ranks: dict[str, int]) -> DataFrame:
    """Corpus manifests below a folder, by category rank, then id."""
    found = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    rank = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    return found.orderBy(F.coalesce(rank[F.col("category")], F.lit(len(ranks))), "id")


def migrated(df: DataFrame, doc: str) -> DataFrame:
    """Version 1 documents as version 2: one source becomes one per property, heights are assumed."""
    old = F.col(doc)
    sources = F.struct(old["source"].alias("area"), F.lit("assumed").alias("height"))
    new = old.withField("sources", sources).withField("version", F.lit(2)).dropFields("source")
    return df.withColumn(doc, new)


def saved(projects: DataFrame, id_col: str, saved_at: str) -> DataFrame:
    """The newest save of each project."""
    cols = [c for c in projects.columns if c != id_col]
    return projects.groupBy(id_col).agg(F.max_by(F.struct(*cols), saved_at).alias("p")).select(id_col, "p.*")
