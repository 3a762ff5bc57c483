"""Pixel scale of plans from measured references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A reference further than this from the median scale is an outlier.
OUTLIER = 0.03


def from_references(refs: DataFrame, key: str, meters: str, px: str) -> DataFrame:
    """One row per plan: scale, references used and rejected, largest residual, confidence.

    Robust mean: references within OUTLIER of the median are averaged.  The references cross the
    shuffle once, gathered per plan, since the median needs them together; the filter, mean and
    residual then run over the array.
    """
    ppm = F.when((F.col(meters) > 0) & (F.col(px) > 0) & ~F.isnan(meters) & ~F.isnan(px), F.col(px) / F.col(meters))
    plans = refs.select(F.col(key), ppm.alias("ppm")).where("ppm IS NOT NULL").groupBy(key).agg(F.median("ppm").alias("median"), F.collect_list("ppm").alias("all"))
    kept = F.filter("all", lambda v: F.abs(v / F.col("median") - 1) <= OUTLIER)
    plans = plans.withColumn("kept", F.array_sort(kept)).withColumn("n_used", F.size("kept"))
    mean = F.aggregate("kept", F.lit(0.0), lambda a, v: a + v) / F.col("n_used")
    plans = plans.withColumn("scale", F.when(F.col("n_used") > 0, mean))
    worst = F.array_max(F.transform("kept", lambda v: F.abs(v / F.col("scale") - 1)))
    plans = plans.withColumn("residual", worst)
    confidence = (
        F.when(F.col("n_used") == 0, "error")
        .when((F.col("n_used") >= 3) & (F.col("residual") <= 0.02), "high")
        .when((F.col("n_used") >= 2) & (F.col("residual") <= 0.05), "medium")
        .otherwise("low")
    )
    return plans.select(key, "median", "scale", F.col("n_used").cast("long").alias("n_used"), (F.size("all") - F.col("n_used")).cast("long").alias("n_rejected"), "residual", confidence.alias("confidence"))


def by_priority(candidates: DataFrame, key: str, rank: str, order: str, *values: str) -> DataFrame:
    """The best-ranked candidate of each plan; ties fall to the least ``order``."""
    best = F.min_by(F.struct(rank, *values), F.struct(rank, order)).alias("best")
    return candidates.groupBy(key).agg(best).select(key, *[F.col(f"best.{c}").alias(c) for c in (rank, *values)])
