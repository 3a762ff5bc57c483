"""Data-quality rules, reviews and classifications over plan relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses from best to worst.
STATUSES = ("ok", "ok-with-warnings", "needs-review", "failed")


def dangling(rows: DataFrame, id_col: str, ref_col: str, targets: DataFrame, target_id: str, code: str) -> DataFrame:
    """Issues for references without a target (anti-join); null references are no references."""
    refs = rows.where(F.col(ref_col).isNotNull()).select(F.col(id_col).cast("string").alias("entity"), F.col(ref_col).cast("string").alias("ref"))
    there = targets.select(F.col(target_id).cast("string").alias("ref")).distinct()
    return refs.join(there, "ref", "left_anti").select(F.lit(code).alias("code"), "entity", "ref")


def duplicate_ids(kinds: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Ids used more than once over all kinds, with the first kind that uses them."""
    rows = [d.select(F.lit(i).alias("kind_ord"), F.lit(k).alias("kind"), F.col(c).cast("string").alias("id")) for i, (k, (d, c)) in enumerate(kinds.items())]
    ids = reduce(DataFrame.unionByName, rows).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min_by("kind", "kind_ord").alias("first_kind"))
    return ids.where("n > 1")


def union_rules(*rules: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rules)


def issues(rows: DataFrame, id_col: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row (id, code, severity) per rule that a row breaks, in one pass over the rows."""
    found = F.array(*[F.when(broken, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, (severity, broken) in rules.items()])
    return rows.select(F.col(id_col).alias("id"), F.explode(F.array_compact(found)).alias("i")).select("id", "i.code", "i.severity")


def new_issues(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Issues of a change that were not there before."""
    return after.join(before.select(*key).distinct(), key, "left_anti")


def worst_status(problems: DataFrame, by: str, severity: str = "severity") -> DataFrame:
    """Status of each plan: its worst problem's."""
    rank = F.when(F.col(severity) == "fatal", 3).when(F.col(severity) == "error", 2).when(F.col(severity) == "warning", 1).otherwise(0)
    g = problems.groupBy(by).agg(F.max(rank).alias("rank"), F.count(severity).alias("n_problems"))
    return g.select(by, F.element_at(F.array(*map(F.lit, STATUSES)), F.col("rank") + 1).alias("status"), "n_problems")


def contest(df: DataFrame, by: list[str], scores: dict[str, Column], least: float = 0.5, margin: float = 0.1) -> DataFrame:
    """Best-scored type per row; none under ``least``, contested if the second is within ``margin``."""
    names = list(scores)
    ranked = F.array_sort(F.array(*[F.struct((-s).alias("neg"), F.lit(i).alias("ord"), F.lit(n).alias("type")) for i, (n, s) in enumerate(zip(names, scores.values(), strict=True))]))
    d = df.select(*by, ranked.alias("r"))
    first, second = -F.col("r")[0]["neg"], -F.col("r")[1]["neg"]
    kind = F.when(first < least, "unknown").otherwise(F.col("r")[0]["type"])
    return d.select(*by, kind.alias("type"), first.alias("score"), ((first >= least) & (first - second < margin)).alias("contested"))


def number_duplicates(df: DataFrame, by: list[str], name: str, size: str, ord_col: str) -> DataFrame:
    """Names used more than once in a plan get numbers, the largest first."""
    w = Window.partitionBy(*by, name)
    n, k = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(F.col(size).desc(), ord_col))
    return df.withColumn("numbered", F.when(n > 1, F.concat_ws(" ", name, k.cast("string"))).otherwise(F.col(name)))


def line_groups(df: DataFrame, by: str, at: Column, factor: float = 1.6) -> DataFrame:
    """Splits each group's ordered rows where the gap exceeds ``factor`` times its median gap."""
    w = Window.partitionBy(by).orderBy("_at", "_ord")
    d = df.withColumn("_at", at).withColumn("_gap", F.col("_at") - F.lag("_at").over(w))
    medians = d.groupBy(by).agg(F.median("_gap").alias("_median"))
    d = d.join(medians, by).withColumn("_new", F.when(F.col("_gap").isNull() | (F.col("_gap") > factor * F.col("_median")), 1).otherwise(0))
    return d.withColumn("line", F.sum("_new").over(w)).groupBy(by, "line").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("start"), F.max("_at").alias("stop"))
