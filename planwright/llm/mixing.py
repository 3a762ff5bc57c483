"""Mixing sources to target weights: repetition rates and hash-seeded Bernoulli copies.

Method: aggregate tokens per source, derive each source's target and repetition rate, then emit
each document floor(rate) times plus one copy drawn by a hash of its id with probability equal to
the fraction.  DataFrame functions only.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a
source of size 0 has target 0 and takes nothing; rows that repeat a doc_id share one draw; a null id
draws by its text; a very long text counts whole and is taken whole or not; in ``mixed`` all columns
pass through unchanged, and the number of the copy takes a name with underscores behind it where a
column is called ``copy``; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fields, free_name, whole_rows

#: Weights dealt to the sources in code-point order, again and again.
WEIGHTS = (5, 2, 1)
#: Share of all tokens that the mix holds, and the most passes over one source.
SHARE, MOST = 1.5, 2
#: Hex digits of the hash that a draw uses (52 bits: exact as a double).
DIGITS = 13


def n_words(text: Column) -> Column:
    """Number of maximal runs of code points other than 0x20 and 0x09-0x0D; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on the id alone, or on the text where there is no id."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("no id: "), F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Tokens each source is to give, from one row (source, source_size) per source.

    Filling by weight with caps: with sources ordered by cap per weight, those below the common
    level are capped, and the level follows from what they leave.  The windows run over one row per
    source, never over documents: one task sorts them, which holds for millions of sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_k", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_k") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), "_k")
    everything = Window.partitionBy()
    filled = (
        ranked.withColumn("_goal", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_below", F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_above", F.sum("_w").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_goal") - F.col("_below")) / F.col("_above"))
        .withColumn("_free", F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level")))
        .withColumn("_final", F.max("_free").over(everything))
    )
    level = F.least(F.col("_cap"), F.col("_final") * F.col("_w"))
    return filled.select("source", "source_size", F.coalesce(level, F.col("_cap")).alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, rate, copies.

    The source sums are partial sums before the shuffle, so a hot source costs one row per task.
    The join back is on the source; its small side has one row per source, and Spark broadcasts it
    only below the session's size threshold, else splits a hot source's partition.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), draw(F.col(id_col), F.col(text_col)).alias("draw"))
    goal = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most).withColumnRenamed("source", "goal_source")
    joined = base.join(goal, F.col("source").eqNullSafe(F.col("goal_source")), "left").withColumn("rate", _rate())
    copies = _copies(F.col("rate"), F.col("draw")).cast("long")
    return joined.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")


def _rate() -> Column:
    """Passes over a source."""
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def _copies(rate: Column, drawn: Column) -> Column:
    return F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: every document's row, repeated as often as it is taken, with ``copy`` from 0."""
    whole = whole_rows(docs, source=docs[source_col], draw=draw(docs[id_col], docs[text_col]))
    sums = docs.select(docs[source_col].alias("source"), n_words(docs[text_col]).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sums, weights, share, most).withColumnRenamed("source", "goal_source")
    joined = whole.join(goal, F.col("source").eqNullSafe(F.col("goal_source")), "left")
    places = F.sequence(F.lit(1), _copies(_rate(), F.col("draw")).cast("int"))
    taken = joined.where(_copies(_rate(), F.col("draw")) > 0).select("row", F.explode(places).alias("place"))
    return taken.select(*fields(docs), (F.col("place") - 1).alias(free_name(docs, "copy")))


#: The plan as DuckDB SQL; ``{docs}`` is the table.
PLAN_SQL = r"""
WITH base AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM {docs}),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS k FROM sums),
capped AS (
  SELECT *, CAST([5, 2, 1][CAST(k % 3 + 1 AS INT)] AS DOUBLE) AS w, source_size * CAST(2 AS DOUBLE) AS cap FROM ranked),
filled AS (
  SELECT *,
    CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS goal,
    coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above
  FROM capped),
levels AS (
  SELECT *, max(CASE WHEN (goal - below) / above * w <= cap THEN (goal - below) / above END) OVER () AS final FROM filled),
goals AS (SELECT source, source_size, coalesce(least(cap, final * w), cap) AS target FROM levels),
rates AS (
  SELECT b.doc_id, b.text, b.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate
  FROM base b JOIN goals g ON b.source IS NOT DISTINCT FROM g.source),
drawn AS (
  SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN
      CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'no id: ' || coalesce(text, ''))), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 < rate - floor(rate)
    THEN 1 ELSE 0 END AS copies FROM rates)
SELECT doc_id, size, source_size, target, size * copies AS taken, rate, copies FROM drawn
"""
