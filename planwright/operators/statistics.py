"""Statistics of measurements: upper medians, histograms, thresholds, scores and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwright.operators.spatial import near
from planwright.sources.lineage import cut

#: Ranges into which a group's values are dealt.
PARTS = 1024


def summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, upper median (the later of a middle pair), greatest value and count per group.

    Values are counted before they are ordered, in ranges of a group's values that are dealt to many
    tasks; the median is looked for in the one range that holds it, so no group is gathered.
    """
    d = df.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("v"))
    whole = d.groupBy(by).agg(F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("max"), F.count(F.lit(1)).alias("n"))
    counts = d.groupBy(by, "v").agg(F.count(F.lit(1)).alias("k")).join(whole, by)
    wide = F.col("max") - F.col("low")
    counts = counts.withColumn("part", F.when(wide > 0, F.least(F.floor((F.col("v") - F.col("low")) / wide * PARTS), F.lit(PARTS - 1))).otherwise(F.lit(0)))
    parts = counts.groupBy(by, "part").agg(F.sum("k").alias("in_part"))
    parts = parts.withColumn("before", F.sum("in_part").over(Window.partitionBy(by).orderBy("part")) - F.col("in_part"))
    middle = F.floor(F.col("n") / 2)
    held = counts.join(parts, [by, "part"]).where((F.col("before") <= middle) & (middle < F.col("before") + F.col("in_part")))
    up_to = F.col("before") + F.sum("k").over(Window.partitionBy(by, "part").orderBy("v"))
    found = held.withColumn("up_to", up_to).where(F.col("up_to") > middle).groupBy(by).agg(F.min("v").alias("upper_median"))
    return whole.join(found, by).select(by, "mean", "upper_median", "max", "n")


def histogram(df: DataFrame, bin_expr: Column, by: list[str], bins: int = 256) -> DataFrame:
    """Counts per bin, clipped to 0 and the last bin."""
    b = F.least(F.greatest(bin_expr.cast("long"), F.lit(0)), F.lit(bins - 1))
    return df.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def otsu(hist: DataFrame, by: list[str]) -> DataFrame:
    """Threshold of greatest between-class variance per group; the first of equals wins.

    Windows run over the bins, which are few, never over the measurements.
    """
    up = Window.partitionBy(*by).orderBy("bin")
    every = Window.partitionBy(*by)
    h = hist.withColumn("w0", F.sum("n").over(up)).withColumn("s0", F.sum(F.col("n") * F.col("bin")).over(up)).withColumn("w", F.sum("n").over(every)).withColumn("s", F.sum(F.col("n") * F.col("bin")).over(every))
    h = h.withColumn("w1", F.col("w") - F.col("w0")).where("w1 > 0")
    d = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.col("w1")
    h = h.withColumn("variance", F.col("w0").cast("double") * F.col("w1") * d * d)
    best = F.max_by(F.struct("bin", "variance"), F.struct("variance", -F.col("bin"))).alias("best")
    return h.groupBy(*by).agg(best).select(*by, (F.col("best.bin") + 1).alias("threshold"), F.col("best.variance").alias("variance"))


def stretch(hist: DataFrame, by: list[str], low: float = 0.005, high: float = 0.995, least: int = 16) -> DataFrame:
    """Linear contrast stretch between two percentiles; none where the range is under ``least``."""
    up, every = Window.partitionBy(*by).orderBy("bin"), Window.partitionBy(*by)
    h = hist.withColumn("c", F.sum("n").over(up)).withColumn("w", F.sum("n").over(every))
    lo, hi = F.min(F.when(F.col("c") > F.col("w") * low, F.col("bin"))), F.min(F.when(F.col("c") >= F.col("w") * high, F.col("bin")))
    g = h.groupBy(*by).agg(lo.alias("lo"), hi.alias("hi"))
    wide = F.col("hi") - F.col("lo") >= least
    return g.select(*by, "lo", "hi", F.when(wide, F.lit(255.0) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(1.0)).alias("gain"))


def _clamped(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def band(value: Column, low: float, high: float, soft: float) -> Column:
    """1 from ``low`` to ``high``, falling to 0 over ``soft`` beyond either."""
    return _clamped(F.when(value < low, 1 - (low - value) / soft).when(value > high, 1 - (value - high) / soft).otherwise(F.lit(1.0)))


def verdict(scores: list[Column]) -> tuple[Column, Column]:
    """A confidence from the geometric mean of scores, never certain either way, and its word."""
    product = scores[0]
    for s in scores[1:]:
        product = product * s
    mean = F.round(F.least(F.lit(0.97), F.greatest(F.lit(0.03), 0.03 + 0.94 * F.pow(product, F.lit(1.0 / len(scores))))), 3)
    return mean, F.when(mean >= 0.6, "LIKELY_FLOOR_PLAN").when(mean >= 0.3, "UNCERTAIN").otherwise("UNLIKELY_FLOOR_PLAN")


def document_check(ink: Column, straight: Column, paper: Column, specks: Column) -> tuple[Column, Column]:
    """Whether an image is a plan, from the shares of ink, straight ink, plain paper and specks."""
    return verdict([band(ink, 0.01, 0.3, 0.15), _clamped((straight - 0.08) / 0.3), _clamped((paper - 0.25) / 0.35), _clamped(1 - (specks - 0.15) / 0.3)])


def weighted_confidence(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of part confidences; a part without a value drops out with its weight."""
    top = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in parts.values()), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in parts.values()), F.lit(0.0))
    return F.when(weight > 0, top / weight)


def precision_recall(df: DataFrame, by: list[str], found: Column, true: Column) -> DataFrame:
    """Precision, recall and counts of a boolean finding."""
    hit, claimed, there = (F.sum(c.cast("long")) for c in (found & true, found, true))
    return df.groupBy(*by).agg(hit.alias("hits"), claimed.alias("found"), there.alias("present")).select(
        *by, "hits", "found", "present", F.try_divide("hits", "found").alias("precision"), F.try_divide("hits", "present").alias("recall")
    )


def nearest_unique(left: DataFrame, right: DataFrame, key: str, radius: float) -> DataFrame:
    """Greedy one-to-one matches per key: nearest pair first, each side used once.

    Both sides have (key, id, at).  Pairs within the radius meet in cells.  A pair that is the nearest of
    both its sides is taken, whatever is taken elsewhere; the pairs of its sides drop out, and the next
    round looks at the rest, until none is left.
    """
    a, b = left.select(key, F.col("id").alias("left_id"), "at"), right.select(key, F.col("id").alias("right_id"), "at")
    pairs = cut(near(a, b, key, "at", radius).select(key, "left_id", "right_id", F.abs(F.col("at") - F.col("at_right")).alias("gap")))
    order = F.struct("gap", "left_id", "right_id")
    taken = pairs.limit(0)
    while pairs.take(1):
        ranked = pairs.select("*", *[F.min(order).over(Window.partitionBy(key, side)).alias(f"_{side}") for side in ("left_id", "right_id")])
        won = cut(ranked.where((F.col("_left_id") == order) & (F.col("_right_id") == order)).select(*pairs.columns))
        taken = taken.unionByName(won)
        pairs = pairs.join(won.select(key, "left_id"), [key, "left_id"], "left_anti").join(won.select(key, "right_id"), [key, "right_id"], "left_anti")
        pairs = cut(pairs.select(*won.columns))
    return taken
