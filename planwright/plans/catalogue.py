"""The registered queries of the plan-analytics operators, with their SQL.

Each query applies an operator to the driver's tables, whose columns stand in for plan relations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwright.functions import geometry as G
from planwright.operators import calibration, editing, rules, spans, spatial, statistics
from planwright.plans.registry import query
from planwright.sources import tables

R = G.rounded


@query("""
WITH p AS (SELECT l_partkey, l_extendedprice / l_quantity AS ppm FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0),
m AS (SELECT l_partkey, median(ppm) AS med, count(*) AS n FROM p GROUP BY l_partkey),
k AS (SELECT p.l_partkey, ppm FROM p JOIN m USING (l_partkey) WHERE abs(ppm / med - 1) <= 0.03),
s AS (SELECT l_partkey, avg(ppm) AS scale, count(*) AS n_used FROM k GROUP BY l_partkey),
r AS (SELECT k.l_partkey, max(abs(ppm / scale - 1)) AS residual FROM k JOIN s USING (l_partkey) GROUP BY k.l_partkey)
SELECT m.l_partkey, floor(med * 1e6 + 0.5) / 1e6 AS median, floor(scale * 1e6 + 0.5) / 1e6 AS scale, coalesce(n_used, 0) AS n_used, n - coalesce(n_used, 0) AS n_rejected,
  floor(residual * 1e6 + 0.5) / 1e6 AS residual,
  CASE WHEN n_used IS NULL THEN 'error' WHEN n_used >= 3 AND residual <= 0.02 THEN 'high' WHEN n_used >= 2 AND residual <= 0.05 THEN 'medium' ELSE 'low' END AS confidence
FROM m LEFT JOIN s USING (l_partkey) LEFT JOIN r USING (l_partkey)""")
def calibrate_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = calibration.from_references(tables.load(spark, sf_dir, "lineitem"), "l_partkey", "l_quantity", "l_extendedprice")
    return out.withColumns({c: R(F.col(c)) for c in ("median", "scale", "residual")})


@query("""
SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS k FROM orders) WHERE k = 1""")
def calibration_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.by_priority(tables.load(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey", "o_orderkey", "o_totalprice")


@query("""
SELECT event_type, floor(avg(value) * 1e6 + 0.5) / 1e6 AS mean, list_sort(list(value))[CAST(count(*) // 2 + 1 AS INT)] AS upper_median, max(value) AS max, count(*) AS n
FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def upper_median_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.summary(tables.load(spark, sf_dir, "events"), "event_type", "value").withColumn("mean", R(F.col("mean")))


SPANS_SQL = """
WITH s AS (
  SELECT l_suppkey AS wall, year(l_shipdate) * 12 + month(l_shipdate) AS floor, l_orderkey * 10 + l_linenumber AS ord,
    CAST(day(l_shipdate) AS DOUBLE) AS start, day(l_shipdate) + l_quantity / 10.0 AS stop FROM lineitem)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_shipdate")
    return tables.load(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("wall"), (F.year(d) * 12 + F.month(d)).alias("floor"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.dayofmonth(d).cast("double").alias("start"), (F.dayofmonth(d) + F.col("l_quantity") / 10.0).alias("stop"),
    )


@query(SPANS_SQL + """
SELECT a.wall, a.floor, a.ord AS first, b.ord AS second, floor((least(a.stop, b.stop) - greatest(a.start, b.start)) * 1e6 + 0.5) / 1e6 AS depth
FROM s a JOIN s b ON a.wall = b.wall AND a.floor = b.floor AND a.start < b.stop AND b.start < a.stop AND a.ord < b.ord""")
def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.overlaps(_spans(spark, sf_dir), ["wall", "floor"]).withColumn("depth", R(F.col("depth")))


@query(SPANS_SQL + """,
c AS (SELECT *, coalesce(max(stop) OVER w, 0) AS cursor, lead(start) OVER (PARTITION BY wall, floor ORDER BY start, stop, ord) IS NULL AS final FROM s
  WINDOW w AS (PARTITION BY wall, floor ORDER BY start, stop, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (
  SELECT wall, floor, 'solid' AS kind, cursor AS a, start AS b FROM c
  UNION ALL SELECT wall, floor, 'opening', greatest(start, cursor), stop FROM c
  UNION ALL SELECT wall, floor, 'solid', greatest(cursor, stop), 31.0 FROM c WHERE final)
SELECT wall, floor, kind, floor(a * 1e6 + 0.5) / 1e6 AS start, floor(b * 1e6 + 0.5) / 1e6 AS stop FROM p WHERE b - a > 0.001""")
def wall_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans.wall_pieces(_spans(spark, sf_dir), ["wall", "floor"], F.lit(31.0))
    return out.withColumns({c: R(F.col(c)) for c in ("start", "stop")})


@query(SPANS_SQL + """,
c AS (SELECT *, max(stop) OVER (PARTITION BY wall, floor ORDER BY start, stop, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY wall, floor ORDER BY start, stop, ord) AS island FROM c)
SELECT wall, floor, min(start) AS start, floor(max(stop) * 1e6 + 0.5) / 1e6 AS stop, count(*) AS n FROM i GROUP BY wall, floor, island""")
def merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.merged(_spans(spark, sf_dir), ["wall", "floor"]).withColumn("stop", R(F.col("stop")))


@query("""
SELECT 'order-missing-customer' AS code, CAST(o_orderkey AS VARCHAR) AS entity, CAST(o_custkey AS VARCHAR) AS ref FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'line-missing-part', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'supplier-missing-label', CAST(s_suppkey AS VARCHAR), CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey NOT IN (SELECT doc_id FROM labels)""")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: tables.load(spark, sf_dir, n)
    return rules.union_rules(
        rules.dangling(t("orders"), "o_orderkey", "o_custkey", t("customer"), "c_custkey", "order-missing-customer"),
        rules.dangling(t("lineitem"), "l_orderkey", "l_partkey", t("part"), "p_partkey", "line-missing-part"),
        rules.dangling(t("supplier"), "s_suppkey", "s_suppkey", t("labels"), "doc_id", "supplier-missing-label"),
    )


@query("""
WITH k AS (SELECT 0 AS o, 'supplier' AS kind, s_suppkey AS id FROM supplier UNION ALL SELECT 1, 'customer', c_custkey FROM customer UNION ALL SELECT 2, 'part', p_partkey FROM part)
SELECT CAST(id AS VARCHAR) AS id, count(*) AS n, arg_min(kind, o) AS first_kind FROM k GROUP BY id HAVING count(*) > 1""")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: tables.load(spark, sf_dir, n)
    return rules.duplicate_ids({"supplier": (t("supplier"), "s_suppkey"), "customer": (t("customer"), "c_custkey"), "part": (t("part"), "p_partkey")})


@query("""
WITH v AS (SELECT vec_id, unnest(range(len(embedding) // 2)) AS i, embedding, len(embedding) // 2 AS n FROM embeddings),
e AS (SELECT vec_id, i, n, CAST(embedding[2 * i + 1] AS DOUBLE) AS ax, CAST(embedding[2 * i + 2] AS DOUBLE) AS az,
  CAST(embedding[2 * ((i + 1) % n) + 1] AS DOUBLE) AS bx, CAST(embedding[2 * ((i + 1) % n) + 2] AS DOUBLE) AS bz FROM v),
s AS (SELECT vec_id, sum(ax * bz - az * bx ORDER BY i) / 2 AS area, sum(sqrt((bx - ax) * (bx - ax) + (bz - az) * (bz - az)) ORDER BY i) AS perimeter, min(ax) AS min_x, max(az) AS max_z FROM e GROUP BY vec_id)
SELECT vec_id, floor(area * 1e6 + 0.5) / 1e6 AS area, floor(perimeter * 1e6 + 0.5) / 1e6 AS perimeter, floor(min_x * 1e6 + 0.5) / 1e6 AS min_x, floor(max_z * 1e6 + 0.5) / 1e6 AS max_z FROM s""")
def polygon_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    ring = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1), lambda i: G.point(F.element_at(v, 2 * i + 1), F.element_at(v, 2 * i + 2)))
    d = tables.load(spark, sf_dir, "embeddings").select("vec_id", ring.alias("p"))
    p = F.col("p")
    return d.select("vec_id", R(G.signed_area(p)).alias("area"), R(G.perimeter(p)).alias("perimeter"), R(G.bounds(p)["min_x"]).alias("min_x"), R(G.bounds(p)["max_z"]).alias("max_z"))


@query("""
WITH r AS (SELECT n_regionkey AS plan, n_nationkey AS room, n_nationkey * 40.0 - 100 AS x0, n_nationkey * 40.0 - 100 + 60 AS x1 FROM nation),
p AS (SELECT n_regionkey AS plan, c_custkey, c_acctbal / 10 AS x, CAST(c_custkey % 97 AS DOUBLE) AS z FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT p.plan, c_custkey, min(room) AS room FROM p LEFT JOIN r ON p.plan = r.plan AND x > x0 + 5e-4 AND x < x1 - 5e-4 AND z > 10.5 + 5e-4 AND z < 80.5 - 5e-4 GROUP BY p.plan, c_custkey""")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = tables.load(spark, sf_dir, "nation")
    x0 = F.col("n_nationkey") * 40.0 - 100
    corner = lambda x, z: G.point(x, F.lit(z))
    rooms = nation.select(F.col("n_regionkey").alias("plan"), F.col("n_nationkey").alias("room"), F.col("n_nationkey").alias("ord"), F.array(corner(x0, 10.5), corner(x0 + 60, 10.5), corner(x0 + 60, 80.5), corner(x0, 80.5)).alias("polygon"))
    points = tables.load(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    points = points.select(F.col("n_regionkey").alias("plan"), "c_custkey", G.point(F.col("c_acctbal") / 10, F.col("c_custkey") % 97).alias("at"))
    return spatial.room_at(points, F.broadcast(rooms), "plan", "c_custkey", "room")


@query("""
SELECT s_suppkey, c_custkey, floor(abs(s_acctbal - c_acctbal) * 1e6 + 0.5) / 1e6 AS gap FROM supplier JOIN customer ON s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) <= 100""")
def bucketed_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = tables.load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", F.col("s_acctbal").alias("bal"))
    b = tables.load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", F.col("c_acctbal").alias("bal"))
    return spatial.near(a, b, "nation", "bal", 100.0).select("s_suppkey", "c_custkey", R(F.abs(F.col("bal") - F.col("bal_right"))).alias("gap"))


@query("""
WITH g AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS sec, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
m AS (SELECT user_id, median(gap) AS med FROM g GROUP BY user_id),
i AS (SELECT g.*, sum(CASE WHEN gap IS NULL OR gap > 1.6 * med THEN 1 ELSE 0 END) OVER (PARTITION BY g.user_id ORDER BY sec, event_id) AS line FROM g JOIN m ON g.user_id = m.user_id)
SELECT user_id, CAST(line AS BIGINT) AS line, count(*) AS n, floor(min(sec) * 1e3 + 0.5) / 1e3 AS start, floor(max(sec) * 1e3 + 0.5) / 1e3 AS stop FROM i GROUP BY user_id, line""")
def line_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.load(spark, sf_dir, "events").withColumn("_ord", F.col("event_id"))
    out = rules.line_groups(d, "user_id", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return out.withColumns({c: R(F.col(c), 3) for c in ("start", "stop")})


@query("""
SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand, p_type) > 1
  THEN p_type || ' ' || row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) ELSE p_type END AS numbered FROM part""")
def number_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.number_duplicates(tables.load(spark, sf_dir, "part"), ["p_brand"], "p_type", "p_retailprice", "p_partkey").select("p_partkey", "numbered")


HIST_SQL = """
WITH h AS (SELECT lang, CAST(least(greatest(n_chars // 64, 0), 255) AS BIGINT) AS bin, count(*) AS n FROM documents GROUP BY ALL),
c AS (SELECT *, sum(n) OVER u AS w0, sum(n * bin) OVER u AS s0, sum(n) OVER (PARTITION BY lang) AS w, sum(n * bin) OVER (PARTITION BY lang) AS s FROM h WINDOW u AS (PARTITION BY lang ORDER BY bin))"""


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.histogram(tables.load(spark, sf_dir, "documents"), F.floor(F.col("n_chars") / 64), ["lang"])


@query(HIST_SQL + """,
v AS (SELECT lang, bin, CAST(w0 AS DOUBLE) * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2) AS var FROM c WHERE w > w0)
SELECT lang, bin + 1 AS threshold, floor(var * 10 + 0.5) / 10 AS variance FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY var DESC, bin) AS k FROM v) WHERE k = 1""")
def histogram_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.otsu(_bins(spark, sf_dir), ["lang"]).withColumn("variance", R(F.col("variance"), 1))


@query(HIST_SQL + """,
p AS (SELECT lang, min(bin) FILTER (WHERE w0 > w * CAST(0.005 AS DOUBLE)) AS lo, min(bin) FILTER (WHERE w0 >= w * CAST(0.995 AS DOUBLE)) AS hi FROM c GROUP BY lang)
SELECT lang, lo, hi, floor((CASE WHEN hi - lo >= 16 THEN CAST(255 AS DOUBLE) / (hi - lo) ELSE 1.0 END) * 1e6 + 0.5) / 1e6 AS gain FROM p""")
def contrast_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.stretch(_bins(spark, sf_dir), ["lang"]).withColumn("gain", R(F.col("gain")))


@query(r"""
WITH s AS (SELECT doc_id, CAST(length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS DOUBLE) / greatest(length(text), 1) AS letters,
  CAST(length(regexp_replace(text, '[^ \n]', '', 'g')) AS DOUBLE) / greatest(length(text), 1) AS spaces FROM documents),
b AS (SELECT doc_id, greatest(0, least(1, CASE WHEN letters < CAST(0.6 AS DOUBLE) THEN 1 - (CAST(0.6 AS DOUBLE) - letters) / CAST(0.4 AS DOUBLE) WHEN letters > CAST(0.9 AS DOUBLE) THEN 1 - (letters - CAST(0.9 AS DOUBLE)) / CAST(0.4 AS DOUBLE) ELSE 1.0 END)) AS a,
  greatest(0, least(1, CASE WHEN spaces < CAST(0.1 AS DOUBLE) THEN 1 - (CAST(0.1 AS DOUBLE) - spaces) / CAST(0.08 AS DOUBLE) WHEN spaces > CAST(0.25 AS DOUBLE) THEN 1 - (spaces - CAST(0.25 AS DOUBLE)) / CAST(0.08 AS DOUBLE) ELSE 1.0 END)) AS c FROM s),
g AS (SELECT doc_id, round(least(CAST(0.97 AS DOUBLE), greatest(CAST(0.03 AS DOUBLE), CAST(0.03 AS DOUBLE) + CAST(0.94 AS DOUBLE) * pow(a * c, 0.5))), 3) AS score FROM b)
SELECT doc_id, score, CASE WHEN score >= 0.6 THEN 'LIKELY_FLOOR_PLAN' WHEN score >= 0.3 THEN 'UNCERTAIN' ELSE 'UNLIKELY_FLOOR_PLAN' END AS verdict FROM g""")
def band_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda keep: F.length(F.regexp_replace("text", keep, "")).cast("double") / F.greatest(F.length("text"), F.lit(1))
    d = tables.load(spark, sf_dir, "documents").select("doc_id", share("[^a-zA-Z]").alias("letters"), share(r"[^ \n]").alias("spaces"))
    score, word = statistics.verdict([statistics.band(F.col("letters"), 0.6, 0.9, 0.4), statistics.band(F.col("spaces"), 0.1, 0.25, 0.08)])
    return d.select("doc_id", score.alias("score"), word.alias("verdict"))


@query("""
WITH o AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS mean FROM orders GROUP BY o_custkey),
s AS (SELECT o_custkey, least(1.0, n / 20.0) AS busy, least(1.0, mean / 300000) AS rich, CAST(0.55 AS DOUBLE) AS plain FROM o),
l AS (SELECT o_custkey, unnest([busy, rich, plain]) AS score, unnest(['busy', 'rich', 'plain']) AS type, unnest([0, 1, 2]) AS ord FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, ord) AS k FROM l)
SELECT a.o_custkey, CASE WHEN a.score < 0.5 THEN 'unknown' ELSE a.type END AS type, floor(a.score * 1e6 + 0.5) / 1e6 AS score, a.score >= 0.5 AND a.score - b.score < CAST(0.1 AS DOUBLE) AS contested
FROM k a JOIN k b ON a.o_custkey = b.o_custkey AND a.k = 1 AND b.k = 2""")
def classify_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean"))
    scores = {"busy": F.least(F.lit(1.0), F.col("n") / 20.0), "rich": F.least(F.lit(1.0), F.col("mean") / 300000), "plain": F.lit(0.55)}
    return rules.contest(o, ["o_custkey"], scores).withColumn("score", R(F.col("score")))


ISSUES_SQL = """
WITH i AS (
  SELECT o_custkey AS plan, o_orderkey AS id, 'price-high' AS code, 'error' AS severity FROM orders WHERE o_totalprice > 400000
  UNION ALL SELECT o_custkey, o_orderkey, 'price-low', 'warning' FROM orders WHERE o_totalprice < 2000
  UNION ALL SELECT o_custkey, o_orderkey, 'status-open', 'info' FROM orders WHERE o_orderstatus = 'O')"""


def _issues(spark: SparkSession, sf_dir: str, high: float = 400000) -> DataFrame:
    o = tables.load(spark, sf_dir, "orders").withColumn("key", F.struct("o_custkey", "o_orderkey"))
    found = rules.issues(o, "key", {"price-high": ("error", F.col("o_totalprice") > high), "price-low": ("warning", F.col("o_totalprice") < 2000), "status-open": ("info", F.col("o_orderstatus") == "O")})
    return found.select(F.col("id.o_custkey").alias("plan"), F.col("id.o_orderkey").alias("id"), "code", "severity")


@query(ISSUES_SQL + """
SELECT plan, ['ok', 'ok-with-warnings', 'needs-review', 'failed'][max(CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) + 1] AS status, count(*) AS n_problems FROM i GROUP BY plan""")
def review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.worst_status(_issues(spark, sf_dir), "plan")


@query("""
SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS n_bad, floor(avg(CASE WHEN c_acctbal < 0 THEN 0.3 ELSE 0.9 END) * 1e6 + 0.5) / 1e6 AS confidence,
  CASE WHEN count(*) FILTER (WHERE c_acctbal < 0) = 0 THEN 'ok' WHEN avg(CASE WHEN c_acctbal < 0 THEN 0.3 ELSE 0.9 END) >= 0.8 THEN 'ok-with-warnings' ELSE 'needs-review' END AS status
FROM customer GROUP BY c_mktsegment""")
def component_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("c_acctbal") < 0
    g = tables.load(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_bad"), F.avg(F.when(bad, 0.3).otherwise(0.9)).alias("c"))
    status = F.when(F.col("n_bad") == 0, "ok").when(F.col("c") >= 0.8, "ok-with-warnings").otherwise("needs-review")
    return g.select("c_mktsegment", "n", "n_bad", R(F.col("c")).alias("confidence"), status.alias("status"))


@query("""
WITH p AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'click') AS a, avg(value) FILTER (WHERE event_type = 'purchase') AS b, avg(value) FILTER (WHERE event_type = 'error') AS c FROM events GROUP BY user_id)
SELECT user_id, floor((coalesce(a * 0.5, 0) + coalesce(b * 0.3, 0) + coalesce(c * 0.2, 0)) / nullif(CASE WHEN a IS NULL THEN 0 ELSE CAST(0.5 AS DOUBLE) END + CASE WHEN b IS NULL THEN 0 ELSE CAST(0.3 AS DOUBLE) END + CASE WHEN c IS NULL THEN 0 ELSE CAST(0.2 AS DOUBLE) END, 0) * 1e4 + 0.5) / 1e4 AS confidence FROM p""")
def weighted_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    g = tables.load(spark, sf_dir, "events").groupBy("user_id").agg(part("click").alias("a"), part("purchase").alias("b"), part("error").alias("c"))
    return g.select("user_id", R(statistics.weighted_confidence({"a": (F.col("a"), 0.5), "b": (F.col("b"), 0.3), "c": (F.col("c"), 0.2)}), 4).alias("confidence"))


@query("""
WITH j AS (SELECT lang, n_chars >= 1000 AS found, quality = 1 AS good FROM documents JOIN labels USING (doc_id))
SELECT lang, count(*) FILTER (WHERE found AND good) AS hits, count(*) FILTER (WHERE found) AS found, count(*) FILTER (WHERE good) AS present,
  count(*) FILTER (WHERE found AND good) / nullif(count(*) FILTER (WHERE found), 0) AS precision, count(*) FILTER (WHERE found AND good) / nullif(count(*) FILTER (WHERE good), 0) AS recall FROM j GROUP BY lang""")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(tables.load(spark, sf_dir, "labels"), "doc_id")
    return statistics.precision_recall(d, ["lang"], F.col("n_chars") >= 1000, F.col("quality") == 1)


@query()
def nearest_unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.load(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("at"), "event_type")
    return statistics.nearest_unique(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "user_id", 0.6)


@query("""
WITH c AS (SELECT p_brand, p_partkey, p_size, pos, abs(pos / 10.0 - p_size / 2.0) + 100 * CASE WHEN pos > p_size * 8 THEN 1 ELSE 0 END AS total FROM part, range(0, 201, 20) AS r(pos))
SELECT p_brand, p_partkey, floor(total * 1e6 + 0.5) / 1e6 AS total, CAST(pos AS BIGINT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_partkey ORDER BY total, pos) AS k FROM c) WHERE k = 1""")
def best_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.dealt(spark, sf_dir, "part", "p_partkey").select("p_brand", "p_partkey", "p_size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(200).cast("long"), F.lit(20).cast("long"))).alias("pos"))
    total = F.abs(F.col("pos") / 10.0 - F.col("p_size") / 2.0) + 100 * F.when(F.col("pos") > F.col("p_size") * 8, 1).otherwise(0)
    return editing.best_candidate(c, ["p_brand", "p_partkey"], total, "pos", "pos").withColumn("total", R(F.col("total")))


@query()
def sequential_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("room"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), (F.col("l_quantity") / 10).alias("width"), F.lit(60.0).alias("length"))
    return editing.sequential_fit(d, "room", "length")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS u, 1000 + c_custkey % 40 AS v FROM customer),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT u AS node, u AS reach FROM b UNION SELECT r.node, b.v FROM r JOIN b ON b.u = r.reach)
SELECT CAST(node AS BIGINT) AS node, CAST(min(reach) AS BIGINT) AS label FROM r GROUP BY node""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.load(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("u"), (1000 + F.col("c_custkey") % 40).alias("v")).distinct()
    return spatial.components(e)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS u, 1000 + c_custkey % 40 AS v FROM customer),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT u AS node, u AS reach FROM b UNION SELECT r.node, b.v FROM r JOIN b ON b.u = r.reach)
SELECT CAST(node AS BIGINT) AS node, CAST(min(reach) AS BIGINT) AS label FROM r GROUP BY node""")
def connected_components_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(spark, sf_dir)


@query("""
SELECT user_id, count(*) AS version, arg_max(value, struct_pack(a := ts, b := event_id)) FILTER (WHERE event_type = 'click') AS width,
  arg_max(value, struct_pack(a := ts, b := event_id)) FILTER (WHERE event_type = 'view') AS depth FROM events GROUP BY user_id""")
def command_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = lambda t: F.when(F.col("event_type") == t, F.col("value"))
    return editing.folded(tables.load(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], {"width": field("click"), "depth": field("view")})


@query("""
WITH l AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS entry FROM l),
g AS (SELECT user_id, CAST(entry AS BIGINT) AS entry, min(event_type) AS key, count(*) AS n_commands FROM i GROUP BY user_id, entry)
SELECT user_id, entry, key, n_commands FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY entry DESC) AS k FROM g) WHERE k <= 200""")
def coalesced_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editing.coalesced(tables.load(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT o_custkey AS plan, o_orderkey AS id, 'price-high' AS code, 'error' AS severity FROM orders WHERE o_totalprice > 350000 AND o_totalprice <= 400000")
def issue_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.new_issues(_issues(spark, sf_dir), _issues(spark, sf_dir, 350000), ["plan", "id", "code"]).select("plan", "id", "code", "severity")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_type), 'red') AND contains(lower(p_name || ' ' || p_type), 'widget')")
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editing.catalog_search(tables.load(spark, sf_dir, "part"), F.concat_ws(" ", "p_name", "p_type"), "Red widget").select("p_partkey", "p_name")


@query("""
SELECT event_id AS id, props IS NOT NULL AS parsed, array_to_string(list_sort(list_filter(json_keys(props), lambda x: x NOT IN ('page', 'k'))), ',') AS unexpected,
  array_to_string(list_sort(list_filter(['page', 'need'], lambda x: NOT list_contains(json_keys(props), x))), ',') AS missing FROM events""")
def json_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editing.json_contract(tables.load(spark, sf_dir, "events"), "event_id", "props", ["page", "k"], ["page", "need"])


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'user' ELSE 'automatic' END AS area_source, 'assumed' AS height_source, 2 AS schema_version FROM orders""")
def migrate_v1_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    v1 = F.struct(F.when(F.col("o_orderstatus") == "F", "user").otherwise("automatic").alias("source"), F.lit(1).alias("version"))
    old = tables.load(spark, sf_dir, "orders").select("o_orderkey", v1.alias("doc"))
    new = tables.migrated(old, "doc")
    return new.select("o_orderkey", F.col("doc.sources.area").alias("area_source"), F.col("doc.sources.height").alias("height_source"), F.col("doc.version").alias("schema_version"))


@query(r"""
SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\?|^(?:what|how|which|where|why)\b') THEN 'question' WHEN regexp_matches(lower(text), '\b(?:remove|delete|clear)\b') THEN 'remove'
  WHEN regexp_matches(lower(text), '\b(?:paint|renovate|floor|wall)\b') THEN 'renovate' WHEN regexp_matches(lower(text), '\b(?:add|put|place|fit)\b') THEN 'place'
  WHEN regexp_matches(lower(text), '\b(?:describe|list|show|the)\b') THEN 'describe' ELSE 'unknown' END AS intent FROM conversations WHERE role = 'user'""")
def intent_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", editing.intent(F.col("text")).alias("intent"))
