"""Registered queries of the text operators, on cases dealt over the driver's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planwright.functions import geometry as G
from planwright.functions import labels as L
from planwright.functions import lexicon as X
from planwright.operators import plan_text
from planwright.plans.registry import query
from planwright.sources import tables

#: Labels with the type and the name they have, or neither.
NAMES = [
    ("BEDROOM", "bedroom", "Bedroom"), ("BED ROOM", "bedroom", "Bedroom"), ("BEDR00M", "bedroom", "Bedroom"), ("Bedroom 2", "bedroom", "Bedroom 2"), ("Kitchen/Lounge/Diner", "kitchen-living", "Kitchen / Lounge / Diner"),
    ("LIVING / DINING", "living", "Living / Dining"), ("En-suite", "bathroom", "En-suite"), ("W.C.", "toilet", "WC"), ("Balcony", "balcony", "Balcony"), ("Living Room", "living", "Living"), ("master bed", "bedroom", "Master Bedroom"),
    ("bed 1", "bedroom", "Bedroom 1"), ("w/c", "toilet", "WC"), ("t&b", "bathroom", "Bathroom"), ("Reception", "living", "Reception"), ("Utility Room", "utility", "Utility"), ("Store", "storage", "Store"), ("CHAMBRE", "bedroom", "Chambre"),
    ("Küche", "kitchen", "Küche"), ("SALON", "living", "Salon"), ("Wohnzimmer", "living", "Wohnzimmer"), ("Study", "unknown", "Study"), ("3.84m x 2.66m", None, None), ("(excluding Balcony)", None, None),
    ("Ceiling height reduced in the kitchen area", None, None), ("XQZT", None, None), ("NE", None, None),
]
#: Texts with the area and the floor they name.
PLACES = [("Approx. 57.4 sq. metres", 57.4, None), ("Total area 68,6 m²", 68.6, None), ("Approx. 68.6 sq m", 68.6, None), ("Bedroom", None, None), ("THIRD FLOOR", None, "Third Floor"), ("Lower ground floor", None, "Lower Ground Floor"), ("Floor plan", None, None)]


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _values(rows: list[tuple]) -> str:
    return ", ".join(f"({k}, {', '.join(map(_literal, r))})" for k, r in enumerate(rows))


def _dealt(cases: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, cases)), (F.col("p_partkey") % len(cases) + 1).cast("int"))


@query(f"""
WITH c(k, text, type, display) AS (VALUES {_values(NAMES)})
SELECT p_partkey, text AS raw, type, display FROM part JOIN c ON p_partkey % {len(NAMES)} = k WHERE type IS NOT NULL""")
def room_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.load(spark, sf_dir, "part").select("p_partkey", _dealt([n[0] for n in NAMES]).alias("text"), F.lit(0.9).alias("confidence"))
    return plan_text.room_names(lines, ["p_partkey"]).select("p_partkey", "raw", "type", "display")


@query(f"""
WITH c(k, text, area, floor) AS (VALUES {_values(PLACES)})
SELECT p_partkey, CAST(area AS DOUBLE) AS area, floor FROM part JOIN c ON p_partkey % {len(PLACES)} = k""")
def areas_and_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.load(spark, sf_dir, "part").select("p_partkey", _dealt([n[0] for n in PLACES]).alias("text"))
    return d.select("p_partkey", L.parse_area(F.col("text")).alias("area"), L.parse_floor(F.col("text")).alias("floor"))


@query("""
WITH t AS (SELECT p_partkey, p_partkey % 8 AS k, CAST(p_size AS DOUBLE) AS s, CASE p_partkey % 8 WHEN 0 THEN p_size || '.50m x ' || p_size || '.25m' WHEN 1 THEN (p_size * 100 + 1000) || ' x ' || (p_size * 10 + 2000) || ' mm'
  WHEN 2 THEN p_size || '.75 m' WHEN 3 THEN p_size || '''6"' WHEN 4 THEN p_size || '''0"X5''6"' WHEN 5 THEN p_size || ',20 x 2,95' WHEN 6 THEN CAST(p_size * 100 + 300 AS VARCHAR) ELSE p_name END AS text FROM part)
SELECT p_partkey, text, floor(CASE k WHEN 0 THEN s + 0.5 WHEN 1 THEN (s * 100 + 1000) / 1000 WHEN 2 THEN s + 0.75 WHEN 3 THEN s * CAST(0.3048 AS DOUBLE) + CAST(0.1524 AS DOUBLE) WHEN 4 THEN s * CAST(0.3048 AS DOUBLE) WHEN 5 THEN s + CAST(0.2 AS DOUBLE) WHEN 6 THEN (s * 100 + 300) / 1000 END * 10000 + 0.5) / 10000 AS width,
  floor(CASE k WHEN 0 THEN s + 0.25 WHEN 1 THEN (s * 10 + 2000) / 1000 WHEN 4 THEN CAST(1.6764 AS DOUBLE) WHEN 5 THEN CAST(2.95 AS DOUBLE) END * 10000 + 0.5) / 10000 AS depth,
  CASE k WHEN 0 THEN 'm' WHEN 1 THEN 'mm' WHEN 2 THEN 'm' WHEN 3 THEN 'ft' WHEN 4 THEN 'ft' WHEN 5 THEN 'm' WHEN 6 THEN 'mm' END AS unit FROM t""")
def parse_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 8
    text = F.when(k == 0, F.concat(s, F.lit(".50m x "), s, F.lit(".25m"))).when(k == 1, F.concat((F.col("p_size") * 100 + 1000).cast("string"), F.lit(" x "), (F.col("p_size") * 10 + 2000).cast("string"), F.lit(" mm")))
    text = text.when(k == 2, F.concat(s, F.lit(".75 m"))).when(k == 3, F.concat(s, F.lit("'6\""))).when(k == 4, F.concat(s, F.lit("'0\"X5'6\""))).when(k == 5, F.concat(s, F.lit(",20 x 2,95"))).when(k == 6, (F.col("p_size") * 100 + 300).cast("string"))
    d = tables.load(spark, sf_dir, "part").select("p_partkey", text.otherwise(F.col("p_name")).alias("text")).withColumn("d", L.parse_dimension(F.col("text")))
    values = F.col("d.values")
    return d.select("p_partkey", "text", G.rounded(F.get(values, 0), 4).alias("width"), G.rounded(F.get(values, 1), 4).alias("depth"), F.col("d.unit").alias("unit"))


LEXICON_SQL = ", ".join(f"({i}, {_literal(w)}, {_literal(t)}, {0 if len(w) <= 3 else 1 if len(w) <= 5 else 2})" for i, (w, t, _, _) in enumerate(X.LEXICON))


@query(f"""
WITH lex(ord, word, type, bound) AS (VALUES {LEXICON_SQL}),
t AS (SELECT DISTINCT upper(token) AS token FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]{{3,16}}')) AS token FROM documents UNION ALL SELECT unnest(regexp_extract_all(p_name, '[A-Za-z0-9]{{3,16}}')) FROM part)),
m AS (SELECT token, word, type, levenshtein(translate(token, '01586', 'OISBG'), word) AS d, ord, bound FROM t, lex)
SELECT token, word, type, d AS edits FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY d, ord) AS k FROM m WHERE d <= bound) WHERE k = 1""")
def fuzzy_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda c: F.explode(F.regexp_extract_all(c, F.lit("[A-Za-z0-9]{3,16}"), 0))
    tokens = tables.load(spark, sf_dir, "documents").select(words(F.col("text")).alias("token")).unionByName(tables.load(spark, sf_dir, "part").select(words(F.col("p_name")).alias("token")))
    return plan_text.nearest_words(tokens.select(F.upper("token").alias("token"))).select("token", "best.word", "best.type", F.col("best.edits").cast("long").alias("edits"))


@query("""
WITH f AS (SELECT DISTINCT p_brand, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') AS f FROM part),
e AS (SELECT p_brand, p_partkey, regexp_replace(upper(split_part(p_name, ' ', 1) || '-' || p_size), '[^A-Z0-9]', '', 'g') AS e FROM part),
h AS (SELECT e.p_brand, p_partkey, bool_or(contains(f, e) OR contains(e, f)) AS hit FROM e JOIN f USING (p_brand) GROUP BY ALL)
SELECT p_brand, count(*) AS expected, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE hit) / count(*) AS recall FROM h GROUP BY p_brand""")
def label_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables.load(spark, sf_dir, "part")
    expected = part.select("p_brand", F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("-"), F.col("p_size").cast("string")).alias("label"))
    return plan_text.label_recall(part.select("p_brand", F.col("p_name").alias("label")), expected, "p_brand")
