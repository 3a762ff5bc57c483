"""Line dedup by distinct-site spread, with DataFrame functions only.

Method: one HyperLogLog sketch of the sites per line hash, merged by aggregation; lines whose
estimate lies near the threshold get an exact distinct count; lines on at least ``sites`` sites are
boilerplate and go from every document but the one that has them first (smallest id, then
position), so each line's text survives once.

Defined results: a line without a word is never boilerplate; a null source is no site; a null text
has no lines and stays null; an empty text has one empty line and stays empty; ties on the id fall
to a hash of the text, then the position; rows that repeat a document whole all count as first
together; null ids come first and are told apart by their texts; a very long text is split and joined
whole, in time that follows its lines; all columns pass through under their names, and the two counts
take names with underscores behind them where a column has theirs; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fields, free_name, whole_rows

#: Distinct sites from which a line counts as boilerplate.
SITES = 5
#: log2 of the sketch's buckets, and the relative error allowed for (over three standard errors).
LG_K, ERROR = 12, 0.06
HAS_WORD = r"[^\x20\x09-\x0D]"


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """One row per line with a word: its place and two hashes of it (96 bits)."""
    text = F.col(text_col)
    return (
        docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.col(site_col).alias("site"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
        .where(F.col("line").rlike(HAS_WORD))
        .select("id", "th", "pos", "site", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))
    )


def boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """Line hashes on at least ``sites`` distinct sites, with the place that keeps the line."""
    lines = _lines(docs, id_col, text_col, site_col)
    spread = (
        lines.groupBy("h1", "h2")
        .agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.count("site").alias("n"), F.min(F.struct("id", "th", "pos")).alias("first"))
        .where(F.col("n") >= sites)
        .select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("estimate"))
    )
    margin = max(1.0, ERROR * sites)
    sure = spread.where(F.col("estimate") > sites + margin).select("h1", "h2", "first")
    near = spread.where(F.abs(F.col("estimate") - sites) <= margin).select("h1", "h2", "first")
    exact = (
        lines.select("h1", "h2", "site")
        .join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
        .where(F.col("site").isNotNull())
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("exact"))
        .where(F.col("exact") >= sites)
        .select("h1", "h2")
    )
    return sure.unionByName(near.join(exact, ["h1", "h2"], "left_semi"))


def _without(lines: Column, drop: Column) -> Column:
    """The array without the places in the sorted array ``drop``: the slices between them, joined."""
    edges = F.concat(F.array(F.lit(-1)), drop, F.array(F.size(lines)))
    between = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda k: F.slice(lines, F.get(edges, k - 1) + 2, F.get(edges, k) - F.get(edges, k - 1) - 1))
    return F.flatten(between)


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, plus ``n_lines`` and ``n_removed``."""
    common = boilerplate(docs, id_col, text_col, site_col, sites)
    hits = _lines(docs, id_col, text_col, site_col).select("id", "th", "pos", "h1", "h2").join(common, ["h1", "h2"])
    place = F.struct("id", "th", "pos")
    drop = hits.where(~place.eqNullSafe(F.col("first"))).groupBy("id", "th").agg(F.sort_array(F.collect_set("pos")).alias("drop"))
    drop = drop.withColumnsRenamed({"id": "drop_id", "th": "drop_th"})
    keyed = whole_rows(docs, id=docs[id_col], th=F.xxhash64(docs[text_col]))
    joined = keyed.join(drop, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("th") == F.col("drop_th")), "left")
    text = F.col("row").getField(text_col)
    lines = F.split(text, "\n", -1)
    kept = F.when(F.col("drop").isNull(), text).otherwise(F.array_join(_without(lines, F.col("drop")), "\n"))
    counts = [F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size("drop"), F.lit(0))]
    names = [free_name(docs, n) for n in ("n_lines", "n_removed")]
    return joined.select(*fields(docs, **{text_col: kept}), *[c.cast("long").alias(n) for c, n in zip(counts, names, strict=True)])


#: The result of ``op7`` as DuckDB SQL, with exact distinct counts throughout.
DEDUP_SQL = r"""
WITH split AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM {docs}),
lines AS (
  SELECT doc_id, source, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
common AS (
  SELECT line, min(struct_pack(a := doc_id, b := pos)) AS f FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT source) >= 5),
marked AS (
  SELECT l.doc_id, l.pos, l.line, c.line IS NOT NULL AND NOT (c.f.a = l.doc_id AND c.f.b = l.pos) AS gone
  FROM lines l LEFT JOIN common c ON l.line = c.line),
rebuilt AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept, count(*) AS n_lines,
         count(*) FILTER (WHERE gone) AS n_removed FROM marked GROUP BY doc_id)
"""
DOCS_SQL = DEDUP_SQL + "SELECT d.* REPLACE (CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.kept, '') END AS text) FROM {docs} d LEFT JOIN rebuilt r USING (doc_id)"
RESULT_SQL = DEDUP_SQL + "SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM {docs} d LEFT JOIN rebuilt r USING (doc_id)"
