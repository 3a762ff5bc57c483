"""Source divergence audit: how far the sources of a language differ in their words.

Method: term-block dense matrices.  Map tasks count terms by (language, source) and send one row per
term and flush; Spark adds them up.  The kept terms of a language are dealt by hash over blocks of
about ``TILE_TERMS``; a block is a dense numpy int64 matrix of every group of the language by the
block's terms.  The distances of all pairs of groups come from broadcasting the tile against itself,
in squares of bounded size, and give a partial pair matrix per block, which Spark sums; each group's
largest excesses of a block are a heap of at most ``depth`` terms, which a ranking merges.

All arithmetic is exact: int64, with 10**9 * (count + 5) divided in steps of a thousand, so that only
a group of over 9 * 10**15 terms would overflow.

Memory: a map task holds ``FLUSH`` distinct terms (or one text's); a tile holds groups x TILE_TERMS
numbers, so a language with very many groups takes narrower blocks (``TILE_CELLS``).  The pairs are
what is asked for: their number is the square of a language's groups, not of documents.

Defined results: null text, lang and source count as ''; a group without terms takes part with count
0 everywhere; a language without kept terms has pairs of value 0 and no terms; a language with one
group has no pairs; repeated rows count again, each as a document of its own; very long texts count
whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .terms import LETTERS, terms

#: Documents of a language that a kept term occurs in, added count, scale, and ranks of terms reported.
MIN_DF, SMOOTH, SCALE, DEPTH = 30, 5, 10**9, 50
#: Distinct (group, term) cells that a map task holds; terms and cells of a tile; cells of a pair square.
FLUSH, TILE_TERMS, TILE_CELLS, SQUARE = 300_000, 512, 4_000_000, 1_000_000
#: Places where a language's terms meet its number of blocks.
SALTS = 256
COUNTED = "lang string, source string, term binary, n long, df long"
FOUND = "lang string, source string, part string, item string, value long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group; a null term stands for the group itself."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> pa.RecordBatch:
        rows = [(lang, source, None, 0, 0) for lang, source in held]
        rows += [(lang, source, term, k, df[term]) for (lang, source), (n, df) in held.items() for term, k in n.items()]
        held.clear()
        kinds = pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()
        columns = zip(*rows, strict=True) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "source", "term", "n", "df"])

    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            n, df = held.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for piece in terms(text.as_py(), LETTERS):
                n.update(piece)
                seen.update(piece)
            df.update(seen)
            size += len(n) - before
            if size > FLUSH:
                yield flush()
                size = 0
    if held:
        yield flush()


def scaled_share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total), exactly, for count <= total."""
    out, rest = np.divmod(count, total)
    for _ in range(3):  # SCALE is 1000 ** 3
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block of one language: partial distances of its pairs of groups, and each group's largest excesses."""
    table = pa.Table.from_batches(list(batches))
    lang = table.column("lang")[0].as_py()
    item = table.column("term").to_pylist()
    heads = [i for i, t in enumerate(item) if t is None]
    cells = [i for i, t in enumerate(item) if t is not None]
    source, total, kept, n = (table.column(c).to_pylist() for c in ("source", "total", "kept", "n"))
    heads.sort(key=lambda i: source[i].encode())
    groups, size = [source[i] for i in heads], np.array([total[i] for i in heads], np.int64)
    place = {s: i for i, s in enumerate(groups)}
    words = sorted({item[i] for i in cells})
    at = {w: i for i, w in enumerate(words)}
    counts = np.zeros((len(groups), len(words)), np.int64)
    counts[[place[source[i]] for i in cells], [at[item[i]] for i in cells]] = [n[i] for i in cells]
    v = kept[heads[0]]
    p = scaled_share(counts + SMOOTH, size[:, None] + SMOOTH * v) if words else counts
    q = scaled_share(counts.sum(0) + SMOOTH, np.array([size.sum() + SMOOTH * v])) if words else np.zeros(0, np.int64)

    side = max(1, int((SQUARE // max(1, len(words))) ** 0.5))
    for lo in range(0, len(groups), side):
        for to in range(lo, len(groups), side):
            part = np.abs(p[lo : lo + side, None, :] - p[None, to : to + side, :]).sum(2)
            a, b = np.indices(part.shape).reshape(2, -1)
            a, b, value = a + lo, b + to, part.ravel()
            once = a < b
            if once.any():
                yield _rows(lang, [groups[i] for i in a[once]], "pair", [groups[i] for i in b[once]], value[once])
    for g, name in enumerate(groups):
        more = np.flatnonzero((counts[g] > 0) & (p[g] > q))
        top = more[np.argsort(q[more] - p[g][more], kind="stable")[:DEPTH]]  # terms lie in ascending order
        if len(top):
            yield _rows(lang, [name] * len(top), "term", [words[i].decode("utf-8", "replace") for i in top], (p[g] - q)[top])


def _rows(lang: str, source: list[str], part: str, item: list[str], value: np.ndarray) -> pa.RecordBatch:
    k = len(source)
    return pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array(source, pa.string()), pa.array([part] * k, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])


def _blocks(kept: Column, groups: Column) -> Column:
    """Blocks of a language, by its kept terms and the cells that a tile may have."""
    width = F.greatest(F.lit(1), F.least(F.lit(TILE_TERMS), F.floor(F.lit(TILE_CELLS) / groups))).cast("long")
    return (F.lit(1) + F.floor(kept / width)).cast("long")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_df: int = MIN_DF) -> DataFrame:
    """Rows lang, source, part ('pair' or 'term'), item, value, rank."""
    read = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))], F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("text"))
    counted = written(read.mapInArrow(_count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "term-counts")
    terms_kept = counted.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("df").alias("df")).where(F.col("df") >= min_df).select("lang", "term")
    kept = written(counted.join(terms_kept, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), "term-kept")
    groups = counted.where("term IS NULL").select("lang", "source")
    sizes = kept.groupBy("lang", "term").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("one").alias("kept"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")).join(sizes, "lang", "left").fillna(0, ["kept"])
    langs = langs.select("lang", "kept", _blocks(F.col("kept"), F.col("groups")).alias("blocks"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    heads = groups.join(totals, ["lang", "source"], "left").join(langs, "lang")
    heads = heads.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("binary").alias("term"), F.lit(0).cast("long").alias("n"), F.coalesce("total", F.lit(0)).alias("total"), "kept")
    none = F.lit(None).cast("long")
    # a language may hold a third of all terms, so it meets its number of blocks in SALTS places
    salted = langs.select("lang", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    cells = kept.withColumn("salt", F.pmod(F.xxhash64("source", "term"), F.lit(SALTS))).join(salted, ["lang", "salt"])
    cells = cells.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", "n", none.alias("total"), none.alias("kept"))
    found = written(heads.unionByName(cells).groupBy("lang", "block").applyInArrow(_tile, FOUND), "term-tiles")

    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.array(*[F.struct(F.col(a).alias("source"), F.col(b).alias("item")) for a, b in (("source", "item"), ("item", "source"))])
    pairs = sums.select("lang", F.explode(ways).alias("way"), "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    rank = F.row_number().over(order)
    best = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= DEPTH)
    return pairs.withColumn("rank", rank).unionByName(best)


#: The audit as DuckDB SQL; ``{docs}`` is the table.
AUDIT_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM {docs}),
said AS (SELECT row_id, lang, source, unnest(words) AS term FROM base),
kept AS (SELECT lang, term FROM said GROUP BY lang, term HAVING count(DISTINCT row_id) >= 30),
groups AS (SELECT DISTINCT lang, source FROM base),
sizes AS (SELECT l.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM base) l LEFT JOIN kept k ON k.lang = l.lang GROUP BY l.lang),
counts AS (SELECT s.lang, s.source, s.term, count(*) AS n FROM said s JOIN kept k ON k.lang = s.lang AND k.term = s.term GROUP BY ALL),
totals AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM groups g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
lang_counts AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL),
lang_totals AS (SELECT lang, sum(total) AS total FROM totals GROUP BY lang),
p AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.total + 5 * z.v) AS p
  FROM totals t JOIN kept k ON k.lang = t.lang JOIN sizes z ON z.lang = t.lang
  LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
q AS (
  SELECT c.lang, c.term, 1 + (1000000000::HUGEINT * (c.n + 5)) // (t.total + 5 * z.v) AS q
  FROM lang_counts c JOIN lang_totals t ON t.lang = c.lang JOIN sizes z ON z.lang = c.lang),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
excess AS (SELECT p.lang, p.source, p.term AS item, p.p - q.q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pairs
  UNION ALL
  SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM excess) WHERE rank <= 50)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked
"""
