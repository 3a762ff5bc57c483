"""Exact top-k search over quantised vectors by MaxScore.

Method: a vector's components are query terms.  The rows of a tile have postings for each dimension
and sign; a row gains from a query's dimension only if it stands in the posting of the query's sign,
and at most the bound that the tile's greatest component there gives.  With the k-th best score so
far, a query's dimensions are split by bound: those whose bounds together don't reach it are
non-essential.  Rows in no essential posting can't compete and are never scored; the others get their
essential sums, and the non-essential dimensions are probed from the largest bound down while a row
stays competitive.  A task keeps each query's best k from tile to tile, so that later tiles start with
high thresholds, and a ranking merges the tasks' best.

Sizes: a tile has at most ``TILE`` rows.  Queries reach the tiles by broadcasts of blocks of about
``BLOCK_BYTES`` at most (or one query), each a pass over the quantised table; nothing is shuffled but the
best k of each task and query.  The work is that of exact search: queries times rows in the worst case.

Scores are sums of integers: computed in doubles where these are exact, in 64 bits or in Python's
integers where not; a component or score beyond 64 bits counts as the nearest 64-bit integer.

Defined results: vectors that are null or hold null or non-finite components take no part, as query
or candidate; of vectors of unlike length, the shared leading components count; an empty vector
scores 0 with all; every row is a query and candidate of its own, so repeated rows find each other;
a null id is no query, and comes last among equal scores; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

TOP, SCALE, EVERY = 5, 256, 50
#: Rows of a tile, rows of it that all queries score to get a threshold, dimensions probed at once, bytes of a block of queries.
TILE, SEED, PROBED, BLOCK_BYTES = 8192, 128, 8, 16_000_000
BEST = "q long, vec_id long, row_id long, score long"
LEAST, MOST = -(2**63), 2**63 - 1


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * component) as integers; null if the vector takes no part."""
    fit = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    return F.when(fit, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class _Best:
    """The best k rows of one query so far, best first."""

    def __init__(self, row_id: int, k: int):
        self.own, self.k = row_id, k
        self.score, self.ids, self.null, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self):
        """The score to reach; None while fewer than k rows are known, or any score would do."""
        return int(self.score[-1]) if len(self.score) == self.k and self.score[-1] > LEAST else None

    def add(self, score: np.ndarray, tile: _Tile, at: np.ndarray) -> None:
        score = (np.clip(score, LEAST, MOST) if score.dtype == object else score).astype(np.int64)
        if self.least is not None:
            fit = score >= self.least
            score, at = score[fit], at[fit]
        other = tile.rows[at] != self.own
        score, at = score[other], at[other]
        if not len(at):
            return
        score = np.append(self.score, score)
        ids, null, rows = np.append(self.ids, tile.ids[at]), np.append(self.null, tile.null[at]), np.append(self.rows, tile.rows[at])
        top = np.lexsort((rows, ids, null, ~score))[: self.k]
        self.score, self.ids, self.null, self.rows = score[top], ids[top], null[top], rows[top]


class _Tile:
    """Rows of one length: components by dimension, postings by dimension and sign."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        self.ids, self.null, self.rows = ids, null, rows
        self.x = np.ascontiguousarray(vectors.T)
        self.high, self.low = vectors.max(0, initial=0), vectors.min(0, initial=0)
        self.most = max(int(self.high.max(initial=0)), -int(self.low.min(initial=0)))
        self.postings = np.packbits(np.concatenate([self.x > 0, self.x < 0]), axis=1)
        self.as_kind: dict[object, np.ndarray] = {}

    def typed(self, most_in_query: int) -> tuple[object, np.ndarray]:
        """The components in the fastest type that holds every score exactly."""
        bound = max(1, self.most) * max(1, most_in_query) * max(1, len(self.x))
        kind = np.dtype(float if bound < 2**52 else np.int64 if bound < 2**62 else object)
        if kind not in self.as_kind:
            self.as_kind[kind] = self.x.astype(kind)
        return kind, self.as_kind[kind]


def _sought(tile: _Tile, query: np.ndarray, best: _Best, first: int) -> None:
    """MaxScore over the tile's rows from ``first`` on."""
    d = min(len(query), len(tile.x))
    query = query[:d]
    kind, x = tile.typed(int(np.abs(query.astype(object)).max(initial=0)))
    q = query.astype(kind)
    goal = best.least
    bound = np.maximum(q * tile.high[:d].astype(kind), q * tile.low[:d].astype(kind))
    order = np.argsort(-bound, kind="stable")
    rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # what the dimensions from here on can add
    essential = d if goal is None else int(np.argmax(rest < goal)) if (rest < goal).any() else d
    if goal is not None and rest[0] < goal:
        return
    some = order[:essential]
    if goal is None or goal <= 0:
        rows = np.arange(first, x.shape[1])
    else:
        held = np.bitwise_or.reduce(tile.postings[np.where(query[some] > 0, some, some + len(tile.x))], axis=0)
        rows = first + np.flatnonzero(np.unpackbits(held, count=x.shape[1])[first:])
    weight = np.zeros(d, kind)
    weight[some] = q[some]
    partial = (weight @ x[:d])[rows] if d else np.zeros(len(rows), kind)
    for i in range(essential, d, PROBED):
        competes = partial + rest[i] >= goal
        rows, partial = rows[competes], partial[competes]
        if not len(rows):
            return
        dims = order[i : i + PROBED]
        partial = partial + q[dims] @ x[np.ix_(dims, rows)]
    best.add(partial, tile, rows)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[_Tile]:
    """Tiles of the rows, by length."""
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        rows, null = batch.column(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
        ids, vectors = batch.column(1).fill_null(0).to_numpy(), batch.column(2)
        flat, sizes = vectors.flatten().to_numpy(), vectors.value_lengths().to_numpy()
        starts = np.cumsum(sizes) - sizes
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            part = flat[starts[at][:, None] + np.arange(d)]
            held.setdefault(int(d), []).append((ids[at], null[at], rows[at], part))
            while sum(len(p[0]) for p in held[d]) >= TILE:
                whole = [np.concatenate(c) for c in zip(*held.pop(d), strict=True)]
                yield _Tile(*[c[:TILE] for c in whole])
                held[d] = [tuple(c[TILE:] for c in whole)]
    for parts in held.values():
        whole = [np.concatenate(c) for c in zip(*parts, strict=True)]
        if len(whole[0]):
            yield _Tile(*whole)


def _searcher(block, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [(np.array(v, np.int64), _Best(row_id, k)) for row_id, v in block.value]
        for tile in _tiles(batches):
            first = min(SEED, len(tile.rows))
            for query, best in queries:
                if best.least is None:
                    d = min(len(query), len(tile.x))
                    kind, x = tile.typed(int(np.abs(query.astype(object)).max(initial=0)))
                    best.add(query[:d].astype(kind) @ x[:d, :first] if d else np.zeros(first), tile, np.arange(first))
                    _sought(tile, query, best, first)
                else:
                    _sought(tile, query, best, 0)
        for _, best in queries:
            n = len(best.rows)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, best.own)), pa.array(best.ids, pa.int64(), mask=best.null), pa.array(best.rows), pa.array(best.score)], names=["q", "vec_id", "row_id", "score"])

    return search


def searched(vectors: DataFrame, is_query: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, scale: int = SCALE) -> DataFrame:
    """Each query row's best k other rows: query_id, rank, vec_id, score.

    ``is_query`` is a condition on ``vectors``; by default, ids divisible by 50.
    """
    spark = vectors.sparkSession
    asks = F.coalesce(vectors[id_col] % EVERY == 0 if is_query is None else is_query, F.lit(False)) & vectors[id_col].isNotNull()
    rows = written(vectors.select(F.monotonically_increasing_id().alias("row_id"), vectors[id_col].cast("long").alias("vec_id"), quantised(vectors[vector_col], scale).alias("v"), asks.alias("asks")).where("v IS NOT NULL"), "vectors")
    asked = rows.where("asks")
    blocks = 1 + (asked.agg(F.sum(8 * F.size("v") + 64)).first()[0] or 0) // BLOCK_BYTES
    found = []
    for b in range(blocks):
        block = spark.sparkContext.broadcast([(r.row_id, r.v) for r in asked.where(F.pmod(F.xxhash64("row_id"), F.lit(blocks)) == b).select("row_id", "v").collect()])
        found.append(written(rows.select("row_id", "vec_id", "v").mapInArrow(_searcher(block, k), BEST), "vectors-found"))
        block.unpersist()
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row_id")
    ranked = whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select(F.col("row_id").alias("q"), F.col("vec_id").alias("query_id")), "q").select("query_id", "rank", "vec_id", "score")


#: The search as DuckDB SQL; ``{vectors}`` is the table.
SEARCH_SQL = r"""
WITH rows_of AS (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM {vectors} WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.row_id, q.vec_id AS query_id, c.row_id AS found, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM rows_of q JOIN rows_of c ON q.row_id <> c.row_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id NULLS LAST, found) AS rank FROM scored)
WHERE rank <= 5
"""
