"""Ranked lexical search: an inverted index by shards, searched score at a time.

Method: ``index`` writes one row per shard of documents, with the postings of each of its terms.  For
a block of queries, ``search`` reads the terms' document counts off the shards, then lets each task
order the postings of a shard by impact, grouped by exact impact, and work through them from the
highest impact down, adding to the documents' sums.  A query stops in a shard only when what the
postings still unread can add proves that no document outside the candidates reaches the best k; the
candidates' scores are then completed.  A task carries a query's best k from shard to shard, so later
shards stop earlier, and a ranking merges the tasks' best.

Sizes: a shard has at most ``SHARD_POSTINGS`` postings (or one document's) and 65,535 documents.
Queries go to the shards by broadcasts of blocks of at most about ``BLOCK_BYTES`` of terms (or one
query's); more queries make more blocks, each a pass over the index, not over the texts.  The driver
holds one block and one number per term of it.

Defined results: a null or empty text has no terms, counts in no number and is never found; a query
without terms, or whose terms no document holds, finds nothing; every row is a document or a query of
its own, so repeated rows are ranked side by side; among equal scores a null id comes last; very long
texts count whole; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .terms import ALPHANUMERIC, LOWER, UPPER, terms

TOP = 50
#: Postings and documents of a shard; terms held back before they are counted; bytes of terms in a block of queries.
SHARD_POSTINGS, SHARD_DOCS, HELD, BLOCK_BYTES = 2_000_000, 65_535, 1_000_000, 16_000_000
#: A round reads the groups whose impact is at least this share of the highest unread one.
ROUND = 0.6
SHARDS = "terms binary, starts array<int>, docs binary, tfs binary, ids array<long>, sizes array<long>, n_docs long, n_terms long"


class _Shard:
    """Postings of the documents added since the last ``row``."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.raw: list[np.ndarray] = []
        self.n_raw = self.postings = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        doc, size = len(self.ids), 0
        for piece in terms(text, ALPHANUMERIC):
            size += len(piece)
            self.raw.append((np.fromiter(map(self.number.__getitem__, piece), np.int64, len(piece)) << 16) | doc)
            self.n_raw += len(piece)
            if self.n_raw >= HELD:
                self.count()
        self.ids.append(doc_id)
        self.sizes.append(size)

    def count(self) -> None:
        """Turns the terms held back into postings; a document may have some of a term here and more later."""
        if self.n_raw:
            keys, counts = np.unique(np.concatenate(self.raw), return_counts=True)
            self.keys.append(keys)
            self.counts.append(counts)
            self.postings += len(keys)
        self.raw, self.n_raw = [], 0

    @property
    def full(self) -> bool:
        return self.postings + self.n_raw // 2 >= SHARD_POSTINGS or len(self.ids) >= SHARD_DOCS

    def row(self) -> pa.RecordBatch:
        self.count()
        keys = np.concatenate([np.zeros(0, np.int64), *self.keys])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], np.concatenate([np.zeros(0, np.int64), *self.counts])[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        keys, tfs = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        starts = np.searchsorted(keys >> 16, np.arange(len(self.number) + 1)).astype(np.int32)
        narrow = np.min_scalar_type(int(tfs.max())) if len(tfs) else np.uint8
        values = [b" ".join(self.number), starts, (keys & 0xFFFF).astype(np.uint16).tobytes(), tfs.astype(narrow).tobytes(), self.ids, self.sizes, sum(s > 0 for s in self.sizes), sum(self.sizes)]
        kinds = [pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["terms", "starts", "docs", "tfs", "ids", "sizes", "n_docs", "n_terms"])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = _Shard()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            shard.add(doc_id, text.as_py())
            if shard.full:
                yield shard.row()
                shard = _Shard()
    if shard.ids:
        yield shard.row()


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all documents, one row per shard, written to the shared folder."""
    read = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("text"))
    return written(read.mapInArrow(_build, SHARDS), "lexical-index")


def _places(names: bytes, wanted: dict[bytes, int]) -> list[tuple[int, int]]:
    """(number in the block, place in the shard) of the wanted terms that the shard has."""
    return [(wanted[t], i) for i, t in enumerate(names.split(b" ")) if t in wanted] if names else []


def _frequencies(block):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = block.value["terms"]
        df = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for names, starts in zip(batch.column(0), batch.column(1), strict=True):
                got = _places(names.as_py(), wanted)
                size = np.diff(starts.values.to_numpy())
                for t, i in got:
                    df[t] += size[i]
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(df)), pa.array(df[df > 0])], names=["term", "df"])

    return count


class _Postings:
    """A term's postings in a shard: by document, and by impact from the highest."""

    def __init__(self, docs: np.ndarray, impact: np.ndarray):
        some = impact > 0
        self.docs, self.impact = docs[some], impact[some]
        order = np.argsort(-self.impact, kind="stable")
        self.falling, self.by_impact = -self.impact[order], self.docs[order]

    def until(self, least: int) -> int:
        """Place behind the last posting with an impact of at least ``least``."""
        return int(np.searchsorted(self.falling, -least, "right"))


def _accumulate(lists: list[_Postings], n_docs: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, score) of every document of the shard that may be among the best k.

    ``floor``: a score that k documents of earlier shards reach.
    """
    total, at = np.zeros(n_docs, np.int64), [0] * len(lists)
    while True:
        ahead = [-int(p.falling[i]) if i < len(p.falling) else 0 for p, i in zip(lists, at, strict=True)]
        rest = sum(ahead)
        goal = floor
        if n_docs > k:
            goal = max(goal, int(np.partition(total, n_docs - k)[n_docs - k]))
        if rest == 0 or rest < goal:  # an unread document can't reach the goal, a read one only with what is left
            break
        least = max(1, math.floor(max(ahead) * ROUND))
        for j, p in enumerate(lists):
            to = p.until(least)
            if to > at[j]:
                total[p.by_impact[at[j] : to]] += -p.falling[at[j] : to]
                at[j] = to
    docs = np.flatnonzero((total > 0) & (total + rest >= goal))
    if rest:
        scores = np.zeros(len(docs), np.int64)
        for p in lists:
            place = np.searchsorted(p.docs, docs)
            place[place == len(p.docs)] = 0
            found = p.docs[place] == docs
            scores[found] += p.impact[place[found]]
        return docs, scores
    return docs, total[docs]


def _searcher(block, n: int, length: int, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = block.value
        none = np.zeros(0, np.int64)
        best = {q: (none, none, none.astype(bool)) for q in held["queries"]}  # score, id, id is null; best first
        for batch in batches:
            for row in range(batch.num_rows):
                names, starts, docs, tfs, ids, sizes = (batch.column(c)[row] for c in range(6))
                got = _places(names.as_py(), held["terms"])
                starts, sizes = starts.values.to_numpy(), sizes.values.to_numpy()
                docs = np.frombuffer(docs.as_py(), np.uint16)
                raw = tfs.as_py()
                tfs = np.frombuffer(raw, f"u{len(raw) // max(1, len(docs))}") if len(docs) else np.zeros(0, np.uint8)
                ids = ids.values
                unknown = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                norm = 20 * (50 + (50 * sizes * n) // max(1, length))
                lists = {}
                for t, i in got:
                    d, tf = docs[starts[i] : starts[i + 1]], tfs[starts[i] : starts[i + 1]].astype(np.int64)
                    lists[t] = _Postings(d, held["weights"][t] * ((10**9 * tf) // (1000 * tf + norm[d])))
                for q, numbers in held["queries"].items():
                    own = [lists[t] for t in numbers if t in lists]
                    if not own:
                        continue
                    score, doc_id, null = best[q]
                    found, new = _accumulate(own, len(ids), k, int(score[-1]) if len(score) == k else 0)
                    score, doc_id, null = np.append(score, new), np.append(doc_id, ids[found]), np.append(null, unknown[found])
                    top = np.lexsort((doc_id, null, -score))[:k]
                    best[q] = score[top], doc_id[top], null[top]
        for q, (score, doc_id, null) in best.items():
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), q)), pa.array(doc_id, pa.int64(), mask=null), pa.array(score)], names=["q", "doc_id", "score"])

    return search


def query_terms(text: Column) -> Column:
    """The distinct terms of a query."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))


def search(shards: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = TOP) -> DataFrame:
    """Each item's best k documents of an ``index``: item_id, rank, doc_id, score."""
    spark = shards.sparkSession
    n, length = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    asked = written(items.select(F.monotonically_increasing_id().alias("q"), items[id_col].alias("item_id"), query_terms(items[text_col]).alias("terms")).where(F.size("terms") > 0), "lexical-queries")
    weight = F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + F.octet_length(t) + 8)
    blocks = 1 + (asked.agg(F.sum(weight)).first()[0] or 0) // BLOCK_BYTES
    found = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).select("q", "terms").collect()
        number: dict[bytes, int] = {}
        queries = {r.q: [number.setdefault(t.encode(), len(number)) for t in r.terms] for r in rows}
        block = spark.sparkContext.broadcast({"terms": number})
        counts = shards.select("terms", "starts").mapInArrow(_frequencies(block), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        df = dict(map(tuple, counts.collect()))
        weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(number))]
        block = spark.sparkContext.broadcast({"terms": number, "queries": queries, "weights": weights})
        found.append(written(shards.select("terms", "starts", "docs", "tfs", "ids", "sizes").mapInArrow(_searcher(block, n, length, k), "q long, doc_id long, score long"), "lexical-found"))
        block.unpersist()
    whole = spark.read.schema(found[0].schema).parquet(*[f for part in found for f in part.inputFiles()]) if any(part.inputFiles() for part in found) else found[0]
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def searched(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Each item's best k documents: item_id, rank, doc_id, score."""
    return search(index(docs), items, k=k)


#: The search as DuckDB SQL; ``{docs}`` and ``{items}`` are the tables.
SEARCH_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS row_id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM {docs}),
held AS (SELECT row_id, doc_id, len(terms) AS n, terms FROM words WHERE len(terms) > 0),
whole AS (SELECT count(*) AS docs, sum(n) AS length FROM held),
postings AS (SELECT row_id, doc_id, n, term, count(*) AS tf FROM (SELECT row_id, doc_id, n, unnest(terms) AS term FROM held) GROUP BY ALL),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM {items}),
weights AS (
  SELECT p.term, CAST(floor(1000 * ln((2 * w.docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM postings p CROSS JOIN whole w WHERE p.term IN (SELECT term FROM asked) GROUP BY p.term, w.docs),
scored AS (
  SELECT a.item_id, p.row_id, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * p.n * t.docs) // t.length)))) AS BIGINT) AS score
  FROM asked a JOIN weights w ON w.term = a.term JOIN postings p ON p.term = a.term CROSS JOIN whole t GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 50
"""
