"""Stupid-backoff scores of whole texts, summed from n-gram counts partitioned by hash.

Method: a chunk of texts counts its distinct n-grams of 1 to ``order`` words and sends each once, with
its count, to the partition that its hash names.  There the chunks' counts meet, are added up, and the
totals go back to each chunk in the order in which it sent the n-grams, so a frequent n-gram costs a row
entry per chunk, not per document or occurrence.  The chunk's texts meet the totals, every word takes
the longest n-gram that has a count, and the logarithms are summed per document.

A word scores c(n-gram) / c(context) for the longest n-gram that ends with it and has a count, times
ALPHA for each order that is passed over; with no count at all it scores ALPHA**order / N.  Words near
a text's start have shorter contexts and back off.

With ``held_out`` a text's own occurrences are left out of every count and N is the number of words of the
other texts, 1 at least: so texts are scored by what the others hold, and backoff decides words.
Without it a text is scored under all counts, and N is the number of all words.

An n-gram's key is 44 bits of its hash and the number of its partition; unlike n-grams share a key
once in many millions.

Defined results: words are runs other than 0x20 and 0x09-0x0D, A-Z in lower case; null and empty
texts have 0 words and score 0 with a null mean; rows that share an id are scored each for itself, as
texts of their own, and added; null ids are one id; repeated rows are other texts to each other; a very
long text is a chunk of its own and is scored whole; other columns are ignored; an empty table gives an
empty one.  ``docs`` is read twice and must give its rows alike both times, as files and checkpoints do.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .shared import checkpointed, shuffle_partitions

U = np.uint64
ALPHA = 0.4
ORDER = 3
#: Bits of a hash that travel beside the number of its partition.
BITS = 44
LOW = (1 << BITS) - 1
GRAMS = "bucket int, chunk long, kind int, packed binary"
ROWS = "doc_id long, score double, n_words long, backed_off long"
#: Bytes of text whose n-grams travel together.
TOGETHER = 4_000_000
#: Kind of the rows that carry a chunk's texts; they sort behind its totals, whose kind is the order.
TEXTS = 99
#: Parts of a partition's keys that are counted one after another.
SLICES = 8


def _totals(key: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The joined count table in slices of the key space: places of entries and their keys' occurrences."""
    part = (key % U(SLICES)).astype(np.uint8)
    for s in range(SLICES):
        at = np.flatnonzero(part == s)
        _, inverse = np.unique(key[at], return_inverse=True)
        yield at, np.bincount(inverse, weights=count[at])[inverse]


def _grams(c: T.Chunk, order: int, buckets: int):
    """For k from 1 to order: first words of the chunk's k-grams, which lie in one text, and their bucketed hashes."""
    words = c.word_hashes(lower=True)
    for k in range(1, order + 1):
        h = words if k == 1 else T.gram_hashes(words, k)
        at = np.flatnonzero(c.doc[: len(h)] == c.doc[k - 1 :])
        h = h[at]
        yield k, at, (h & U(LOW)) | (((h >> U(BITS)) % U(buckets)) << U(BITS))


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _expanded(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers byte by byte, all lowest bytes first; high bytes are alike and shrink."""
    return np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1)


def _chunk_key(ids: pa.Array, c: T.Chunk) -> int:
    own = hashlib.blake2b(c.data.tobytes(), digest_size=8)
    own.update(c.bounds.tobytes())
    own.update(repr(ids.to_pylist()).encode())
    return int.from_bytes(own.digest(), "little", signed=True)


def _rows_of(rows: list[tuple]) -> pa.RecordBatch:
    bucket, chunk, kind, packed = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(chunk, pa.int64()), pa.array(kind, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "chunk", "kind", "packed"])


def _send_grams(order: int, buckets: int):
    """A chunk's distinct n-grams with their counts, one row per order and bucket."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in T.chunks(batch.column(1), TOGETHER):
                key, rows = _chunk_key(batch.column(0).slice(c.lo, c.n), c), []
                for k, _, grams in _grams(c, order, buckets):
                    own, count = np.unique(grams, return_counts=True)
                    cut = np.searchsorted(own, np.arange(buckets + 1, dtype=U) << U(BITS))
                    low = (own & U(LOW)).astype(np.int64)
                    for b in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                        lo, hi = cut[b], cut[b + 1]
                        gaps = np.diff(low[lo:hi], prepend=0)
                        rows.append(((k - 1) * buckets + b, key, k, _squeezed(_planes(gaps) + _planes(count[lo:hi]))))
                if rows:
                    yield _rows_of(rows)

    return send


def _send_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in T.chunks(batch.column(1), TOGETHER):
            ids = batch.column(0).slice(c.lo, c.n)
            packed = _squeezed(pickle.dumps((ids.to_pylist(), c.data.tobytes(), c.bounds.tobytes())))
            yield _rows_of([(0, _chunk_key(ids, c), TEXTS, packed)])


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers each row with its n-grams' occurrences in all chunks, in the row's order."""
    gathered: dict[int, list[tuple]] = {}
    for batch in batches:
        for bucket, chunk, kind, packed in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            gathered.setdefault(bucket, []).append((chunk, kind, packed))
    for bucket in sorted(gathered):
        rows, gathered[bucket] = gathered[bucket], []
        # equal chunks have equal keys; each of them counts
        size = [int.from_bytes(p[:8], "little") // 16 for _, _, p in rows]
        key, count = np.zeros(sum(size), np.int64), np.zeros(sum(size), np.int64)
        at = 0
        for (_, _, p), n in zip(rows, size, strict=True):
            raw = _expanded(p)
            key[at : at + n], count[at : at + n] = np.cumsum(_numbers(raw[: 8 * n])), _numbers(raw[8 * n :])
            at += n
        total = np.zeros(len(key), np.int64)
        for place, found in _totals(key.view(U), count):
            total[place] = found
        at = 0
        for (chunk, kind, _), n in zip(rows, size, strict=True):
            yield _rows_of([(bucket, chunk, kind, _squeezed(_planes(total[at : at + n])))])
            at += n


def _counts(c: T.Chunk, order: int, buckets: int, totals: dict[int, dict[int, bytes]], held_out: bool):
    """For k from 1 to order: first words of the k-grams, and their occurrences that count."""
    for k, at, grams in _grams(c, order, buckets):
        own, place = np.unique(grams, return_inverse=True)
        found = totals.get(k, {})
        total = np.concatenate([np.zeros(0, np.int64), *(_numbers(_expanded(found[b])) for b in sorted(found))])
        if len(total) != len(own):
            raise RuntimeError("the texts came in other chunks when they were read again")
        if not held_out:
            yield at, total[place]
            continue
        _, here, n = np.unique(c.doc[at] * max(len(own), 1) + place, return_inverse=True, return_counts=True)
        yield at, total[place] - n[here]


def _backed_off(c: T.Chunk, order: int, buckets: int, totals: dict[int, dict[int, bytes]], held_out: bool) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms by word, without the division by N where ``open`` tells that a word backs off to it."""
    n = len(c.doc)
    value, open_ = np.zeros(n), np.ones(n, bool)
    counts = np.zeros((order, n), np.int64)
    for k, (at, found) in enumerate(_counts(c, order, buckets, totals, held_out)):
        counts[k, at] = found
    for k in range(order, 1, -1):
        at = np.flatnonzero(counts[k - 1, : max(0, n - k + 1)] > 0)
        at = at[open_[at + k - 1]]
        value[at + k - 1] = np.log(counts[k - 1, at] / counts[k - 2, at]) + (order - k) * math.log(ALPHA)
        open_[at + k - 1] = False
    rest = counts[0, open_]
    value[open_] = np.log(np.maximum(rest, 1)) + np.where(rest > 0, order - 1, order) * math.log(ALPHA)
    return value, open_


def _score_chunks(order: int, buckets: int, held_out: bool):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, totals = None, {}
        for batch in batches:
            for bucket, chunk, kind, packed in zip(*batch.columns, strict=True):
                if chunk.as_py() != key:
                    key, totals = chunk.as_py(), {}
                k = kind.as_py()
                if k != TEXTS:
                    totals.setdefault(k, {})[bucket.as_py()] = packed.as_py()
                    continue
                ids, data, bounds = pickle.loads(_expanded(packed.as_py()))
                c = T.Chunk(np.frombuffer(data, np.uint8), np.frombuffer(bounds, np.int64), 0)
                value, open_ = _backed_off(c, order, buckets, totals, held_out)
                sums = [np.bincount(c.doc, weights=x, minlength=c.n) for x in (value, open_)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums[0]), pa.array(c.counts.astype(np.int64)), pa.array(sums[1].astype(np.int64))], names=["doc_id", "score", "n_words", "backed_off"])

    return score


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, held_out: bool = True) -> DataFrame:
    """One row per document id: doc_id, n_words, log_score, mean_log_score."""
    parts = shuffle_partitions(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    sent = base.mapInArrow(_send_grams(order, parts), GRAMS)
    totals = sent.repartition(parts * order, "bucket").mapInArrow(_total, GRAMS)
    met = totals.unionByName(base.mapInArrow(_send_texts, GRAMS)).repartition(parts, "chunk").sortWithinPartitions("chunk", "kind", "bucket")
    rows = checkpointed(met.mapInArrow(_score_chunks(order, parts, held_out), ROWS))
    total = rows.agg(F.sum("n_words")).first()[0] or 0
    n = F.greatest(F.lit(total) - (F.col("n_words") if held_out else F.lit(0)), F.lit(1)).cast("double")
    # decimals add up alike in any order
    rows = rows.withColumn("score", (F.col("score") - F.col("backed_off") * F.log(n)).cast("decimal(28,12)"))
    sums = rows.groupBy("doc_id").agg(F.sum("score").cast("double").alias("score"), F.sum("n_words").alias("n_words"))
    return sums.select("doc_id", "n_words", F.col("score").alias("log_score"), F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")).alias("mean_log_score"))


_WORDS_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM {docs})),
n AS (SELECT count(*) AS n FROM w),"""
_ROUNDED_SQL = """
SELECT d.doc_id, coalesce(s.n_words, 0) AS n_words, floor(coalesce(s.score, 0) * 10000 + 0.5) / 10000 AS log_score,
  floor(s.score / s.n_words * 1000000 + 0.5) / 1000000 AS mean_log_score
FROM {docs} d LEFT JOIN s USING (doc_id)
"""
#: Scores of each text under the other texts' counts of up to three words, as DuckDB SQL.
HELD_OUT_SQL = _WORDS_SQL + """
p AS (SELECT *, lag(word) OVER t AS b, lag(word, 2) OVER t AS a, count(*) OVER (PARTITION BY doc_id) AS own FROM w WINDOW t AS (PARTITION BY doc_id ORDER BY i)),
o AS (
  SELECT doc_id, own, a, b, count(*) OVER (PARTITION BY word) - count(*) OVER (PARTITION BY doc_id, word) AS c1,
    CASE WHEN b IS NOT NULL THEN count(*) OVER (PARTITION BY b, word) - count(*) OVER (PARTITION BY doc_id, b, word) ELSE 0 END AS c2,
    CASE WHEN a IS NOT NULL THEN count(*) OVER (PARTITION BY a, b, word) - count(*) OVER (PARTITION BY doc_id, a, b, word) ELSE 0 END AS c3, i FROM p),
k AS (SELECT *, lag(c1) OVER t AS b1, lag(c2) OVER t AS b2 FROM o WINDOW t AS (PARTITION BY doc_id ORDER BY i)),
s AS (
  SELECT doc_id, count(*) AS n_words, sum(CASE WHEN c3 > 0 THEN ln(CAST(c3 AS DOUBLE) / b2) WHEN c2 > 0 THEN ln(CAST(c2 AS DOUBLE) / b1) + ln(CAST(0.4 AS DOUBLE))
    ELSE ln(CAST(greatest(c1, 1) AS DOUBLE)) + (CASE WHEN c1 > 0 THEN 2 ELSE 3 END) * ln(CAST(0.4 AS DOUBLE)) - ln(CAST(greatest(n.n - own, 1) AS DOUBLE)) END) AS score
  FROM k, n GROUP BY doc_id)""" + _ROUNDED_SQL
#: Scores with bigrams under all counts, as DuckDB SQL.
WHOLE_SQL = _WORDS_SQL + """
p AS (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM w),
u AS (SELECT word, count(*) AS c FROM w GROUP BY word),
b AS (SELECT prev, word, count(*) AS c FROM p WHERE prev IS NOT NULL GROUP BY prev, word),
s AS (
  SELECT p.doc_id, count(*) AS n_words,
    sum(CASE WHEN p.prev IS NULL THEN ln(0.4 * uw.c / n.n) ELSE ln(CAST(b.c AS DOUBLE) / up.c) END) AS score
  FROM p CROSS JOIN n JOIN u uw ON uw.word = p.word LEFT JOIN u up ON up.word = p.prev
    LEFT JOIN b ON b.prev = p.prev AND b.word = p.word GROUP BY p.doc_id)""" + _ROUNDED_SQL
