"""Benchmark decontamination by latent semantic retrieval.

Method, for each block of at most about ``BLOCK`` benchmark items:

1. One pass over all documents counts in how many passages each benchmark word occurs (IDF).
2. Distributed randomised SVD of the TF-IDF matrix A of all passages over those words: one pass sums
   A'(A W) for a random W, from which Nystrom's formula gives the leading right singular vectors
   and the singular values.
3. Candidate search: overlapping passages and items are projected, scaled by the inverse singular
   values and compared by cosine; every passage meets every item of the block.  A passage in which an
   item of fewer than SHORT words begins word for word is a candidate whatever its cosine, since so
   few words are lost among a passage's others.
4. Each candidate is checked on whole texts: the longest common subsequence of the item's words and
   the words around the passage must hold LCS_SHARE of the item, and ANSWER_SHARE of its answer, the
   closing quarter of its words.

Words are compared in lower case.  Tasks emit sums in fixed point, so reruns agree.
What is broadcast belongs to one block of items: words and a words x RANK basis.

Defined results: null and empty texts and items match nothing; items of fewer than MIN_WORDS words
are not searched (any text would hold them); repeated documents are reported once per id and item;
a null id is reported as null; ids shared by several texts report their best match; a very long text is
searched whole; other columns are ignored, and pass through ``decontaminated``; with an empty table
nothing is reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .shared import fields, whole_rows

U = np.uint64
#: Items per block, rank of the decomposition, words per step and steps per passage.
BLOCK, RANK, STEP, STEPS = 4096, 64, 16, 2
#: Cosine of a candidate, and the shares of the item and of its answer that confirm it.
COSINE, LCS_SHARE, ANSWER_SHARE = 0.4, 0.6, 0.5
MIN_WORDS, SHORT = 6, 12
#: Fixed-point scale of the sums, and rows of a matrix per message.
SCALE, SLICE = 2.0**16, 256
#: Items compared with a chunk's passages in one product.
ITEMS_AT_ONCE = 256

SUMS = "part int, cells binary"
LEAKS = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"


class Items:
    """A block of benchmark items as word numbers."""

    def __init__(self, ids: list, texts: list[str | None]):
        (c,) = T.chunks(pc.utf8_lower(pa.array([t or "" for t in texts], pa.string())), 1 << 62) if texts else (None,)
        self.ids, self.words = [], []
        if c is None:
            self.vocabulary = np.zeros(0, U)
            self._index()
            return
        hashed = c.word_hashes()
        long = [i for i in range(c.n) if c.counts[i] >= MIN_WORDS]
        self.vocabulary = np.unique(np.concatenate([hashed[c.first[i] : c.first[i + 1]] for i in long])) if long else np.zeros(0, U)
        for i in long:
            self.ids.append(ids[i])
            self.words.append(np.searchsorted(self.vocabulary, hashed[c.first[i] : c.first[i + 1]]))
        self._index()

    def _index(self) -> None:
        """For each leading 16 bits of a hash, where its words start in the sorted vocabulary."""
        self.bucket = np.searchsorted(self.vocabulary >> U(48), np.arange((1 << 16) + 1, dtype=U))

    def verbatim(self, c: T.Chunk, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of a chunk at which a short item begins word for word, and the items."""
        words, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            if len(w) < SHORT:
                by_size.setdefault(len(w), []).append(i)
        for size, own in by_size.items():
            key = np.concatenate([T.gram_hashes(self.words[i].astype(U), size) for i in own])
            order = np.argsort(key, kind="stable")
            key, own = key[order], np.array(own)[order]
            known = np.append(0, np.cumsum(feature >= 0))
            n = max(0, len(feature) - size + 1)
            at = np.flatnonzero((known[size:] - known[:n] == size) & (c.doc[:n] == c.doc[size - 1 :])) if n else np.zeros(0, np.int64)
            found = T.gram_hashes(np.maximum(feature, 0).astype(U), size)[at]
            lo, hi = np.searchsorted(key, found), np.searchsorted(key, found, side="right")
            count = hi - lo
            words.append(np.repeat(at, count))
            items.append(own[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())])
        return np.concatenate(words), np.concatenate(items)

    def features(self, hashed: np.ndarray) -> np.ndarray:
        """The number of each word in the vocabulary, or -1."""
        out = np.full(len(hashed), -1)
        top = (hashed >> U(48)).astype(np.int64)
        at, stop = self.bucket[top], self.bucket[top + 1]
        open_at = np.flatnonzero(at < stop)
        while len(open_at):
            here = at[open_at]
            hit = self.vocabulary[here] == hashed[open_at]
            out[open_at[hit]] = here[hit]
            at[open_at] += 1
            rest = ~hit & (here + 1 < stop[open_at])
            open_at = open_at[rest]
        return out


class Passages:
    """The steps (runs of STEP words of one document) of a chunk and the known words in them."""

    def __init__(self, c: T.Chunk, items: Items):
        self.feature = items.features(c.word_hashes())
        per_doc = -(-c.counts // STEP)
        self.first = np.append(0, np.cumsum(per_doc))
        self.n = int(self.first[-1])
        self.doc = np.repeat(np.arange(c.n), per_doc)
        within = np.arange(len(c.doc)) - c.first[:-1][c.doc]
        self.known = np.flatnonzero(self.feature >= 0)
        self.step = (self.first[:-1][c.doc] + within // STEP)[self.known]
        self.word = self.feature[self.known]
        #: Passages that do not overlap: every STEPS-th step of a document opens one.
        self.passage = np.cumsum((np.arange(self.n) - self.first[:-1][self.doc]) % STEPS == 0) - 1 if self.n else np.zeros(0, np.int64)

    def by_passage(self, rows: np.ndarray) -> np.ndarray:
        return _sum_by(self.passage[self.step], rows[self.word], int(self.passage[-1]) + 1 if self.n else 0)

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """Sums of rows over STEPS steps from each step on, within the document."""
        steps = _sum_by(self.step, rows[self.word], self.n)
        out = steps.copy()
        for d in range(1, STEPS):
            same = self.doc[d:] == self.doc[:-d]
            out[:-d][same] += steps[d:][same]
        return out


def _sum_by(group: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by ascending group numbers below n."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(group):
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        out[group[head]] = np.add.reduceat(rows, head, axis=0)
    return out


def _emit(matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts = [matrix[i : i + SLICE].tobytes() for i in range(0, len(matrix), SLICE)]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["part", "cells"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got = np.frombuffer(cells, np.int64)
            total[part] = total[part] + got if part in total else got
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["part", "cells"])


def _summed(texts: DataFrame, work, shape: tuple[int, int]) -> np.ndarray:
    """The sum of the tasks' matrices; its shape belongs to a block of items, not to the corpus."""
    parts = -(-shape[0] // SLICE)
    out = np.zeros(shape, np.int64)
    for row in texts.mapInArrow(work, SUMS).repartition(parts, "part").mapInArrow(_add, SUMS).collect():
        got = np.frombuffer(row.cells, np.int64).reshape(-1, shape[1])
        out[row.part * SLICE : row.part * SLICE + len(got)] = got
    return out


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[T.Chunk]:
    for batch in batches:
        yield from T.chunks(pc.utf8_lower(batch.column(column)))


def _occurrences(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        n = len(items.vocabulary)
        found = np.zeros((n + 1, 1), np.int64)
        for c in _chunks(batches, 0):
            p = Passages(c, items)
            pair = np.unique(p.passage[p.step] * n + p.word) if p.n else np.zeros(0, np.int64)
            found[:n, 0] += np.bincount(pair % n, minlength=n)
            found[n, 0] += int(p.passage[-1]) + 1 if p.n else 0
        yield from _emit(found)

    return work


def _range_finder(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, idf, rows = shared.value
        total = np.zeros((len(idf), rows.shape[1]))
        for c in _chunks(batches, 0):
            p = Passages(c, items)
            y = p.by_passage(rows)
            order = np.argsort(p.word, kind="stable")
            total += _sum_by(p.word[order], y[p.passage[p.step]][order], len(idf)) * idf[:, None]
        yield from _emit(np.rint(total * SCALE).astype(np.int64))

    return work


def decomposed(texts: DataFrame, items: Items, rank: int = RANK) -> np.ndarray:
    """Row w: what word w adds to a passage's place in the scaled latent space."""
    sc = texts.sparkSession.sparkContext
    n = len(items.vocabulary)
    rank = min(rank, n)
    counts = _summed(texts, _occurrences(sc.broadcast(items)), (n + 1, 1))[:, 0].astype(np.float64)
    idf = np.log((1 + counts[n]) / (1 + counts[:n])) + 1
    start = np.random.default_rng(7).standard_normal((n, rank))
    first = (idf[:, None] * start).astype(np.float32)
    z = _summed(texts, _range_finder(sc.broadcast((items, idf, first))), (n, rank)) / SCALE
    vector, value = nystrom(z, start)
    # directions without weight in the corpus still tell items apart; they count as the weakest
    floor = max(value.max(initial=0.0) * 1e-6, 1.0)
    return (idf[:, None] * vector / np.sqrt(np.maximum(value, floor))).astype(np.float32)


def nystrom(z: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvectors and eigenvalues of G = A'A from z = G start, in one pass over A.

    G is about z (start'z)^-1 z'; a small shift keeps the middle factor's Cholesky stable.
    """
    shift = np.finfo(np.float64).eps * 1e4 * max(np.linalg.norm(z), 1.0)
    moved = z + shift * start
    middle = start.T @ moved
    values, vectors = np.linalg.eigh((middle + middle.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, shift * 1e-3))
    u, s, _ = np.linalg.svd(moved @ root, full_matrices=False)
    return u, np.maximum(s**2 - shift, 0.0)


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def lcs_length(masks: dict[int, int], m: int, words: list[int]) -> int:
    """Length of the longest common subsequence with m words whose places are set in ``masks``."""
    full = (1 << m) - 1
    v = full
    for w in words:
        if (at := masks.get(w)) is not None:
            u = v & at
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def _places(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def _search(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, rows, latent = shared.value
        words = [w.tolist() for w in items.words]
        answers = [w[-max(3, len(w) // 4) :] for w in words]
        masks, ends = list(map(_places, words)), list(map(_places, answers))
        distinct, longest = list(map(frozenset, words)), max(map(len, words))
        for batch in batches:
            ids = batch.column(0)
            for c in T.chunks(pc.utf8_lower(batch.column(1))):
                p = Passages(c, items)
                if not len(p.known):
                    continue
                places = _unit(p.windows(rows))
                hits = []
                for at in range(0, len(latent), ITEMS_AT_ONCE):
                    near = places @ latent[at : at + ITEMS_AT_ONCE].T
                    step, item = np.nonzero(near >= COSINE)
                    hits.append((step, item + at, near[step, item]))
                at, item = items.verbatim(c, p.feature)
                step = p.first[c.doc[at]] + (at - c.first[c.doc[at]]) // STEP
                hits.append((step, item, (places[step] * latent[item]).sum(axis=1)))
                step, item, value = (np.concatenate(x) for x in zip(*hits, strict=True))
                if not len(step):
                    continue
                order = np.lexsort((item, step))
                step, item, value = step[order], item[order], value[order]
                doc = p.doc[step]
                found: dict[tuple[int, int], tuple[float, float, float]] = {}
                last, nearby = -1, set()
                for s, i, d, v in zip(step.tolist(), item.tolist(), doc.tolist(), value.tolist(), strict=True):
                    at = c.first[d] + (s - p.first[d]) * STEP
                    if s != last:
                        last, nearby = s, set(p.feature[max(c.first[d], at - longest) : min(c.first[d + 1], at + STEP * STEPS + longest)].tolist())
                    m = len(words[i])
                    # words that aren't there at all bound the subsequence
                    if len(distinct[i] & nearby) + m - len(distinct[i]) < LCS_SHARE * m:
                        continue
                    lo, hi = max(c.first[d], at - m), min(c.first[d + 1], at + STEP * STEPS + m)
                    around = p.feature[lo:hi].tolist()
                    share = lcs_length(masks[i], m, around) / m
                    if share < LCS_SHARE:
                        continue
                    answer = lcs_length(ends[i], len(answers[i]), around) / len(answers[i])
                    if answer >= ANSWER_SHARE:
                        found[d, i] = max(found.get((d, i), (0.0, 0.0, 0.0)), (share, answer, v))
                if found:
                    at = pa.array([c.lo + d for d, _ in found])
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(at), pa.array([items.ids[i] for _, i in found], pa.int64())] + [pa.array([x[k] for x in found.values()], pa.float64()) for k in (2, 0, 1)],
                        names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share"],
                    )

    return work


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it."""
    sc = docs.sparkSession.sparkContext
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    queries = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    blocks = -(-queries.count() // BLOCK)
    out = []
    for k in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        items = Items([r.item_id for r in rows], [r.text for r in rows])
        if not items.ids:
            continue
        vectors = decomposed(base.select("text"), items)
        latent = _unit(np.stack([vectors[w].sum(axis=0) for w in items.words]))
        out.append(base.mapInArrow(_search(sc.broadcast((items, vectors, latent))), LEAKS))
    if not out:
        return docs.sparkSession.createDataFrame([], LEAKS)
    found = reduce(DataFrame.unionByName, out)
    best = F.max(F.struct("lcs_share", "answer_share", "cosine")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.cosine", "best.lcs_share", "best.answer_share")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns pass through.

    The text decides, so documents are known by a hash of it; ids may be null or shared.
    """
    keyed = whole_rows(docs, key=F.xxhash64(docs[text_col]), text=docs[text_col].cast("string"))
    found = leaks(keyed, benchmark, "key", "text").select(F.col("doc_id").alias("leak")).distinct()
    return keyed.join(found, F.col("key") == F.col("leak"), "left_anti").select(*fields(docs))
