"""Substring dedup: repeated-phrase automata.

Method, for windows of ``window`` consecutive words:

1. *Confirm recurring passages.*  Every window has an anchor, the rarest-hashed (smallest hash)
   ``GRAM``-word phrase in it, so equal windows have equal anchors.  Windows that share an anchor
   travel as one row keyed by the anchor's hash; one shuffle brings all windows that could be equal
   together, where they are compared by anchor, offset and hash.  Rows that are equal within a
   chunk of a map task are settled there, and one of them is sent on, so a hot passage costs a row
   per chunk, not per copy.
2. *Compile sharded automata.*  The recurring windows of a shard of documents are cut to the tiles
   that cover them, and the tiles are compiled into an Aho-Corasick automaton over word numbers.
3. *Stream all documents* through their shard's automaton; words under any occurrence are removed.

Windows are judged on the input, not on what is left.  Memory: a task holds a chunk, or the distinct
contexts of one anchor.

Defined results: null and empty texts have no words and keep the empty string; texts shorter than
the window lose nothing; repeated rows are copies of each other like any others; rows that share an
id are told apart by a hash of the text; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .shared import shuffle_partitions

U = np.uint64
WINDOW, GRAM = 35, 8
#: Bytes of a window's hash that travel; the anchor's 64 bits and the offset add to them.
HASH_BYTES = 5
SENT = "key long, doc_id long, th long, pos int, off int, n int, mult int, wins binary"
FOUND = "doc_id long, th long, pos int, mask long"
KEPT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,stop:int>>"


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least of values[i:i + width], for each i."""
    at = np.arange(len(values))
    span = 1
    while span < width:
        step = min(span, width - span)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        span += step
    return at


def _sender(window: int):
    grams_in = window - GRAM + 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            hashes = batch.column(1).to_numpy(zero_copy_only=False)
            for c in T.chunks(batch.column(2), 2 * T.CHUNK_BYTES):
                n = len(c.doc) - window + 1
                if n <= 0:
                    continue
                words = c.word_hashes()
                grams = T.gram_hashes(words, GRAM)
                starts = np.flatnonzero(c.doc[:n] == c.doc[window - 1 :])
                if not len(starts):
                    continue
                anchor = _sliding_argmin(grams, grams_in)[starts]
                hashed = T.gram_hashes(words, window)[starts]
                new = np.ones(len(starts), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
                head = np.flatnonzero(new)
                size = np.diff(np.append(head, len(starts)))
                key = grams[anchor[head]]
                off = anchor[head] - starts[head]
                # runs that are equal within the chunk
                place = np.arange(len(starts)) - np.repeat(head, size)
                sign = np.add.reduceat(T.mix(hashed + place.astype(U) * U(0x9E3779B97F4A7C15)), head) ^ T.mix(key + off.astype(U))
                _, first, inverse, many = np.unique(sign, return_index=True, return_inverse=True, return_counts=True)
                multiple = many[inverse] > 1
                doc = c.doc[starts[head]]
                pos = starts[head] - c.first[doc]
                row = pa.array(c.lo + doc)
                rows = ids.take(row), hashes[c.lo + doc]
                sent = np.sort(first)
                raw = hashed.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
                take = np.zeros(len(head), bool)
                take[sent] = True
                wins = raw[np.repeat(take, size)].reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [
                        T.i64(key[sent]),
                        rows[0].take(pa.array(sent)),
                        pa.array(rows[1][sent]),
                        pa.array(pos[sent].astype(np.int32)),
                        pa.array(off[sent].astype(np.int32)),
                        pa.array(size[sent].astype(np.int32)),
                        pa.array(np.where(multiple[sent], 2, 1).astype(np.int32)),
                        T.binaries(wins, np.cumsum(size[sent]) * HASH_BYTES),
                    ],
                    names=["key", "doc_id", "th", "pos", "off", "n", "mult", "wins"],
                )
                # settled here already: passed on to be gathered by document
                done = np.flatnonzero(multiple)
                if len(done):
                    k = len(done)
                    own = rows[0].take(pa.array(done))
                    spread = T.mix(own.fill_null(-1).to_numpy().view(U) + U(1))
                    yield pa.RecordBatch.from_arrays(
                        [T.i64(spread), own, pa.array(rows[1][done]), pa.array(pos[done].astype(np.int32)), pa.array(np.zeros(k, np.int32)), pa.array(size[done].astype(np.int32)), pa.array(np.zeros(k, np.int32)), pa.nulls(k, pa.binary())],
                        names=["key", "doc_id", "th", "pos", "off", "n", "mult", "wins"],
                    )

    return send


def _settle(key, doc, th, pos, off, size, mult, wins) -> pa.RecordBatch | None:
    """Compares the windows of whole anchor groups; rows come sorted by key."""
    settled = mult == 0
    mask = np.where(settled, (np.int64(1) << size.astype(np.int64)) - 1, 0)
    live = np.flatnonzero(~settled)
    if len(live):
        group = np.cumsum(np.append(True, key[live][1:] != key[live][:-1]))
        alone = np.bincount(group)[group] == 1
        busy = live[~alone]
        if len(busy):
            gid = group[~alone]
            n = size[busy]
            ends = np.cumsum(n)
            row = np.repeat(np.arange(len(busy)), n)
            j = np.arange(ends[-1]) - np.repeat(ends - n, n)
            raw = np.frombuffer(b"".join(wins[i] for i in busy), np.uint8).reshape(-1, HASH_BYTES)
            h = np.zeros((len(raw), 8), np.uint8)
            h[:, :HASH_BYTES] = raw
            h = h.view(U).reshape(-1)
            shift = (np.repeat(off[busy], n) - j + 64).astype(U)
            order = np.lexsort((h, shift, gid[row]))
            same = (gid[row][order][1:] == gid[row][order][:-1]) & (shift[order][1:] == shift[order][:-1]) & (h[order][1:] == h[order][:-1])
            first = np.append(True, ~same)
            cls = np.cumsum(first) - 1
            times = np.bincount(cls, weights=mult[busy][row][order])
            again = np.zeros(len(h), bool)
            again[order] = times[cls] >= 2
            bits = np.where(again, np.int64(1) << j.astype(np.int64), 0)
            mask[busy] = np.bitwise_or.reduceat(bits, ends - n)
    out = np.flatnonzero(mask != 0)
    if not len(out):
        return None
    return pa.RecordBatch.from_arrays([pa.array(doc).take(pa.array(out)), pa.array(th[out]), pa.array(pos[out]), pa.array(mask[out])], names=["doc_id", "th", "pos", "mask"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the sorted rows between anchor groups and settles each piece."""
    held: list[pa.RecordBatch] = []
    last = None

    def settle(pieces: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(pieces).combine_chunks()
        col = [t.column(i).to_numpy() for i in (0, 2, 3, 4, 5, 6)]
        return _settle(col[0], t.column(1).combine_chunks(), col[1], col[2], col[3], col[4], col[5], t.column(7).to_pylist())

    for batch in batches:
        key = batch.column(0).to_numpy()
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            found = settle([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held and last != key[-1]:
            found, held = settle(held), [batch]
        else:
            found = None
            held.append(batch)
        last = key[-1]
        if found is not None:
            yield found
    if held and (found := settle(held)) is not None:
        yield found


def recurring(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, th, pos, mask): bit j tells that the window at word pos + j also starts elsewhere."""
    if window - GRAM + 1 > 62 or window < GRAM:
        raise ValueError(f"window: {GRAM} to {GRAM + 61} words")
    sent = docs.select("doc_id", "th", "text").mapInArrow(_sender(window), SENT)
    parts = shuffle_partitions(docs.sparkSession)
    return sent.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_compare, FOUND)


def _remover(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = batch.column(2)
            for c in T.chunks(batch.column(1)):
                own = flags.slice(c.lo, c.n)
                gone = _covered(c, _starts(c, own, window), window)
                yield _kept(batch.column(0).slice(c.lo, c.n), c, gone)

    return remove


def _starts(c: T.Chunk, flags: pa.Array, window: int) -> np.ndarray:
    """Whether a recurring window starts at each word of the chunk."""
    out = np.zeros(len(c.doc) + 64, bool)
    counts = flags.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = flags.flatten()
    if len(rows):
        base = np.repeat(c.first[:-1], counts)
        pos, mask = rows.field(0).to_numpy(zero_copy_only=False), rows.field(1).to_numpy(zero_copy_only=False)
        for j in range(window):
            hit = (mask >> j) & 1 == 1
            out[(base + pos)[hit] + j] = True
    return out[: len(c.doc)]


def _covered(c: T.Chunk, starts: np.ndarray, window: int) -> np.ndarray:
    """Words under an occurrence of a recurring window, located by the shard's automaton."""
    at = np.flatnonzero(starts)
    delta = np.zeros(len(c.doc) + 1, np.int64)
    if len(at):
        _, number = np.unique(c.word_hashes(), return_inverse=True)
        number = number + 1
        new = np.append(True, (np.diff(at) != 1) | (c.doc[at[1:]] != c.doc[at[:-1]]))
        head = np.flatnonzero(new)
        stop = np.append(head[1:], len(at))
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        numbers = number.tolist()
        for a, b in zip(at[head].tolist(), at[stop - 1].tolist(), strict=True):
            for s in [*range(a, b, window), b]:
                automaton.add_word(tuple(numbers[s : s + window]), 1)
        automaton.make_automaton()
        # 0, which is no word's number, parts the documents
        gaps = np.insert(number, c.first[1:-1], 0) if c.n > 1 else number
        ends = np.fromiter((e for e, _ in automaton.iter(tuple(gaps.tolist()))), np.int64)
        back = np.cumsum(gaps != 0) - 1
        ends = back[ends]
        np.add.at(delta, ends - window + 1, 1)
        np.add.at(delta, ends + 1, -1)
    return np.cumsum(delta)[:-1] > 0


def _kept(ids: pa.Array, c: T.Chunk, gone: np.ndarray) -> pa.RecordBatch:
    """Kept words joined by one space, and the runs of removed words."""
    size = len(c.data)
    data = np.append(c.data, np.uint8(32))
    edge = np.zeros(size + 2, np.int64)
    keep = ~gone
    np.add.at(edge, c.starts[keep], 1)
    np.add.at(edge, c.ends[keep], -1)
    word = np.cumsum(edge)[: size + 1] > 0
    # the place after a kept word becomes its space, unless the document ends there
    after = c.ends[keep]
    after = after[after < c.bounds[1:][c.doc[keep]]]
    data = data.copy()
    data[after] = 32
    word[after] = True
    total = np.zeros(size + 1, np.int64)
    np.cumsum(word[:size], out=total[1:])
    flat = data[:size][word[:size]].tobytes()
    bounds = total[c.bounds]
    texts = [flat[a:b].rstrip(b" ").decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    lost = np.zeros(len(gone) + 1, np.int64)
    np.cumsum(gone, out=lost[1:])
    n_removed = lost[c.first[1:]] - lost[c.first[:-1]]
    run = np.flatnonzero(gone & np.append(True, ~gone[:-1] | (c.doc[1:] != c.doc[:-1]))) if len(gone) else np.zeros(0, np.int64)
    stop = np.flatnonzero(gone & np.append(~gone[1:] | (c.doc[1:] != c.doc[:-1]), True)) + 1 if len(gone) else np.zeros(0, np.int64)
    spans = pa.StructArray.from_arrays([pa.array((run - c.first[c.doc[run]]).astype(np.int32)), pa.array((stop - c.first[c.doc[run]]).astype(np.int32))], names=["start", "stop"])
    offsets = pa.array(np.searchsorted(run, c.first).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(c.counts.astype(np.int64)), pa.array(n_removed), pa.array(texts, pa.string()), pa.ListArray.from_arrays(offsets, spans)],
        names=["doc_id", "n_words", "n_removed", "kept_text", "removed"],
    )


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text, removed (spans of words)."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).cast("string").alias("text"))
    found = recurring(base, window).groupBy("doc_id", "th").agg(F.collect_list(F.struct("pos", "mask")).alias("flags"))
    found = found.withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    return joined.select("doc_id", "text", "flags").mapInArrow(_remover(window), KEPT)
