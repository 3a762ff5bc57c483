"""N-gram Jaccard join: near-duplicate classes of whole texts.

Method: documents with equal sets of ``SHINGLE``-word shingles form one node.  A node's shingles
are put in rare-first order, and those in its prefix (all but ceil(t n) - 1 of n) are the keys of a
join; length and positional filters prune key matches, a suffix filter prunes what reaches
verification, and every remaining pair is verified once on the full sets.

*Rare first* needs a common order only: shingles are ordered by frequency class, then hash, where
the class comes from a counting sketch of 2**SKETCH_BITS cells over all documents.  Its size is
fixed, so it may be broadcast whatever the corpus; a cell's class is its count against the median
cell, so only shingles above the crowd move back.

*Large key groups* are not expanded into all pairs.  First each member meets its neighbours by size
and its block's first member; verified links merge into components.  Then members of a group that are
still in different components meet in rounds: each round splits the groups by a further element, the
least of a node's shingles under that round's hash, and a member meets two neighbours in its part.
Rounds go on while they leave fewer pairs.  In the end every pair of members from different components
is compared by fine parities of the sets, and what these can't exclude is verified; the largest
component of a large group is dealt out over blocks for that.  Pairs inside one component need no
verification, so no link between components is lost.

Texts move only for nodes in pairs that the parities let through; a bit table of fixed size keeps the
others at their scan.

Defined results: null texts and texts without words have 0 shingles and link with nothing; texts of
fewer than five words are one shingle; exact copies link; a null id gets the least id of its class;
repeated rows are copies; a very long text has as many keys as its prefix is long and is compared
whole; other columns are ignored; an empty table gives an empty one.  Sets are taken as equal where
64 bits of hash over all their shingles and their sizes agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .components import PER_TASK, components
from .shared import checkpointed, shuffle_partitions

U = np.uint64
SHINGLE = 5
#: Similarity threshold in percent.
PERCENT = 80
SKETCH_BITS, BLOCK_CELLS = 24, 1 << 18
#: Counts of a cell end here.
MOST_SEEN = 65535
#: Key groups up to SMALL members meet in full at once; BLOCK members share a first member.
SMALL, BLOCK = 8, 16
#: Pairs per member up to which open groups meet in full without another round by neighbours.
ALL_PAIRS = 64
#: Hashes that split the groups in rounds by neighbours, and members of a block in the last meeting.
ROUNDS, DEALT = 4, 20_000
#: Parity cells per shingle, and cells at most.
FINE, MOST_CELLS = 2, 1 << 15
#: log2 of the bits that tell which texts may meet another.
WANTED_BITS = 24
#: Depth of the suffix filter's halvings.
DEPTH = 4

SIGNED = "doc_id long, th long, n_shingles long, node long, bits binary, least array<long>, block int, cells binary"
TEXTS = "at long, doc_id long, th long, packed binary"
KEYS = "key long, node long, n int, pos int"
MET = "key long, a long, b long, n int, pos int"


def shingle_sets(c: T.Chunk) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a chunk."""
    words = c.word_hashes(lower=True)
    grams = T.gram_hashes(words, SHINGLE)
    out = []
    for a, b in zip(c.first[:-1].tolist(), c.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        else:
            out.append(T.gram_hashes(words[a:b], b - a) if b > a else np.zeros(0, U))
    return out


def _node(found: np.ndarray) -> int:
    return int(T.mix(np.array([T.mix(found).sum(dtype=U) + U(len(found))], U)).view(np.int64)[0])


def parity_bits(found: np.ndarray) -> bytes:
    """Cell i holds the parity of how many elements fall in it; cells number FINE to 2 FINE a shingle."""
    n = min(MOST_CELLS, max(64, 1 << (FINE * len(found) - 1).bit_length()))
    odd = np.bincount((T.mix(found) >> U(64 - n.bit_length() + 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def least_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row for each set: its least element under each round's hash, 0 for an empty set."""
    out = np.zeros((len(sets), ROUNDS), np.int64)
    full = [i for i, x in enumerate(sets) if len(x)]
    if full:
        every = np.concatenate([sets[i] for i in full])
        head = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        for k in range(ROUNDS):
            out[full, k] = np.minimum.reduceat(T.mix(every ^ T.mix(np.array([k + 1], U))), head).view(np.int64)
    return out


def _folded(bits: np.ndarray) -> np.ndarray:
    """Parities with half the cells: a cell's place is the leading bits of a hash, so neighbours merge."""
    pair = np.unpackbits(bits, axis=-1).reshape(*bits.shape[:-1], -1, 2)
    return np.packbits(pair[..., 0] ^ pair[..., 1], axis=-1)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = np.zeros(1 << SKETCH_BITS, np.uint16)
    names = ["doc_id", "th", "n_shingles", "node", "bits", "least", "block", "cells"]
    held: list[np.ndarray] = []
    for batch in batches:
        sizes, nodes, bits, least = [], [], [], []
        for c in T.chunks(batch.column(2)):
            sets = shingle_sets(c)
            sizes += map(len, sets)
            nodes += map(_node, sets)
            bits += [parity_bits(x) if len(x) else b"" for x in sets]
            least += least_hashes(sets).tolist()
            held += sets
            if sum(map(len, held)) > T.CHUNK_BYTES:
                _count_cells(cells, held)
        n = len(sizes)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bits, pa.binary()), pa.array(least, pa.list_(pa.int64())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
    _count_cells(cells, held)
    parts = [(i, _packed_cells(p)) for i, p in enumerate(cells.reshape(-1, BLOCK_CELLS)) if p.any()]
    if parts:
        none = pa.nulls(len(parts), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(parts), pa.binary()), pa.nulls(len(parts), pa.list_(pa.int64())), pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=names)


def _packed_cells(cells: np.ndarray) -> bytes:
    """Counts below 2**16, all low bytes before all high ones, which are mostly 0."""
    return pa.compress(cells.astype(np.uint16).view(np.uint8).reshape(-1, 2).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked_cells(raw: bytes) -> np.ndarray:
    both = np.frombuffer(pa.decompress(raw, 2 * BLOCK_CELLS, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(both.reshape(2, -1).T).view(np.uint16).reshape(-1)


def _count_cells(cells: np.ndarray, held: list[np.ndarray]) -> None:
    if held:
        at, n = np.unique((np.concatenate(held) >> U(64 - SKETCH_BITS)).astype(np.uint32), return_counts=True)
        cells[at] = np.minimum(cells[at] + n, MOST_SEEN)
        held.clear()


def _add_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = _unpacked_cells(cells).astype(np.uint32)
            total[block] = np.minimum(total[block] + got, MOST_SEEN) if block in total else got
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(map(_packed_cells, total.values()), pa.binary())], names=["block", "cells"])


def frequency_classes(signed: DataFrame) -> np.ndarray:
    """A class for each cell of the sketch: 0 for the crowd, then one more per doubling.

    The crowd's cells scatter around the median like counts; a cell five deviations above it holds
    a shingle that many documents share.
    """
    rows = signed.where("block IS NOT NULL").select("block", "cells")
    n_blocks = (1 << SKETCH_BITS) // BLOCK_CELLS
    merged = rows.repartition(n_blocks, "block").mapInArrow(_add_cells, "block int, cells binary")
    cells = np.zeros((n_blocks, BLOCK_CELLS), np.uint16)
    for row in merged.toLocalIterator():
        cells[row.block] = _unpacked_cells(row.cells)
    spread = np.zeros(MOST_SEEN + 1, np.int64)
    for block in cells:
        spread += np.bincount(block, minlength=MOST_SEEN + 1)
    crowd = int(np.searchsorted(np.cumsum(spread), spread.sum() / 2))
    edge = crowd + 5 * crowd**0.5 + 3
    counts = np.arange(MOST_SEEN + 1)
    of_count = np.where(counts < edge, 0, 1 + np.floor(np.log2(np.maximum(counts, edge) / edge))).astype(np.uint8)
    return of_count[cells.reshape(-1)]


def _keys(shared):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        for batch in batches:
            seen: set[int] = set()
            parts: list[tuple[np.ndarray, ...]] = []
            for c in T.chunks(batch.column(0)):
                for found in shingle_sets(c):
                    n = len(found)
                    if not n or (node := _node(found)) in seen:
                        continue
                    seen.add(node)
                    size = n - -(-PERCENT * n // 100) + 1
                    rank = classes[(found >> U(64 - SKETCH_BITS)).astype(np.int64)]
                    prefix = found[:size] if not rank.any() else found[np.argsort(rank, kind="stable")[:size]]
                    parts.append((prefix, np.full(size, node), np.full(size, n), np.arange(size)))
            if parts:
                key, node, n, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([T.i64(key), pa.array(node), pa.array(n.astype(np.int32)), pa.array(pos.astype(np.int32))], names=["key", "node", "n", "pos"])

    return keys


def _possible(na, nb, ia, ib) -> np.ndarray:
    """Length and positional filter: can a pair whose first common key is here reach the threshold?"""
    least = -(-PERCENT * (na + nb) // (100 + PERCENT))
    near = 100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)
    return near & (1 + np.minimum(na - ia, nb - ib) - 1 >= least)


def _pairs(at: np.ndarray, to: np.ndarray, node, n, pos) -> tuple[np.ndarray, np.ndarray]:
    ok = _possible(n[at].astype(np.int64), n[to].astype(np.int64), pos[at], pos[to]) & (node[at] != node[to])
    a, b = node[at[ok]], node[to[ok]]
    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pair[:, 0], pair[:, 1]


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[dict[str, np.ndarray]]:
    """Cuts rows sorted by their first column into pieces of whole groups."""
    held: list[pa.RecordBatch] = []
    count = 0

    def columns(pieces):
        t = pa.Table.from_batches(pieces)
        return {name: t.column(name).to_numpy() for name in t.column_names}

    for batch in batches:
        key = batch.column(0).to_numpy()
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if held and count and (cut or held[-1].column(0)[-1].as_py() != key[0]):
            if count + cut >= rows or (not cut and count >= rows):
                if cut:
                    held.append(batch.slice(0, cut))
                yield columns(held)
                held, count = [batch.slice(cut)], len(key) - cut
                continue
        held.append(batch)
        count += len(key)
    if held:
        yield columns(held)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First meeting in each key group; members of large groups are handed on as well."""
    for g in whole_groups(batches):
        key, node, n, pos = g["key"], g["node"], g["n"], g["pos"]
        again = np.zeros(len(key), bool)
        again[1:] = (key[1:] == key[:-1]) & (node[1:] == node[:-1])
        key, node, n, pos = key[~again], node[~again], n[~again], pos[~again]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(head, len(key)))
        many, rank = np.repeat(size, size), np.arange(len(key)) - np.repeat(head, size)
        at, to = [], []
        for d in range(1, SMALL):
            i = np.flatnonzero((rank + d < many) & ((many <= SMALL) | (d == 1)))
            at.append(i)
            to.append(i + d)
        # a member of a large group whose neighbours by size are out of reach meets nobody there
        close = np.zeros(len(key) + 1, bool)
        close[1:-1] = (key[1:] == key[:-1]) & (100 * n[:-1].astype(np.int64) >= PERCENT * n[1:].astype(np.int64))
        big = np.flatnonzero((many > SMALL) & (close[1:] | close[:-1]))
        if len(big):
            at.append(big)
            to.append(big - rank[big] % BLOCK)
        a, b = _pairs(np.concatenate(at), np.concatenate(to), node, n, pos)
        if len(a):
            none = pa.nulls(len(a), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b), none, none], names=["key", "a", "b", "n", "pos"])
        if len(big):
            yield pa.RecordBatch.from_arrays([pa.array(key[big]), pa.array(node[big]), pa.nulls(len(big), pa.int64()), pa.array(n[big]), pa.array(pos[big])], names=["key", "a", "b", "n", "pos"])


def _all_pairs(key, node, n, pos, label, bits, part, parts, at) -> Iterator[pa.RecordBatch]:
    """Every pair of members from different components that the filters let through.

    Beside length and position, parities bound the pair: cells that differ are no more than the
    elements that only one of the two sets has.  A member that lies in all parts of its group has
    ``part`` -1; two such members meet in one of the parts.
    """
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    for lo, hi in zip(head.tolist(), [*head[1:].tolist(), len(key)], strict=True):
        if (label[lo:hi] == label[lo]).all():
            continue
        size = np.fromiter(map(len, bits[lo:hi]), np.int64, hi - lo)
        own = {z: np.frombuffer(b"".join(bits[lo:hi][size == z]), np.uint8).reshape(-1, z) for z in np.unique(size).tolist()}
        half = {z // 2: _folded(m) for z, m in own.items()}
        row = np.zeros(hi - lo, np.int64)
        for z in own:
            row[size == z] = np.arange(len(own[z]))
        a, b = [], []
        for i in range(lo, hi - 1):
            # rows come by size, so partners within the length filter follow closely
            stop = i + 1 + int(np.searchsorted(n[i + 1 : hi], 100 * int(n[i]) // PERCENT, side="right"))
            to = np.arange(i + 1, stop)
            to = to[label[to] != label[i]]
            to = to[_possible(np.int64(n[i]), n[to].astype(np.int64), pos[i], pos[to])]
            if part[i] < 0 and parts[i] > 1:
                to = to[(part[to] >= 0) | ((node[to] ^ node[i]) % parts[i] == at[i])]
            z = int(size[i - lo])
            for table, width in ((own, z), (half, 2 * z)):
                j = to[size[to - lo] == width]
                if not len(j):
                    continue
                apart = np.bitwise_count(table[z][row[j - lo]] ^ own[z][row[i - lo]]).sum(axis=1, dtype=np.int64)
                both = n[j].astype(np.int64) + int(n[i])
                # common >= least, so both - 2 least is the most that may differ
                j = j[apart <= both - 2 * -(-PERCENT * both // (100 + PERCENT))]
                a.append(np.full(len(j), i))
                b.append(j)
        if a:
            a, b = node[np.concatenate(a)], node[np.concatenate(b)]
            if len(a):
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])


def _meet_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for g in whole_groups(batches):
        yield from _all_pairs(g["key"], g["node"], g["n"], g["pos"], g["label"], g["bits"], g["part"], g["parts"], g["at"])


def _meet_again(turn: int):
    """Members of a part of a group meet two neighbours from other components."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in whole_groups(batches):
            key, node, n, pos, label = g["key"], g["node"], g["n"], g["pos"], g["label"]
            order = np.lexsort((T.mix(node.view(U) + U(turn)), key))
            key, node, n, pos, label = key[order], node[order], n[order], pos[order], label[order]
            at = [np.flatnonzero((key[d:] == key[:-d]) & (label[d:] != label[:-d])) for d in (1, 2)]
            a, b = _pairs(np.concatenate(at), np.concatenate([x + d for d, x in enumerate(at, 1)]), node, n, pos)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return meet


def _suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> int:
    """An upper bound of the common elements, by halving both sorted sets at a pivot."""
    if not depth or len(x) < 2 or len(y) < 2:
        return min(len(x), len(y))
    middle = len(x) // 2
    cut = int(np.searchsorted(y, x[middle]))
    return _suffix_bound(x[:middle], y[:cut], depth - 1) + _suffix_bound(x[middle:], y[cut:], depth - 1)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        ok = np.zeros(len(a), bool)
        cached: dict[int, np.ndarray] = {}
        step = max(1, min(256, len(a)))
        for lo in range(0, len(a), step):
            for col, ids in ((2, a), (3, b)):
                part = [i for i in range(lo, min(lo + step, len(a))) if ids[i] not in cached]
                packed = batch.column(col).take(pa.array(part, pa.int64())).to_pylist()
                for c in T.chunks(pa.array([zlib.decompress(x).decode() for x in packed], pa.string())):
                    for k, found in enumerate(shingle_sets(c)):
                        cached[ids[part[c.lo + k]]] = found
            for i in range(lo, min(lo + step, len(a))):
                x, y = cached[a[i]], cached[b[i]]
                both = len(x) + len(y)
                least = -(-PERCENT * both // (100 + PERCENT))
                if _suffix_bound(x, y) < least:
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * common >= PERCENT * (both - common)
            if sum(map(len, cached.values())) > T.CHUNK_BYTES:
                cached.clear()
        yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["u", "v"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [zlib.compress((t or "").encode(), 1) for t in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], names=["at", "doc_id", "th", "packed"])


def _not_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose parities don't exclude that they reach the threshold."""
    for batch in batches:
        rows = zip(*(x.to_pylist() for x in batch.columns[2:]), strict=True)
        keep = []
        for i, (n, m, x, y) in enumerate(rows):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            while len(x) > len(y):
                x = _folded(x)
            while len(y) > len(x):
                y = _folded(y)
            if int(np.bitwise_count(x ^ y).sum()) <= n + m - 2 * -(-PERCENT * (n + m) // (100 + PERCENT)):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], names=["a", "b"])


def _close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that pass the parity filter."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_not_apart, "a long, b long")


def _verified(pairs: DataFrame, base: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold, as (u, v)."""
    texts = _texts(base, nodes, pairs)
    left = texts.select(F.col("node").alias("a"), F.col("packed").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("packed").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(_verify, "u long, v long")


def _texts(base: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The packed text of one document for every node of the pairs.

    A table of 2**WANTED_BITS bits by text hash, which is all that is broadcast, drops most other
    documents where they are scanned; the join decides.
    """
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    chosen = checkpointed(nodes.join(wanted, "node").select("node", F.col("of.doc_id").alias("_id"), F.col("of.th").alias("_th")))
    word, bit = (lambda th: F.shiftrightunsigned(th, 64 - WANTED_BITS + 6)), (lambda th: F.shiftrightunsigned(th, 64 - WANTED_BITS).bitwiseAND(63).cast("int"))
    marks = chosen.groupBy(word(F.col("_th")).alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(_th, {64 - WANTED_BITS}) & 63 AS INT))")).alias("_bits"))
    near = base.withColumn("_at", word(F.col("th"))).join(F.broadcast(marks), F.col("_at") == F.col("_word")).where(F.getbit("_bits", bit(F.col("th"))) == 1)
    # repeated rows meet under the join's key, so both take one shuffle
    packed = near.select(F.xxhash64("doc_id", "th").alias("at"), "doc_id", "th", "text").mapInArrow(_pack, TEXTS).dropDuplicates(["at"])
    return packed.join(chosen.withColumn("at", F.xxhash64("_id", "_th")), "at").select("node", "packed")


def _open(placed: DataFrame) -> tuple[float, float]:
    """Pairs of members of a group that are in different components, and the rows of such groups."""
    by = placed.groupBy("key", "label").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("q"))
    left, rows = by.where("m * m > q").agg(F.sum((F.col("m") * F.col("m") - F.col("q")) / 2), F.sum("m")).first()
    return left or 0.0, rows or 0.0


def _dealt(placed: DataFrame) -> DataFrame:
    """Open groups in parts: each member of the largest component in one, every other member in all."""
    by = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("most"))
    by = by.where("m > most.c").select("key", F.col("most.label").alias("main"), F.ceil(F.col("m") / DEALT).cast("int").alias("parts"))
    rows = placed.join(by, "key")
    own = F.when(F.col("label") == F.col("main"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).otherwise(-1)
    rows = rows.withColumn("part", own)
    rows = rows.withColumn("at", F.explode(F.when(F.col("part") < 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))))
    return rows.select(F.xxhash64("key", "at").alias("key"), "node", "n", "pos", "label", "part", "parts", "at")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id reachable by links)."""
    out = _classes(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _classes(base: DataFrame) -> DataFrame:
    """Rows (doc_id, th, n_shingles, component_id, component_th) for each document (doc_id, text).

    The last two name the least document of the class, ids before text hashes.
    """
    spark = base.sparkSession
    parts = shuffle_partitions(spark)
    base = base.select("doc_id", F.xxhash64("text").alias("th"), "text")
    signed = checkpointed(base.mapInArrow(_sign, SIGNED))
    shared = spark.sparkContext.broadcast(frequency_classes(signed))
    own = signed.where("block IS NULL").select("doc_id", "th", "n_shingles", "node")
    one = [F.min(F.struct("doc_id", "th")).alias("of"), F.first(F.col("n_shingles").cast("int")).alias("n"), F.first("bits").alias("bits"), F.first("least").alias("least")]
    nodes = checkpointed(signed.where("n_shingles > 0").groupBy("node").agg(*one))

    keys = base.select("text").mapInArrow(_keys(shared), KEYS)
    met = checkpointed(keys.repartition(parts, "key").sortWithinPartitions("key", "n", "node").mapInArrow(_meet, MET))
    pairs = met.where("key IS NULL").select("a", "b").distinct()
    groups = met.where("key IS NOT NULL").select("key", F.col("a").alias("node"), "n", "pos")
    pairs = checkpointed(_close(pairs, nodes))
    n_met = pairs.count()
    links = checkpointed(_verified(pairs, base, nodes).coalesce(1 + n_met // PER_TASK))
    labels = components(links, n_met)
    turn, before = 0, float("inf")
    while True:
        placed = groups.join(labels, "node", "left").select("key", "node", "n", "pos", F.coalesce("label", "node").alias("label"))
        left, rows = _open(placed)
        if not left:
            break
        every = turn == ROUNDS or left <= ALL_PAIRS * rows or left > 0.9 * before
        before = left
        if every:
            again = _dealt(placed).join(nodes.select("node", "bits"), "node").select("key", "node", "n", "pos", "label", "bits", "part", "parts", "at")
            more = again.repartition(parts, "key").sortWithinPartitions("key", "n", "node").mapInArrow(_meet_all, "a long, b long").distinct()
        else:
            again = placed.join(nodes.select("node", F.element_at("least", turn + 1).alias("least")), "node")
            again = again.select(F.xxhash64("key", "least").alias("key"), "node", "n", "pos", "label")
            more = again.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_meet_again(turn), "a long, b long").distinct()
            more = _close(more, nodes)
        found = checkpointed(_verified(checkpointed(more), base, nodes).coalesce(parts))
        n_found = found.count()
        if n_found:
            # components so far are stars; the new links join them
            stars = labels.select(F.col("node").alias("u"), F.col("label").alias("v")).where("u <> v")
            labels = components(stars.unionByName(found), n_met + n_found)
        if every:
            break
        turn += 1

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    lowest = own.where("n_shingles > 0").groupBy("node").agg(first.alias("lowest"))
    named = lowest.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    roots = named.groupBy("label").agg(F.min("lowest").alias("root"))
    byte = named.join(roots, "label").select(F.col("node").alias("_node"), "root")
    out = own.join(byte, (F.col("node") == F.col("_node")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "th", "n_shingles", F.col("root.doc_id").alias("component_id"), F.col("root.th").alias("component_th"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class of ``linked``: the one with the least id, then the least hash of its text.

    A document is known by its id and text together; rows that repeat both leave one.  Documents
    without shingles are no copies of others and all stay, save repeated rows.  All columns pass through.
    """
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    found = _classes(whole.select("doc_id", "text"))
    same = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("component_th"))
    chosen = found.where(same | (F.col("n_shingles") == 0)).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    keyed = whole.withColumn("th", F.xxhash64("text"))
    kept = keyed.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left_semi")
    return kept.dropDuplicates(["doc_id", "th"]).select("row.*")
