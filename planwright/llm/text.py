"""Vectorised text kernels shared by the corpus operators.

A *chunk* is a run of whole documents whose UTF-8 bytes lie in one buffer.  Words, lines and
n-grams are arrays over that buffer, so a document costs array operations, not a Python loop.
Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; those bytes never occur inside a
multi-byte UTF-8 sequence, so the byte split equals the code-point split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text handled at once; one longer document makes a chunk of its own.
CHUNK_BYTES = 1_000_000

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _mix_int(x: int) -> int:
    m = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & m
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return x ^ (x >> 31)


#: A random-looking 64-bit value for each byte.
BYTE_VALUE = np.array([_mix_int(i + 1) for i in range(256)], dtype=U)
_BASE = {"word": 0xD1342543DE82EF95, "gram": 0xAF251AF3B0F025B5, "line": 0xC2B2AE3D27D4EB4F}
_powers: dict[tuple[str, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(kind: str, n: int, inverse: bool = False) -> np.ndarray:
    """base**i (or base**-i) modulo 2**64 for i < n."""
    got = _powers.get((kind, inverse))
    if got is None or len(got) < n:
        base = _BASE[kind] if not inverse else pow(_BASE[kind], -1, 1 << 64)
        m = max(n, 1 << 16)
        got = np.empty(m, U)
        got[0] = 1
        done = 1
        while done < m:
            step = min(done, m - done)
            got[done : done + step] = got[:step] * U(pow(base, done, 1 << 64))
            done += step
        if n <= 4 * CHUNK_BYTES:
            _powers[kind, inverse] = got
    return got[:n]


class Chunk:
    """Documents ``lo:hi`` of a record batch: their bytes and the words in them."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lo: int):
        self.data, self.bounds, self.lo = data, bounds, lo
        self.n = len(bounds) - 1
        space = SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[bounds] = True
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = True
            before[1:] = space[:-1]
            after = np.empty(len(data), bool)
            after[-1] = True
            after[:-1] = space[1:]
            before |= cut[:-1]
            after |= cut[1:]
            inside = ~space
            self.starts = np.flatnonzero(inside & before)
            self.ends = np.flatnonzero(inside & after) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.space = space
        #: Word i of the chunk lies in document doc[i]; document d has words first[d]:first[d + 1].
        self.first = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.counts)

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        data = LOWER[self.data] if lower else self.data
        return span_hashes(data, self.starts, self.ends, "word")

    def span(self, d: int) -> bytes:
        return self.data[self.bounds[d] : self.bounds[d + 1]].tobytes()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans have equal hashes wherever they lie."""
    if not len(starts):
        return np.zeros(0, U)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_VALUE[data] * powers(kind, len(data)), out=total[1:])
    out = total[ends] - total[starts]
    out *= powers(kind, len(data) + 1, inverse=True)[starts]
    return mix(out + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of values[i:i + k] for each i (empty if there are fewer than k)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers("gram", len(values)), out=total[1:])
    out = total[k:] - total[:n]
    out *= powers("gram", n, inverse=True)
    return mix(out + U(k))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts a string column into chunks of about ``limit`` bytes, whole documents each."""
    data, bounds = buffers(column)
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield Chunk(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], lo)
        lo = hi


def i64(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as the signed integers of Spark's bigint."""
    return pa.array(values.astype(U, copy=False).view(np.int64))


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte strings values[ends[i - 1]:ends[i]] as a binary column."""
    bounds = np.zeros(len(ends) + 1, np.int32)
    bounds[1:] = ends
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(values.tobytes())])
