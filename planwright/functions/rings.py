"""Tests of whole polygons against each other as Arrow functions: a batch of pairs at once, in numpy.

The formulas are those of ``geometry``, which walks one ring at a time; pairs of equal numbers of vertices are
taken together, in slices of bounded size.  A polygon that is null, or holds a null, gives null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, types
from pyspark.sql import functions as F

#: Lengths that count as none, and least cross product of lines that cross.
TINY, CROSSING = 1e-12, 1e-9
#: Most numbers in a temporary array: few enough to stay near the processor.
SLICE = 1 << 15


def _rings(polygons: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each ring starts, how many points it has (-1: null), and all points."""
    start, size = polygons.offsets.to_numpy()[:-1].astype(np.int64), np.diff(polygons.offsets.to_numpy()).astype(np.int64)
    values = polygons.values
    # a null point makes its numbers null
    points = np.column_stack([f.to_numpy(zero_copy_only=False) for f in values.flatten()[:2]]) if len(values) else np.zeros((0, 2))
    return start, np.where(polygons.is_valid().to_numpy(zero_copy_only=False), size, -1), points


def _pairs(a: pa.ListArray, b: pa.ListArray, cost) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of pairs with their rings, (n, vertices, 2) each; pairs with a null are left out."""
    (sa, na, pa_), (sb, nb, pb) = _rings(a), _rings(b)
    for ka, kb in np.unique(np.column_stack([na, nb])[(na >= 0) & (nb >= 0)], axis=0).tolist():
        found = np.flatnonzero((na == ka) & (nb == kb))
        step = max(1, SLICE // max(1, cost(ka, kb)))
        for at in range(0, len(found), step):
            i = found[at : at + step]
            ra, rb = pa_[sa[i][:, None] + np.arange(ka)], pb[sb[i][:, None] + np.arange(kb)]
            whole = ~(np.isnan(ra).any((1, 2)) | np.isnan(rb).any((1, 2)))
            yield i[whole], ra[whole], rb[whole]


def _next(ring: np.ndarray) -> np.ndarray:
    return np.roll(ring, -1, 1)


def _to_edges(p: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Distances (n, points, edges) of points (n, points, 2) from the edges of rings (n, vertices, 2)."""
    d, v = (_next(ring) - ring)[:, None], p[:, :, None] - ring[:, None]
    squared = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(squared < 1e-18, 0.0, np.fmax(0.0, np.fmin(1.0, (v[..., 0] * d[..., 0] + v[..., 1] * d[..., 1]) / squared)))
    return np.hypot(v[..., 0] - d[..., 0] * t, v[..., 1] - d[..., 1] * t)


def _odd(p: np.ndarray, ring: np.ndarray) -> np.ndarray:
    a, b, q = ring[:, None], _next(ring)[:, None], p[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (b[..., 0] - a[..., 0]) * (q[..., 1] - a[..., 1]) / (b[..., 1] - a[..., 1]) + a[..., 0]
    return (((a[..., 1] > q[..., 1]) != (b[..., 1] > q[..., 1])) & (q[..., 0] < at)).sum(2) % 2 == 1


def _cross_any(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether any edge of one ring crosses one of the other."""
    def side(p, q, r):
        return (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])

    def apart(u, v):
        return ((u > CROSSING) & (v < -CROSSING)) | ((u < -CROSSING) & (v > CROSSING))

    p, q, r, s = a[:, :, None], _next(a)[:, :, None], b[:, None], _next(b)[:, None]
    return (apart(side(p, q, r), side(p, q, s)) & apart(side(r, s, p), side(r, s, q))).any((1, 2))


def _held(outer: pa.Array, inner: pa.Array, tolerance: pa.Array) -> pa.Array:
    out, known = np.zeros(len(outer), bool), np.zeros(len(outer), bool)
    near = tolerance.to_numpy(zero_copy_only=False)
    for i, ring, own in _pairs(outer, inner, lambda k, n: 2 * k * n):
        p = np.concatenate([own, (own + _next(own)) / 2], 1)
        held = _odd(p, ring)
        # distances are for points that aren't inside, crossings for rings that have all of theirs within reach
        row, at = np.nonzero(~held)
        held[row, at] = (_to_edges(p[row, at][:, None], ring[row])[:, 0] <= near[i][row][:, None]).any(1)
        held = held.all(1)
        held[held] = ~_cross_any(own[held], ring[held])
        out[i], known[i] = held, True
    return pa.array(out, mask=~known)


def _outside(inner: pa.Array, outer: pa.Array, step: pa.Array, tolerance: pa.Array) -> pa.Array:
    out, known = np.zeros(len(outer)), np.zeros(len(outer), bool)
    size, near = step.to_numpy(zero_copy_only=False), tolerance.to_numpy(zero_copy_only=False)
    for i, own, ring in _pairs(inner, outer, lambda k, n: k * n * 4):
        known[i] = True
        if not own.shape[1]:
            continue
        to = _next(own) - own
        each = np.maximum(1, np.ceil(np.hypot(to[..., 0], to[..., 1]) / size[i][:, None])).astype(np.int64).ravel()
        ends = np.cumsum(each)
        x, z, to_x, to_z = (np.ascontiguousarray(v[..., c]).ravel() for v in (own, to) for c in (0, 1))
        sides = np.ascontiguousarray(np.stack([ring[..., 0], ring[..., 1], _next(ring)[..., 1], *np.moveaxis(_next(ring) - ring, 2, 0)]).transpose(2, 0, 1))
        # samples of all edges behind each other, in slices: an edge may be long, and a row's worst sample is kept
        total = int(ends[-1]) if len(ends) else 0
        for at in range(0, total, SLICE):
            stop = min(at + SLICE, total)
            e = np.arange(np.searchsorted(ends, at, "right"), np.searchsorted(ends, stop - 1, "right") + 1)
            e = np.repeat(e, np.minimum(ends[e], stop) - np.maximum(ends[e] - each[e], at))
            share = (np.arange(at, stop) - (ends[e] - each[e])) / each[e]
            p, q, row = x[e] + to_x[e] * share, z[e] + to_z[e] * share, e // own.shape[1]
            beyond = np.ones(len(row), bool)
            for side in sides:
                a, c, end, dx, dz = (v[row] for v in side)
                with np.errstate(divide="ignore", invalid="ignore"):
                    beyond ^= ((c > q) != (end > q)) & (p < dx * (q - c) / dz + a)
            p, q, row = p[beyond], q[beyond], row[beyond]
            far = np.full(len(row), np.inf)
            for side in sides:
                a, c, _, dx, dz = (v[row] for v in side)
                vx, vz = p - a, q - c
                squared = dx * dx + dz * dz
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = np.where(squared < 1e-18, 0.0, np.fmax(0.0, np.fmin(1.0, (vx * dx + vz * dz) / squared)))
                far = np.minimum(far, np.hypot(vx - dx * t, vz - dz * t))
            np.maximum.at(out, i[row], np.where(far <= near[i[row]], 0.0, far))
    return pa.array(out, mask=~known)


def _depth(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least overlap of convex rings along an edge's normal; zero or less, on the first such normal, where they are apart; NaN without edges."""
    both = np.concatenate([a, b], 1)
    to = np.concatenate([_next(a), _next(b)], 1) - both
    n = np.hypot(to[..., 1], to[..., 0])
    good = n >= TINY
    safe = np.where(good, n, 1.0)
    x, z = -to[..., 1] / safe, to[..., 0] / safe
    along = lambda ring: ring[:, None, :, 0] * x[..., None] + ring[:, None, :, 1] * z[..., None]
    u, v = along(a), along(b)
    d = np.fmin(u.max(2, initial=-np.inf), v.max(2, initial=-np.inf)) - np.fmax(u.min(2, initial=np.inf), v.min(2, initial=np.inf))
    apart = good & (d <= 0)
    first = np.take_along_axis(d, apart.argmax(1)[:, None], 1)[:, 0]
    return np.where(apart.any(1), first, np.where(good.any(1), np.where(good, d, np.inf).min(1, initial=np.inf), np.nan))


def _deepest(a: pa.Array, b: pa.Array) -> pa.Array:
    def parts(x: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
        size = np.where(x.is_valid().to_numpy(zero_copy_only=False), np.diff(x.offsets.to_numpy()), 0)
        return x.offsets.to_numpy()[:-1].astype(np.int64), size.astype(np.int64), x.values

    (sa, na, va), (sb, nb, vb) = parts(a), parts(b)
    # every part of the one with every part of the other, as many rows as their numbers multiplied, in slices
    out = np.full(len(a), -np.inf)
    ends = np.cumsum(na * nb)
    for at in range(0, int(ends[-1]) if len(ends) else 0, SLICE // 16):
        k = np.arange(at, min(at + SLICE // 16, int(ends[-1])))
        row = np.searchsorted(ends, k, "right")
        m = k - (ends[row] - na[row] * nb[row])
        left, right = va.take(pa.array(sa[row] + m // nb[row])), vb.take(pa.array(sb[row] + m % nb[row]))
        for i, p, q in _pairs(left, right, lambda x, y: (x + y) * (x + y)):
            if p.shape[1] and q.shape[1]:
                np.fmax.at(out, row[i], _depth(p, q))
    return pa.array(out, mask=np.isneginf(out))


def _each(f, many: pa.Array, *one: pa.Array) -> pa.Array:
    """``f`` of every member of a list with its row's ``one``, as lists."""
    rows = pc.list_parent_indices(many)
    ends = np.cumsum(np.where(many.is_valid().to_numpy(zero_copy_only=False), np.diff(many.offsets.to_numpy()), 0))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), f(pc.list_flatten(many), *[x.take(rows) for x in one]))


def _held_by_each(outers: pa.Array, inner: pa.Array, tolerance: pa.Array) -> pa.Array:
    return _each(_held, outers, inner, tolerance)


def _depth_in_each(many: pa.Array, own: pa.Array) -> pa.Array:
    return _each(_deepest, many, own)


def _beyond(inner: pa.Array, outer: pa.Array, step: pa.Array, tolerance: pa.Array, held: pa.Array) -> pa.Array:
    outside = pc.invert(_held(outer, inner, held))
    rows = pc.indices_nonzero(outside)
    out = np.zeros(len(inner))
    out[rows.to_numpy()] = _outside(*[x.take(rows) for x in (inner, outer, step, tolerance)]).to_numpy(zero_copy_only=False)
    return pa.array(out, mask=~outside.is_valid().to_numpy(zero_copy_only=False))


_contains, _contains_each = F.arrow_udf(_held, types.BooleanType()), F.arrow_udf(_held_by_each, types.ArrayType(types.BooleanType()))
_protrusion, _overhang = F.arrow_udf(_outside, types.DoubleType()), F.arrow_udf(_beyond, types.DoubleType())
_parts_depth, _depths = F.arrow_udf(_deepest, types.DoubleType()), F.arrow_udf(_depth_in_each, types.ArrayType(types.DoubleType()))


def contains(outer: Column, inner: Column, tolerance: float) -> Column:
    return _contains(outer, inner, F.lit(float(tolerance)))


def protrusion(inner: Column, outer: Column, step: float, tolerance: float) -> Column:
    return F.coalesce(_protrusion(inner, outer, F.lit(float(step)), F.lit(float(tolerance))), F.lit(0.0))


def parts_depth(a: Column, b: Column) -> Column:
    return _parts_depth(a, b)


def contains_each(outers: Column, inner: Column, tolerance: float) -> Column:
    """``contains`` for each ring of an array."""
    return _contains_each(outers, inner, F.lit(float(tolerance)))


def overhang(inner: Column, outer: Column, step: float, tolerance: float, held: float) -> Column:
    """``protrusion``, but 0 where ``contains`` holds within ``held``."""
    return F.coalesce(_overhang(inner, outer, F.lit(float(step)), F.lit(float(tolerance)), F.lit(float(held))), F.lit(0.0))


def depths(many: Column, own: Column) -> Column:
    """``parts_depth`` of ``own`` with each set of parts in an array."""
    return _depths(many, own)
