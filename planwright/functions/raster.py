"""Pixel kernels in numpy: one image per call, arrays indexed (row, column)."""

from __future__ import annotations

import numpy as np

#: Luma weights of red, green and blue.
LUMA = (0.299, 0.587, 0.114)


def to_gray(rgba: np.ndarray) -> np.ndarray:
    """Luma over white paper; alpha blends with the paper."""
    rgba = rgba.astype(np.float64)
    gray = rgba[..., 0] * LUMA[0] + rgba[..., 1] * LUMA[1] + rgba[..., 2] * LUMA[2]
    alpha = rgba[..., 3] / 255 if rgba.shape[-1] == 4 else 1.0
    return np.floor(gray * alpha + 255 * (1 - alpha) + 0.5).astype(np.uint8)


def histogram(gray: np.ndarray) -> np.ndarray:
    return np.bincount(gray.reshape(-1), minlength=256)


def otsu(counts: np.ndarray) -> int:
    """First threshold of greatest between-class variance: values below it are dark."""
    values = np.arange(len(counts))
    w0, s0 = np.cumsum(counts).astype(float), np.cumsum(counts * values).astype(float)
    w1, s1 = w0[-1] - w0, s0[-1] - s0
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((w0 > 0) & (w1 > 0), w0 * w1 * (s0 / w0 - s1 / w1) ** 2, -1)
    return int(np.argmax(between)) + 1


def stretch(gray: np.ndarray, low: float = 0.005, high: float = 0.995, least: int = 16) -> np.ndarray:
    """Linear contrast stretch between two percentiles; flat images stay as they are."""
    share = np.cumsum(histogram(gray)) / gray.size
    lo, hi = int(np.argmax(share > low)), int(np.argmax(share >= high))
    if hi - lo < least:
        return gray
    return np.clip(np.floor((gray.astype(float) - lo) * 255 / (hi - lo) + 0.5), 0, 255).astype(np.uint8)


def fill_polygon(shape: tuple[int, int], points: np.ndarray) -> np.ndarray:
    """Pixels whose centres lie in a polygon of (x, y) points, by the even-odd rule."""
    y, x = np.mgrid[: shape[0], : shape[1]] + 0.5
    inside = np.zeros(shape, bool)
    for (ax, ay), (bx, by) in zip(points, np.roll(points, -1, axis=0)):
        if ay != by:
            inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return inside


def _window(mask: np.ndarray, radius: int, axis: int, reduce) -> np.ndarray:
    pad = [(0, 0), (0, 0)]
    pad[axis] = (radius, radius)
    view = np.lib.stride_tricks.sliding_window_view(np.pad(mask, pad, mode="edge"), 2 * radius + 1, axis=axis)
    return reduce(view, axis=-1)


def flatten_background(gray: np.ndarray, radius: int = 15) -> np.ndarray:
    """Divides by the local paper, the greatest value in a square around each pixel."""
    paper = _window(_window(gray, radius, 1, np.max), radius, 0, np.max).astype(float)
    return np.clip(np.floor(gray * 255 / np.maximum(paper, 1) + 0.5), 0, 255).astype(np.uint8)


def suppress_colour(rgba: np.ndarray, gray: np.ndarray, chroma: int = 45, least: int = 70) -> tuple[np.ndarray, np.ndarray]:
    """Turns coloured pixels of coloured surroundings to paper; returns grey and the tint mask."""
    rgb = rgba[..., :3].astype(int)
    tint = (rgb.max(axis=-1) - rgb.min(axis=-1) >= chroma) & (gray >= least)
    p = np.pad(tint, 1, mode="edge")
    solid = tint & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    return np.where(solid, 255, gray).astype(np.uint8), solid


def distance_transform(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of each set pixel from the nearest clear one.

    Columns first give the vertical distance; then each row takes the least of the parabolas over
    its columns.
    """
    h, w = mask.shape
    far = h + w
    vertical = np.where(mask, far, 0).astype(np.int64)
    for y in range(1, h):
        vertical[y] = np.minimum(vertical[y], vertical[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        vertical[y] = np.minimum(vertical[y], vertical[y + 1] + 1)
    columns = np.arange(w)
    apart = (columns[:, None] - columns[None, :]) ** 2
    out = np.empty((h, w))
    for y in range(h):
        out[y] = np.sqrt((vertical[y] ** 2 + apart).min(axis=1))
    return out


def connected_components(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Labels from 1 in scan order, 0 for clear pixels, and how many there are.

    Every pixel takes the least place in its neighbourhood until nothing changes, with places
    followed to their own label in between.
    """
    h, w = mask.shape
    place = np.where(mask, np.arange(h * w).reshape(h, w), h * w)
    shifts = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    pairs = []
    for dy, dx in shifts:
        a = place[: h - dy, max(0, -dx) : w - max(0, dx)]
        b = place[dy:, max(0, dx) : w + min(0, dx)]
        both = (a < h * w) & (b < h * w)
        pairs.append(np.stack([a[both], b[both]]))
    a, b = np.concatenate(pairs, axis=1)
    label = np.arange(h * w + 1)
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while not (new == new[new]).all():
            new = new[new]
        if (new == label).all():
            break
        label = new
    found, number = np.unique(label[place[mask]], return_inverse=True)
    out = np.zeros((h, w), np.int64)
    out[mask] = number + 1
    return out, len(found)


def fill_small_holes(mask: np.ndarray, most: int) -> np.ndarray:
    """Sets enclosed clear areas of at most ``most`` pixels."""
    labels, n = connected_components(~mask, diagonal=False)
    edge = np.unique(np.concatenate([labels[0], labels[-1], labels[:, 0], labels[:, -1]]))
    area = np.bincount(labels.reshape(-1), minlength=n + 1)
    small = (area <= most) & ~np.isin(np.arange(n + 1), edge)
    small[0] = False
    return mask | small[labels]


def skeletonize(mask: np.ndarray) -> np.ndarray:
    """Thins a mask to lines, peeling alternate sides until nothing changes (Zhang and Suen)."""
    m = np.pad(mask, 1).astype(np.uint8)
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    while True:
        before = m.sum()
        for side in (0, 1):
            p = [np.roll(m, (-dy, -dx), (0, 1)) for dy, dx in ring]
            n = sum(q.astype(int) for q in p)
            turns = sum(((p[i] == 0) & (p[(i + 1) % 8] == 1)).astype(int) for i in range(8))
            north, east, south, west = p[0], p[2], p[4], p[6]
            open_side = (north * east * south == 0) & (east * south * west == 0) if side == 0 else (north * east * west == 0) & (north * south * west == 0)
            m[(m == 1) & (n >= 2) & (n <= 6) & (turns == 1) & open_side] = 0
        if m.sum() == before:
            return m[1:-1, 1:-1].astype(bool)


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices of the points that a line keeps within a tolerance (Douglas and Peucker)."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = points[b] - points[a]
        rest = points[a + 1 : b] - points[a]
        length = np.hypot(*d)
        off = np.abs(d[0] * rest[:, 1] - d[1] * rest[:, 0]) / length if length > 1e-12 else np.hypot(rest[:, 0], rest[:, 1])
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.flatnonzero(keep)


def noise(width: int, height: int, seed: int) -> np.ndarray:
    """Grey noise from the top byte of a linear congruential generator."""
    # fixed values: multiplier and increment of the generator
    a, c = 1664525, 1013904223
    n = width * height
    out = np.empty(n, np.uint8)
    s = seed & 0xFFFFFFFF
    for i in range(n):
        s = (a * s + c) & 0xFFFFFFFF
        out[i] = s >> 24
    return out.reshape(height, width)
