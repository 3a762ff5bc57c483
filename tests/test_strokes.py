"""Strokes to walls, gaps between walls, suppression and components, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from planwright.operators import gaps, spatial, structure

PT = "struct<x:double,z:double>"
WALLS = f"plan_id string, wall_id string, a {PT}, b {PT}, thickness double, confidence double"
BOX = [((0, 0), (400, 0), 12), ((400, 0), (400, 300), 12), ((0, 300), (400, 300), 12), ((0, 0), (0, 300), 12), ((200, 0), (200, 300), 6)]


def plan(name, *more):
    return [(name, f"w{i:02}", tuple(map(float, a)), tuple(map(float, b)), float(t), c) for i, (a, b, t, c) in enumerate([(*w, 0.9) for w in BOX] + [(*w, 0.9)[:4] for w in more])]


def test_structure(spark):
    table = [((260, 120), (320, 120), 4), ((320, 120), (320, 170), 4), ((260, 170), (320, 170), 4), ((260, 120), (260, 170), 4)]
    letter = [((100, 100), (100, 140), 8), ((100, 120), (120, 100), 8), ((100, 120), (120, 140), 8)]
    rows = plan("box") + plan("stroke", ((60, 150), (90, 150), 4, 0.6), *table) + plan("pier", ((600, 100), (600, 160), 14)) + plan("letter", *letter)
    profiles = spark.createDataFrame([(p, 12.0, [12.0, 6.0]) for p in ("box", "stroke", "pier", "letter")], "plan_id string, major double, modes array<double>")
    got = {(r.plan_id, r.wall_id): r for r in structure.assessed(spark.createDataFrame(rows, WALLS), profiles).collect()}
    assert len(got) == len(rows)
    fates = {p: [got[p, w].fate for q, w, *_ in rows if q == p] for p in ("box", "stroke", "pier", "letter")}
    assert fates == {"box": ["kept"] * 5, "stroke": ["kept"] * 5 + ["removed"] * 5, "pier": ["kept"] * 5 + ["doubtful"], "letter": ["kept"] * 5 + ["removed"] * 3}
    assert got["box", "w04"].connectivity == 1 and got["pier", "w05"].cluster < 0.1 and got["pier", "w05"].confidence <= 0.9


def brute_contacts(rows):
    out = set()
    for p, n, a, b, t, _ in rows:
        for key, e in enumerate((a, b)):
            for q, m, c, d, u, _ in rows:
                length = math.dist(c, d)
                if q == p and m != n and length:
                    dx, dz = (d[0] - c[0]) / length, (d[1] - c[1]) / length
                    vx, vz = e[0] - c[0], e[1] - c[1]
                    if abs(vx * dz - vz * dx) <= u / 2 + t / 2 + 2 and -u <= vx * dx + vz * dz <= length + u:
                        out.add((p, n, key, m))
    return out


def scattered(seed, n=60):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, z, long, t = r.uniform(0, 900), r.uniform(0, 900), r.uniform(20, 300), r.choice([6, 8, 12])
        w = r.choice([0, 0, math.pi / 2, math.pi / 2, r.uniform(0, 3)])
        if i % 3 == 0 and rows:  # ahead of the one before, on its line
            _, _, a, b, t, _ = rows[-1]
            long0 = math.dist(a, b)
            d = ((b[0] - a[0]) / long0, (b[1] - a[1]) / long0)
            gap = r.uniform(0, 250)
            x, z, w, t = b[0] + d[0] * gap, b[1] + d[1] * gap, math.atan2(d[1], d[0]) + r.uniform(-0.02, 0.02), t * r.choice([1, 1.2, 1.5])
        rows.append((str(seed), f"{i:03}", (x, z), (x + long * math.cos(w), z + long * math.sin(w)), float(t), 0.9))
    return rows


def test_contacts_equal_brute_force(spark):
    rows = scattered(1, 90) + scattered(2, 90)
    got = {tuple(r) for r in structure.contacts(spark.createDataFrame(rows, WALLS)).collect()}
    assert got == brute_contacts(rows) and len(got) > 40


def brute_gaps(rows, major):
    out = set()
    geo = {n: (a, b, math.dist(a, b), ((b[0] - a[0]) / math.dist(a, b), (b[1] - a[1]) / math.dist(a, b)), t) for _, n, a, b, t, _ in rows}
    reach = 30 * major

    def one_line(p, q):
        tol = min(math.radians(8), max(math.radians(3), math.atan(3 / max(1, min(p[2], q[2])))))
        if abs(p[3][0] * q[3][0] + p[3][1] * q[3][1]) < math.cos(tol):
            return False
        pts = [p[0], p[1], q[0], q[1]]
        c = (sum(x for x, _ in pts) / 4, sum(z for _, z in pts) / 4)
        off = [(x - c[0], z - c[1]) for x, z in pts]
        th = 0.5 * math.atan2(2 * sum(x * z for x, z in off), sum(x * x for x, _ in off) - sum(z * z for _, z in off))
        return max(abs(z * math.cos(th) - x * math.sin(th)) for x, z in off) <= max(1.5, 0.2 * min(p[4], q[4]))

    def crossed(p, s, o):
        a, _, long, d, t = o
        lo, hi = -math.inf, math.inf
        v = (p[0] - a[0], p[1] - a[1])
        for at, speed, low, high in ((v[0] * d[0] + v[1] * d[1], s[0] * d[0] + s[1] * d[1], -1, long + 1), (d[0] * v[1] - d[1] * v[0], d[0] * s[1] - d[1] * s[0], -t / 2 - 1.5, t / 2 + 1.5)):
            if abs(speed) < 1e-12:
                if not low <= at <= high:
                    return None
            else:
                lo, hi = max(lo, min((low - at) / speed, (high - at) / speed)), min(hi, max((low - at) / speed, (high - at) / speed))
        return (lo, hi) if hi >= lo else None

    for n, w in geo.items():
        for end in (0, 1):
            sign, tip = (-1, 0.0) if end == 0 else (1, w[2])
            p, s = (w[0][0] + w[3][0] * tip, w[0][1] + w[3][1] * tip), (w[3][0] * sign, w[3][1] * sign)
            partners, hits, spans = [], [], {}
            for m, o in geo.items():
                if m == n:
                    continue
                t = [(e[0] - w[0][0]) * w[3][0] + (e[1] - w[0][1]) * w[3][1] for e in o[:2]]
                line = ((min(t) if sign > 0 else max(t)) - tip) * sign
                if max(w[4], o[4]) / min(w[4], o[4]) <= 1.35 and 1 < line <= reach and one_line(w, o):
                    partners.append((line, m))
                if (c := crossed(p, s, o)) and c[1] >= 0:
                    spans[m] = c
                    hits.append((max(c[0], 0.0), m))
            if partners:
                far, m, kind = *min(partners), "collinear"
            elif hits and 2 < min(hits)[0] <= reach and abs(w[3][0] * geo[min(hits)[1]][3][0] + w[3][1] * geo[min(hits)[1]][3][1]) <= 0.5:
                far, m, kind = *min(hits), "to-wall"
            else:
                continue
            filled, at = 0.0, 0.0
            for lo, hi in sorted((max(lo, 0), min(hi, far)) for k, (lo, hi) in spans.items() if k != m and hi > max(lo, 0) and lo < far):
                filled += max(0.0, hi - max(lo, at))
                at = max(at, hi)
            if filled <= 0.3 * far:
                out.add((n, end, kind, m, round(far, 5)))
    return {g for g in out if g[2] != "collinear" or g[0] < g[3] or not any(h[2] == "collinear" and h[0] == g[3] and h[3] == g[0] for h in out)}


def test_gaps_equal_brute_force(spark):
    rows = [r for seed in (3, 4, 5) for r in scattered(seed, 70)]
    profiles = spark.createDataFrame([(str(s), 8.0) for s in (3, 4, 5)], "plan_id string, major double")
    got = gaps.found(spark.createDataFrame(rows, WALLS), profiles).collect()
    for seed in (3, 4, 5):
        want = brute_gaps([r for r in rows if r[0] == str(seed)], 8.0)
        assert {(r.wall_id, r.end, r.kind, r.other_id, round(r.stop - r.start, 5)) for r in got if r.plan_id == str(seed)} == want
    kinds = [r.kind for r in got]
    assert kinds.count("collinear") > 3 and kinds.count("to-wall") > 10


def test_suppression_is_the_greedy_one(spark):
    r = random.Random(6)
    spans = [(w, i, x := round(r.uniform(0, 100), 2), x + r.choice([0.5, 3, 40]), r.choice([0.2, 0.5, 0.5, 0.9])) for w in "ab" for i in range(80)]
    want = set()
    for w in "ab":
        kept = []
        for s in sorted((s for s in spans if s[0] == w), key=lambda s: (-s[4], s[1])):
            if not any(min(s[3], k[3]) - max(s[2], k[2]) > 0 for k in kept):
                kept.append(s)
        want |= {(s[0], s[1]) for s in kept}
    d = spark.createDataFrame(spans, "wall string, ord long, start double, stop double, strength double")
    assert {(r.wall, r.ord) for r in structure.strongest_spans(d, ["wall"], "start", "stop", "strength", "ord").collect()} == want


@pytest.mark.parametrize("n", [30_000])
def test_components_of_a_very_long_chain(spark, n):
    e = spark.range(n).select(((F.col("id") * 7919) % n).alias("u"), ((F.col("id") * 7919 + 7919) % n).alias("v")).where(f"u <> {n - 7919}")
    got = spatial.components(e.unionByName(spark.createDataFrame([(n + 5, n + 5)], "u long, v long"))).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {0: n, n + 5: 1}


def brute_closures(rows, major):
    geo = {n: (a, b, math.dist(a, b), ((b[0] - a[0]) / math.dist(a, b), (b[1] - a[1]) / math.dist(a, b)), t) for _, n, a, b, t, _ in rows}
    touched = {(n, k) for _, n, k, _ in brute_contacts(rows)}
    free = [(n, k, w[k], (w[3][0] * (2 * k - 1), w[3][1] * (2 * k - 1))) for n, w in sorted(geo.items()) for k in (0, 1) if (n, k) not in touched]
    reach = 12 * major

    def within(p, s, o, beside):
        a, _, long, d, t = o
        lo, hi = -math.inf, math.inf
        v = (p[0] - a[0], p[1] - a[1])
        for at, speed, low, high in ((v[0] * d[0] + v[1] * d[1], s[0] * d[0] + s[1] * d[1], 0, long), (d[0] * v[1] - d[1] * v[0], d[0] * s[1] - d[1] * s[0], -t / 2 - beside, t / 2 + beside)):
            if abs(speed) < 1e-12:
                if not low <= at <= high:
                    return None
            else:
                lo, hi = max(lo, min((low - at) / speed, (high - at) / speed)), min(hi, max((low - at) / speed, (high - at) / speed))
        return (lo, hi) if hi >= lo else None

    def clear(p, q, pad):
        far = math.dist(p, q)
        s = ((q[0] - p[0]) / far, (q[1] - p[1]) / far)
        return not any((c := within(p, s, o, 0)) and min(c[1], far - pad) > max(c[0], pad) for o in geo.values())

    out, done = set(), set()
    for n, k, p, d in free:
        if (n, k) in done:
            continue
        options = []
        for m, j, q, _ in free:
            far = math.dist(p, q)
            if m == n or not 2 <= far <= reach:
                continue
            v = (q[0] - p[0], q[1] - p[1])
            ahead = v[0] * d[0] + v[1] * d[1]
            if ahead / far >= math.cos(math.radians(15)) or (min(abs(v[0]), abs(v[1])) / far <= math.sin(math.radians(10)) and ahead > -0.2 * far):
                if clear(p, q, max(geo[n][4], geo[m][4])):
                    options.append((far, False, m, j))
        hits = sorted((max(2.0, c[0]), m) for m, o in geo.items() if m != n and (c := within(p, d, o, 0.5)) and c[1] >= 2 and c[0] <= reach)
        if hits and abs(geo[hits[0][1]][3][0] * d[0] + geo[hits[0][1]][3][1] * d[1]) <= 0.9:
            far = hits[0][0]
            if clear(p, (p[0] + d[0] * far, p[1] + d[1] * far), geo[n][4]):
                options.append((far, True, hits[0][1], None))
        if options:
            far, side, m, j = min(options, key=lambda x: x[:3])
            out.add((n, k, m, j, round(far, 5)))
            if not side:
                done.add((m, j))
    return out


def test_closures_equal_brute_force(spark):
    rows = [r for seed in (7, 8, 9) for r in scattered(seed, 45)]
    profiles = spark.createDataFrame([(str(s), 14.0) for s in (7, 8, 9)], "plan_id string, major double")
    got = gaps.closures(spark.createDataFrame(rows, WALLS), profiles).collect()
    for seed in (7, 8, 9):
        want = brute_closures([r for r in rows if r[0] == str(seed)], 14.0)
        assert {(r.wall_id, r.key, r.to_wall, r.to_key, round(r.length, 5)) for r in got if r.plan_id == str(seed)} == want
    assert sum(r.to_key is not None for r in got) > 5 and sum(r.to_key is None for r in got) > 5
