"""Overlays and intersections of rings against plain Python on slabs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import geometry as G
from gaugeline.operators import overlay

RING = "array<struct<x:double,y:double>>"


def star(rng, cx, cy, r, n):
    """A simple ring around (cx, cy), seldom convex, in either direction."""
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(cx + r * rng.uniform(0.3, 1) * math.cos(t), cy + r * rng.uniform(0.3, 1) * math.sin(t)) for t in turns]
    return ring if rng.random() < 0.5 else ring[::-1]


def simple(ring):
    def turn(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    e = list(zip(ring, ring[1:] + ring[:1], strict=True))
    for i in range(len(e)):
        for j in range(i + 2, len(e)):
            if (i, j) != (0, len(e) - 1) and turn(*e[i], e[j][0]) * turn(*e[i], e[j][1]) < 0 and turn(*e[j], e[i][0]) * turn(*e[j], e[i][1]) < 0:
                return False
    return len(ring) >= 3


def inside_area(ring, lo, hi):
    """Sorted heights at which a ring's edges cross the middle of a slab."""
    x = (lo + hi) / 2
    return sorted(a[1] + (b[1] - a[1]) * (x - a[0]) / (b[0] - a[0]) for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if min(a[0], b[0]) <= lo and max(a[0], b[0]) >= hi and a[0] != b[0])


def measure(rings, weight):
    """Integral of weight({layer: count}) over the plane for (layer, ring) rows."""
    edges = [(a, b) if a[0] < b[0] else (b, a) for _, r in rings for a, b in zip(r, r[1:] + r[:1], strict=True) if a[0] != b[0]]
    xs = {v[0] for e in edges for v in e}
    for i, (a, b) in enumerate(edges):
        for c, d in edges[:i]:
            s, t = (b[1] - a[1]) / (b[0] - a[0]), (d[1] - c[1]) / (d[0] - c[0])
            if s != t:
                x = ((c[1] - t * c[0]) - (a[1] - s * a[0])) / (s - t)
                if max(a[0], c[0]) < x < min(b[0], d[0]):
                    xs.add(x)
    xs, total = sorted(xs), 0.0
    for lo, hi in zip(xs, xs[1:], strict=False):
        at = []
        for layer, r in rings:
            ys = inside_area(r, lo, hi)
            at += [(y, layer, 1 if k % 2 == 0 else -1) for k, y in enumerate(ys)]
        at.sort()
        n = {}
        for (y, layer, step), nxt in zip(at, at[1:], strict=False):
            n[layer] = n.get(layer, 0) + step
            total += (nxt[0] - y) * (hi - lo) * weight(n)
    return total


def some_rings(seed, many, spread, most=9):
    rng, out = random.Random(seed), []
    while len(out) < many:
        ring = star(rng, rng.uniform(0, spread), rng.uniform(0, spread), rng.uniform(1, 6), rng.randint(3, most))
        if simple(ring):
            out.append((rng.choice("ab"), ring))
    return out


@pytest.mark.parametrize("side", [None, 3.0])
def test_overlay_areas(spark, monkeypatch, side):
    monkeypatch.setattr(overlay, "CROWD", 12)
    monkeypatch.setattr(overlay, "AT_ONCE", 4)
    drawings = {1: some_rings(1, 25, 20), 2: some_rings(2, 3, 500), 3: some_rings(3, 40, 4), 4: [("a", [(0, 0), (40, 0), (40, 40), (0, 40)])] * 3 + some_rings(4, 12, 40)}
    rows = [(d, layer, [{"x": float(x), "y": float(y)} for x, y in r]) for d, rings in drawings.items() for layer, r in rings]
    rows += [(1, "a", None), (1, "b", []), (5, "a", [{"x": 1.0, "y": 1.0}, {"x": 2.0, "y": 2.0}, {"x": 3.0, "y": 3.0}])]
    df = spark.createDataFrame(rows, f"drawing long, layer string, ring {RING}").repartition(4)
    a, b = F.col("n_a"), F.col("n_b")
    got = overlay.covered(df, {"either": (a > 0) | (b > 0), "both": (a > 0) & (b > 0), "only_a": (a > 0) & (b == 0), "pairs": a * (a - 1) / 2}, ["a", "b"], side)
    have = {r.drawing: r for r in got.collect()}
    assert sorted(have) == [1, 2, 3, 4]
    for d, rings in drawings.items():
        n = lambda c, k: c.get(k, 0)
        want = (
            measure(rings, lambda c: n(c, "a") > 0 or n(c, "b") > 0), measure(rings, lambda c: n(c, "a") > 0 and n(c, "b") > 0),
            measure(rings, lambda c: n(c, "a") > 0 and n(c, "b") == 0), measure(rings, lambda c: n(c, "a") * (n(c, "a") - 1) / 2),
        )
        assert tuple(have[d][k] for k in ("either", "both", "only_a", "pairs")) == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_intersection_area_of_any_two_rings(spark):
    rings = some_rings(7, 60, 9)
    pairs = [(i, [{"x": x, "y": y} for x, y in rings[i][1]], [{"x": x, "y": y} for x, y in rings[i + 1][1]]) for i in range(59)]
    df = spark.createDataFrame([*pairs, (99, None, pairs[0][1]), (100, [], pairs[0][1])], f"i int, p {RING}, q {RING}")
    got = {r.i: r.s for r in df.select("i", G.intersection_area(F.col("p"), F.col("q")).alias("s")).collect()}
    for i in range(59):
        want = measure([("p", rings[i][1]), ("q", rings[i + 1][1])], lambda c: c.get("p", 0) > 0 and c.get("q", 0) > 0)
        assert got[i] == pytest.approx(want, abs=1e-6)
    assert got[99] is None and not got[100]


def greedy(inserts, polygons):
    """In the order of inserts: the first free polygon around the point, else the free one with the nearest centre."""
    rows = []
    for drawing in {d for d, *_ in inserts}:
        free = sorted((p, ring) for d, p, ring in polygons if d == drawing)
        for _, i, x, y in sorted(r for r in inserts if r[0] == drawing):
            around = [k for k, (_, (x0, y0, x1, y1)) in enumerate(free) if x0 < x < x1 and y0 < y < y1]
            far = [((x0 + x1) / 2 - x) ** 2 + ((y0 + y1) / 2 - y) ** 2 for _, (x0, y0, x1, y1) in free]
            if free:
                k = around[0] if around else far.index(min(far))
                rows.append((drawing, i, free.pop(k)[0], bool(around)))
    return sorted(rows)


def test_blocks_to_polygons_is_greedy(spark):
    from gaugeline.operators.matching import blocks_to_polygons

    rng = random.Random(21)
    inserts, polygons = [], []
    for d in range(12):
        spread = rng.choice([6, 30, 300])
        for p in range(rng.randint(0, 25)):
            x, y = rng.randrange(spread), rng.randrange(spread)
            polygons.append((d, 100 - p, (x, y, x + rng.randint(1, 8), y + rng.randint(1, 8))))
        same = rng.random() < 0.3
        for i in range(rng.randint(1, 14)):
            x, y = (spread / 2, spread / 2) if same else (rng.randrange(spread), rng.randrange(spread))
            inserts.append((d, i, x + 0.37, y + 0.21))
    inserts.append((99, 1, 0.0, 0.0))  # a drawing without polygons
    ring = lambda b: [{"x": float(x), "y": float(y)} for x, y in ((b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3]))]
    ins = spark.createDataFrame([(d, i, float(x), float(y)) for d, i, x, y in inserts], "drawing long, insert long, x double, y double")
    pol = spark.createDataFrame([(d, p, ring(b)) for d, p, b in polygons], f"drawing long, polygon long, ring {RING}")
    assert sorted(tuple(r) for r in blocks_to_polygons(ins.repartition(3), pol.repartition(3)).collect()) == greedy(inserts, polygons)
    assert blocks_to_polygons(ins.where("1 = 0"), pol).count() == 0


def test_gap_and_overhang(spark):
    rng = random.Random(31)
    rings = [r for _, r in some_rings(31, 40, 14)]
    as_row = lambda r: [{"x": float(x), "y": float(y)} for x, y in r]
    df = spark.createDataFrame([(i, as_row(rings[i]), as_row(rings[i + 1])) for i in range(39)], f"i int, p {RING}, q {RING}")
    got = {r.i: (r.g, r.o, r.s) for r in df.select("i", G.gap(F.col("p"), F.col("q")).alias("g"), G.overhang(F.col("p"), F.col("q")).alias("o"), G.intersection_area(F.col("p"), F.col("q")).alias("s")).collect()}

    def inside(ring, x, y):
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1

    def to_ring(ring, x, y):
        best = math.inf
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            n = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
            t = max(0, min(1, ((x - a[0]) * (b[0] - a[0]) + (y - a[1]) * (b[1] - a[1])) / n)) if n else 0
            best = min(best, math.hypot(x - a[0] - t * (b[0] - a[0]), y - a[1] - t * (b[1] - a[1])))
        return best

    for i in range(39):
        p, q = rings[i], rings[i + 1]
        dense = [(a[0] + (b[0] - a[0]) * t / 400, a[1] + (b[1] - a[1]) * t / 400) for a, b in zip(p, p[1:] + p[:1], strict=True) for t in range(400)]
        assert got[i][1] == pytest.approx(max(0 if inside(q, *v) else to_ring(q, *v) for v in dense), abs=0.03)
        assert (got[i][0] == 0) == (got[i][2] > 1e-9)
        if got[i][0]:
            assert got[i][0] == pytest.approx(min(to_ring(q, *v) for v in dense), abs=0.03)


def test_repaired_rings(spark):
    rng = random.Random(41)
    rings = [(i, [(rng.randrange(8), rng.randrange(8)) for _ in range(rng.randint(3, 7))]) for i in range(60)]
    rings += [(i + 100, r) for i, (_, r) in enumerate(some_rings(42, 20, 9))]
    df = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in r]) for i, r in rings], f"id long, ring {RING}")
    got = {r.id: r for r in overlay.repaired(df).collect()}

    def winding_area(ring):
        """Where the ring winds around, slab by slab."""
        e = [(a, b, 1) if a[0] < b[0] else (b, a, -1) for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if a[0] != b[0]]
        xs = {p[0] for p in ring}
        for i, (a, b, _) in enumerate(e):
            for c, d, _ in e[:i]:
                s, t = (b[1] - a[1]) / (b[0] - a[0]), (d[1] - c[1]) / (d[0] - c[0])
                if s != t:
                    x = ((c[1] - t * c[0]) - (a[1] - s * a[0])) / (s - t)
                    if max(a[0], c[0]) < x < min(b[0], d[0]):
                        xs.add(x)
        xs, total = sorted(xs), 0.0
        for lo, hi in zip(xs, xs[1:], strict=False):
            m = (lo + hi) / 2
            at, n = sorted((a[1] + (b[1] - a[1]) * (m - a[0]) / (b[0] - a[0]), w) for a, b, w in e if a[0] <= lo and b[0] >= hi), 0
            for (y, w), (z, _) in zip(at, at[1:], strict=False):
                n += w
                total += (z - y) * (hi - lo) * (n != 0)
        return total

    for i, ring in rings:
        want = winding_area(ring)
        if i >= 100:
            assert len(got[i].parts) == 1
        if want < 1e-9:
            assert i not in got
        else:
            assert got[i].area == pytest.approx(want)
            parts = [[(v.x, v.y) for v in p] for p in got[i].parts]
            assert sum(abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True))) / 2 for p in parts) == pytest.approx(want)
