"""Planar geometry on vertex arrays: array<struct<x double, y double>>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


RING = "array<struct<x:double,y:double>>"


def turned(ring: Column) -> Column:
    """The ring begun at its second vertex."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def once(value: Column, use) -> Column:
    """use(value), with the value worked out once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def edges(ring: Column) -> Column:
    return once(ring, lambda r: F.zip_with(r, turned(r), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def signed_area(ring: Column) -> Column:
    """Shoelace area, negative for a clockwise ring; from the first vertex, so that far coordinates lose no digits."""
    cross = lambda o, e: (e["a"]["x"] - o["x"]) * (e["b"]["y"] - o["y"]) - (e["b"]["x"] - o["x"]) * (e["a"]["y"] - o["y"])
    return once(ring, lambda r: F.aggregate(edges(r), F.lit(0.0), lambda s, e: s + cross(F.try_element_at(r, F.lit(1)), e)) / 2)


def anticlockwise(ring: Column) -> Column:
    return once(ring, lambda r: F.when(signed_area(r) < 0, F.reverse(r)).otherwise(r))


def half_plane(ring: Column, side) -> Column:
    """The part of a ring where side(x, y), linear, is not negative (by Sutherland and Hodgman, one border)."""

    def step(a, b):
        s, t = side(a["x"], a["y"]), side(b["x"], b["y"])
        u = F.try_divide(s, s - t)
        met = F.struct((a["x"] + (b["x"] - a["x"]) * u).alias("x"), (a["y"] + (b["y"] - a["y"]) * u).alias("y"))
        return F.array(F.when((s < 0) & (t > 0) | (s > 0) & (t < 0), met), F.when(t >= 0, b))

    return F.filter(F.flatten(F.zip_with(ring, turned(ring), step)), lambda v: v.isNotNull())


def within_box(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The part of a ring within an upright box.  The ring stands in the expression once, its borders in a list."""
    border = lambda ux, uy, c: F.struct(F.lit(ux).alias("ux"), F.lit(uy).alias("uy"), c.alias("c"))
    sides = F.array(border(1.0, 0.0, -x0), border(-1.0, 0.0, x1), border(0.0, 1.0, -y0), border(0.0, -1.0, y1))
    return F.aggregate(sides, ring.cast(RING), lambda part, h: half_plane(part, lambda x, y: h["ux"] * x + h["uy"] * y + h["c"]).cast(RING))


def _rising(ring: Column, origin: Column) -> Column:
    """A ring's edges from left to right about an origin: ends, slope m, and w = 1 where the ring runs so, else -1.  Upright
    edges lie over nothing and are left out; so are edges without numbers."""

    def one(e):
        x0, y0, x1, y1 = (e[p][c] - origin[c] for p, c in (("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")))
        made = lambda x0, y0, x1, y1, w: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), F.try_divide(y1 - y0, x1 - x0).alias("m"), F.lit(w).alias("w"))
        return F.when(e["a"]["x"] < e["b"]["x"], made(x0, y0, x1, y1, 1.0)).when(e["a"]["x"] > e["b"]["x"], made(x1, y1, x0, y0, -1.0))

    return F.filter(F.transform(edges(ring), one), lambda e: e["m"].isNotNull())


def _under_both(e: Column, f: Column) -> Column:
    """Integral of the lower one of two rising edges where both have x, 0 where they don't meet in x."""
    height = lambda g, x: g["y0"] + g["m"] * (x - g["x0"])
    ends = F.struct(F.greatest(e["x0"], f["x0"]).alias("lo"), F.least(e["x1"], f["x1"]).alias("hi"))

    def over(s):
        f0, f1 = height(f, s["lo"]), height(f, s["hi"])
        d = F.struct((s["hi"] - s["lo"]).alias("w"), (f0 + f1).alias("f"), (height(e, s["lo"]) - f0).alias("a"), (height(e, s["hi"]) - f1).alias("b"))
        # how far e runs below f: everywhere, nowhere, or on one side of their crossing
        low = lambda d: F.least(d["a"], d["b"])
        below = lambda d: F.when((d["a"] <= 0) & (d["b"] <= 0), d["a"] + d["b"]).when((d["a"] >= 0) & (d["b"] >= 0), 0.0).otherwise(-low(d) * low(d) / (F.abs(d["a"]) + F.abs(d["b"])))
        return once(d, lambda d: d["w"] * (d["f"] + below(d)) / 2)

    return once(ends, lambda s: F.when(s["lo"] < s["hi"], over(s)).otherwise(0.0))


def intersection_area(a: Column, b: Column) -> Column:
    """Area that two simple rings share, convex or not: what lies under an edge of each, pair by pair, by the edges' directions.
    Of null rings null; of rings without area 0."""
    first = lambda r: F.try_element_at(r, F.lit(1))

    def whole(origin):
        total = lambda others: F.aggregate(_rising(a, origin), F.lit(0.0), lambda s, e: s + e["w"] * F.aggregate(others, F.lit(0.0), lambda r, f: r + f["w"] * _under_both(e, f)))
        return once(_rising(b, origin), total)

    area_of = F.abs(once(first(a), whole) * F.signum(signed_area(a)) * F.signum(signed_area(b)))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(area_of, F.lit(0.0)))


def area(ring: Column) -> Column:
    """Shoelace area."""
    return F.abs(signed_area(ring))


def valid(ring: Column) -> Column:
    """Three vertices and some area at least."""
    return F.coalesce((F.size(ring) >= 3) & (area(ring) > 0), F.lit(False))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting; points on an edge may fall either way."""
    return within_edges(edges(ring), x, y)


def within_edges(sides: Column, x: Column, y: Column) -> Column:
    def crosses(e):
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"]
        return (spans & (x < at)).cast("int")

    return F.aggregate(sides, F.lit(0), lambda s, e: s + F.coalesce(crosses(e), F.lit(0))) % 2 == 1


def held(both, ring: str = "ring", x: str = "x", y: str = "y"):
    """The rows of a frame whose ring contains their point.  By a generator: as a filter the test would become part of the
    join before it, whose generated code can't bind both sides within a lambda."""
    return both.withColumn("_held", F.explode(F.filter(F.array(contains(F.col(ring), F.col(x), F.col(y))), lambda h: h))).drop("_held")


def closed(ring: Column, gap: float = 0.001) -> Column:
    """First and last vertex within gap of each other."""
    a, b = F.element_at(ring, 1), F.element_at(ring, -1)
    return (a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 <= gap * gap


def circle(x: Column, y: Column, r: Column, sides: int = 64) -> Column:
    turn = lambda i: i * F.lit(2 * math.pi / sides)
    return F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), lambda i: F.struct((x + r * F.cos(turn(i))).alias("x"), (y + r * F.sin(turn(i))).alias("y")))


def segment_distance(px: Column, py: Column, e: Column) -> Column:
    dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - e["a"]["x"]) * dx + (py - e["a"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
    return F.sqrt((px - e["a"]["x"] - t * dx) ** 2 + (py - e["a"]["y"] - t * dy) ** 2)


def distance(a: Column, b: Column) -> Column:
    """Between two disjoint rings: the least vertex-to-edge distance either way."""
    one = lambda p, q: once(edges(q), lambda sides: F.array_min(F.transform(p, lambda v: F.array_min(F.transform(sides, lambda e: segment_distance(v["x"], v["y"], e))))))
    return F.least(one(a, b), one(b, a))


def _side(a: Column, b: Column, p: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))


def _crosses(e: Column, f: Column) -> Column:
    """Whether two edges have a point in common."""
    within = lambda g, p: p["x"].between(F.least(g["a"]["x"], g["b"]["x"]), F.greatest(g["a"]["x"], g["b"]["x"])) & p["y"].between(F.least(g["a"]["y"], g["b"]["y"]), F.greatest(g["a"]["y"], g["b"]["y"]))
    s, t, u, v = _side(e["a"], e["b"], f["a"]), _side(e["a"], e["b"], f["b"]), _side(f["a"], f["b"], e["a"]), _side(f["a"], f["b"], e["b"])
    on = (s == 0) & within(e, f["a"]) | (t == 0) & within(e, f["b"]) | (u == 0) & within(f, e["a"]) | (v == 0) & within(f, e["b"])
    return (s * t < 0) & (u * v < 0) | on


def convex(sides: Column) -> Column:
    """Whether a ring, given by its edges, lies on one side of each of them and visits no vertex twice."""
    own = F.filter(sides, lambda e: (e["a"]["x"] != e["b"]["x"]) | (e["a"]["y"] != e["b"]["y"]))
    turns = lambda e: F.flatten(F.transform(e, lambda f: F.transform(e, lambda g: _side(f["a"], f["b"], g["a"]))))
    one_side = lambda e: once(turns(e), lambda t: F.forall(t, lambda v: v >= 0) | F.forall(t, lambda v: v <= 0))
    return once(own, lambda e: one_side(e) & (F.size(F.array_distinct(F.transform(e, lambda f: f["a"]))) == F.size(e)))


def simple(ring: Column) -> Column:
    """Whether no two edges of a ring have more in common than a vertex between neighbours."""
    own = F.filter(edges(ring), lambda x: (x["a"]["x"] != x["b"]["x"]) | (x["a"]["y"] != x["b"]["y"]))
    return once(own, _apart)


def _apart(e: Column) -> Column:
    n = F.size(e)
    back = lambda x, y: (_side(x["a"], x["b"], y["b"]) == 0) & ((x["b"]["x"] - x["a"]["x"]) * (y["b"]["x"] - y["a"]["x"]) + (x["b"]["y"] - x["a"]["y"]) * (y["b"]["y"] - y["a"]["y"]) < 0)
    nexts = F.concat(F.slice(e, 2, F.greatest(n - 1, F.lit(0))), F.slice(e, 1, 1))
    folds = F.exists(F.zip_with(e, nexts, back), lambda b: b)
    apart = lambda i, j: (j > i + 1) & ~((i == 0) & (j == n - 1))
    crossing = F.exists(F.transform(e, lambda x, i: F.exists(F.transform(e, lambda y, j: apart(i, j) & _crosses(x, y)), lambda b: b)), lambda b: b)
    return ~(folds | crossing)


def meets(a: Column, b: Column) -> Column:
    """Whether two rings (or lines, given as rings of two vertices) touch, cross or hold one another."""
    cross = once(edges(b), lambda other: F.exists(edges(a), lambda e: F.exists(other, lambda f: _crosses(e, f))))
    first = lambda r: F.try_element_at(r, F.lit(1))
    return cross | contains(a, first(b)["x"], first(b)["y"]) | contains(b, first(a)["x"], first(a)["y"])


def gap(a: Column, b: Column) -> Column:
    """Distance between two rings or lines wherever they lie: 0 where they meet."""
    return F.when(meets(a, b), 0.0).otherwise(distance(a, b))


def overhang(ring: Column, around: Column, step: float = 0.05) -> Column:
    """How far a ring reaches out of another one: exact where the other is convex; else the largest distance to it of points
    on the ring's edges, at most step apart, that lie outside: what lies between two points adds at most step / 2."""

    def along(e):
        n = F.greatest(F.ceil(F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]) / step), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * i / n).alias("x"), (e["a"]["y"] + (e["b"]["y"] - e["a"]["y"]) * i / n).alias("y")))

    far = lambda sides, p: F.when(within_edges(sides, p["x"], p["y"]), 0.0).otherwise(F.array_min(F.transform(sides, lambda e: segment_distance(p["x"], p["y"], e))))
    # the distance to a convex ring is largest at a vertex; another ring may bend inwards, so points between them count too
    points = lambda sides: F.when(convex(sides), ring.cast(RING)).otherwise(F.flatten(F.transform(edges(ring), along)).cast(RING))
    return once(edges(around), lambda sides: F.array_max(F.transform(points(sides), lambda p: far(sides, p))))


def box_overlap(a: Column, b: Column) -> Column:
    """Intersection area of two axis-aligned boxes struct<x0, y0, x1, y1>."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
