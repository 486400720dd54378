"""Areas of plots, buildings and public spaces whose sides run in any direction, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions.text import percent_delta
from gaugeline.operators import geometry as G
from gaugeline.operators import overlay
from gaugeline.plans.registry import query
from gaugeline.sources.tables import spread, table

#: Up to this area (of square metres) gaps and overlaps are noise of the drawing; areas that equal it, but for rounding, too.
NOISE = 0.500001

#: Added before rounding: areas of whole coordinates would often lie between two roundings.
NUDGE = 0.0000137

#: Each part is a ring: a turned rectangle, a triangle or a dart, twelve on a drawing.
RINGS_SQL = """d AS (SELECT p_partkey AS id, p_partkey // 12 AS drawing, p_partkey * 7 % 23 AS cx, p_partkey * 5 % 17 AS cy, 1.0 + p_size % 5 AS w, 1.0 + p_size % 4 AS h FROM part),
rings AS (SELECT id, drawing, CASE id % 3
 WHEN 0 THEN [{'x': cx + 0.8 * w + 0.6 * h, 'y': cy + 0.6 * w - 0.8 * h}, {'x': cx + 0.8 * w - 0.6 * h, 'y': cy + 0.6 * w + 0.8 * h}, {'x': cx - 0.8 * w - 0.6 * h, 'y': cy - 0.6 * w + 0.8 * h}, {'x': cx - 0.8 * w + 0.6 * h, 'y': cy - 0.6 * w - 0.8 * h}]
 WHEN 1 THEN [{'x': cx - w, 'y': cy - h}, {'x': cx + 0.25 * w, 'y': cy + h}, {'x': cx + w, 'y': cy - 0.5 * h}]
 ELSE [{'x': cx - w, 'y': cy - h}, {'x': cx + w, 'y': cy - 0.75 * h}, {'x': cx + 0.125 * w, 'y': cy + h}, {'x': cx - 0.25 * w, 'y': cy + 0.125 * h}] END AS ring FROM d)"""
ENVELOPE = [(17.0, 14.5), (-1.5, 9.0), (4.0, 0.25), (21.0, 3.0)]


def slabs_sql(rings: str) -> str:
    """Oracle: strips(drawing, area, p, q) of the plane from rings(drawing, layer, ring), all edges of a drawing at once."""
    return f"""r AS ({rings}),
e0 AS (SELECT drawing, layer, ring, unnest(ring) AS a, unnest(list_concat(ring[2:], ring[1:1])) AS b FROM r),
e AS (SELECT drawing, layer, least(a.x, b.x) AS ax, CASE WHEN a.x < b.x THEN a.y ELSE b.y END AS ay, greatest(a.x, b.x) AS bx, CASE WHEN a.x < b.x THEN b.y ELSE a.y END AS zy,
 CASE WHEN (a.x < b.x) = (list_sum(list_transform(range(1, len(ring) + 1), lambda i: ring[i].x * ring[i % len(ring) + 1].y - ring[i % len(ring) + 1].x * ring[i].y)) > 0) THEN 1 ELSE -1 END AS s FROM e0 WHERE a.x <> b.x),
x AS (SELECT p.drawing, greatest(p.ax, q.ax) AS lo, least(p.bx, q.bx) AS hi, ((q.ay - (q.zy - q.ay) / (q.bx - q.ax) * q.ax) - (p.ay - (p.zy - p.ay) / (p.bx - p.ax) * p.ax)) / nullif((p.zy - p.ay) / (p.bx - p.ax) - (q.zy - q.ay) / (q.bx - q.ax), 0) AS x
 FROM e p JOIN e q ON p.drawing = q.drawing AND p.ax < q.bx AND q.ax < p.bx AND (p.ax, p.ay, p.bx, p.zy) < (q.ax, q.ay, q.bx, q.zy)),
cuts AS (SELECT drawing, ax AS x FROM e UNION SELECT drawing, bx FROM e UNION SELECT drawing, x FROM x WHERE x > lo AND x < hi),
slabs AS (SELECT drawing, x, lead(x) OVER (PARTITION BY drawing ORDER BY x) AS t FROM cuts),
spans AS (SELECT e.drawing, slabs.x, t - slabs.x AS width, layer, s, ay + (zy - ay) * ((slabs.x + t) / 2 - ax) / (bx - ax) AS y FROM e JOIN slabs ON slabs.drawing = e.drawing AND ax <= slabs.x AND bx >= t),
strips AS (SELECT drawing, (lead(y) OVER w - y) * width AS area, sum(CASE WHEN layer = 'p' THEN s ELSE 0 END) OVER w AS p, sum(CASE WHEN layer = 'q' THEN s ELSE 0 END) OVER w AS q FROM spans WINDOW w AS (PARTITION BY drawing, x ORDER BY y, layer, s ROWS UNBOUNDED PRECEDING))"""


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring() -> Column:
    """The ring of a part, by p_partkey and p_size."""
    k = F.col("p_partkey")
    cx, cy, w, h = k * 7 % 23, k * 5 % 17, 1.0 + F.col("p_size") % 5, 1.0 + F.col("p_size") % 4
    turned = F.array(*(point(cx + i * 0.8 * w - j * 0.6 * h, cy + i * 0.6 * w + j * 0.8 * h) for i, j in ((1, -1), (1, 1), (-1, 1), (-1, -1))))
    triangle = F.array(point(cx - w, cy - h), point(cx + 0.25 * w, cy + h), point(cx + w, cy - 0.5 * h))
    dart = F.array(point(cx - w, cy - h), point(cx + w, cy - 0.75 * h), point(cx + 0.125 * w, cy + h), point(cx - 0.25 * w, cy + 0.125 * h))
    return F.when(k % 3 == 0, turned).when(k % 3 == 1, triangle).otherwise(dart)


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, drawing, ring)"""
    k = F.col("p_partkey")
    own = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    return own.select(k.alias("id"), F.floor(k / 12).alias("drawing"), ring().alias("ring"))


def rounded(*names: str) -> list[Column]:
    return [F.round(F.col(n) + NUDGE, 3).alias(n) for n in names]


@query(f"""WITH {RINGS_SQL}, {slabs_sql("SELECT drawing, 'p' AS layer, ring FROM rings UNION ALL SELECT DISTINCT drawing, 'q', [" + ", ".join(f"{{'x': {x}, 'y': {y}}}" for x, y in ENVELOPE) + "] FROM rings")},
g AS (SELECT drawing, sum(area) FILTER (WHERE p > 0) AS union_area, sum(area * p) AS sum_area, sum(area) FILTER (WHERE q > 0) AS envelope, coalesce(sum(area) FILTER (WHERE q > 0 AND p = 0), 0) AS gap_area, sum(area * p * (p - 1) / 2) AS overlap_area, coalesce(sum(area) FILTER (WHERE p > 0 AND q = 0), 0) AS outside FROM strips GROUP BY drawing)
SELECT drawing, round(sum_area + {NUDGE}, 3) AS sum_area, round(union_area + {NUDGE}, 3) AS union_area, round(envelope + {NUDGE}, 3) AS envelope, round(gap_area + {NUDGE}, 3) AS gap_area, round(overlap_area + {NUDGE}, 3) AS overlap_area, round(outside + {NUDGE}, 3) AS outside, round((sum_area - envelope) / envelope * 100 + {NUDGE}, 3) AS delta_pct,
 CASE WHEN overlap_area > {NOISE} THEN 'fail' WHEN gap_area > {NOISE} OR abs((sum_area - envelope) / envelope * 100) > 1 THEN 'warning' ELSE 'pass' END AS severity FROM g""")
def plan_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each drawing: the plots' areas summed and united against the plan's envelope, its gap_area, the plots' pairwise
    overlaps, and what lies outside."""
    plots = rings(spark, sf_dir)
    edge = F.array(*(point(F.lit(x), F.lit(y)) for x, y in ENVELOPE))
    layers = plots.select("drawing", F.lit("p").alias("layer"), "ring").unionByName(plots.select("drawing").distinct().select("drawing", F.lit("q").alias("layer"), edge.alias("ring")))
    p, q = F.col("n_p"), F.col("n_q")
    g = overlay.covered(layers, {"union_area": p > 0, "sum_area": p, "envelope": q > 0, "gap_area": (q > 0) & (p == 0), "overlap_area": p * (p - 1) / 2, "outside": (p > 0) & (q == 0)}, ["p", "q"])
    delta = percent_delta(F.col("sum_area"), F.col("envelope"))
    severity = F.when(F.col("overlap_area") > NOISE, "fail").when((F.col("gap_area") > NOISE) | (F.abs(delta) > 1), "warning").otherwise("pass")
    return g.select("drawing", *rounded("sum_area", "union_area", "envelope", "gap_area", "overlap_area", "outside"), F.round(delta + NUDGE, 3).alias("delta_pct"), severity.alias("severity"))


@query(f"""WITH {RINGS_SQL}, {slabs_sql("SELECT drawing, CASE WHEN id % 4 = 0 THEN 'p' ELSE 'q' END AS layer, ring FROM rings WHERE id % 4 = 0 OR drawing % 5 > 0 AND id % 4 = 1")},
g AS (SELECT drawing, sum(area) FILTER (WHERE q > 0) AS public, coalesce(sum(area) FILTER (WHERE q > 0 AND p > 0), 0) AS shared FROM strips GROUP BY drawing)
SELECT drawing, round(coalesce(public, 0) + {NUDGE}, 3) AS public, round(shared + {NUDGE}, 3) AS shared, CASE WHEN public IS NULL THEN 'not_applicable' WHEN shared > 1e-6 THEN 'fail' ELSE 'pass' END AS verdict FROM g""")
def public_space_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings on the union of a drawing's public spaces; not applicable without such spaces."""
    k = F.col("id")
    own = rings(spark, sf_dir).where((k % 4 == 0) | (F.col("drawing") % 5 > 0) & (k % 4 == 1)).select("drawing", F.when(k % 4 == 0, "p").otherwise("q").alias("layer"), "ring")
    p, q = F.col("n_p"), F.col("n_q")
    g = overlay.covered(own, {"public": q > 0, "shared": (p > 0) & (q > 0)}, ["p", "q"])
    verdict = F.when(F.col("public") == 0, "not_applicable").when(F.col("shared") > 1e-6, "fail").otherwise("pass")
    return g.select("drawing", *rounded("public", "shared"), verdict.alias("verdict"))


@query(f"""WITH {RINGS_SQL}, areas AS (SELECT id, drawing, ring, abs(list_sum(list_transform(range(1, len(ring) + 1), lambda i: ring[i].x * ring[i % len(ring) + 1].y - ring[i % len(ring) + 1].x * ring[i].y))) / 2 AS area FROM rings),
pairs AS (SELECT a.id AS a, b.id AS b, least(a.area, b.area) AS smaller, a.ring AS ra, b.ring AS rb FROM areas a JOIN areas b ON a.drawing = b.drawing AND a.id < b.id),
{slabs_sql("SELECT a * 100000000 + b AS drawing, 'p' AS layer, ra AS ring FROM pairs UNION ALL SELECT a * 100000000 + b, 'q', rb FROM pairs")},
g AS (SELECT drawing, sum(area) AS shared FROM strips WHERE p > 0 AND q > 0 GROUP BY drawing)
SELECT a, b, round(shared + {NUDGE}, 3) AS shared, round(shared / smaller * 100 + {NUDGE}, 2) AS share_pct FROM pairs JOIN g ON drawing = a * 100000000 + b WHERE shared > {NOISE}""")
def ring_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a drawing's rings, convex or not, that share more than noise, and the share of the smaller one."""
    own = rings(spark, sf_dir).withColumn("area", G.area(F.col("ring")))
    # rings meet in the grid cells of their boxes; a pair counts in the cell of its boxes' common lower left corner
    side = 8.0
    at = lambda v: F.floor(v / side)
    lo, hi = lambda c: F.array_min(F.col(f"ring.{c}")), lambda c: F.array_max(F.col(f"ring.{c}"))
    box = own.withColumns({"x0": lo("x"), "y0": lo("y"), "x1": hi("x"), "y1": hi("y")})
    g = box.withColumn("cx", F.explode(F.sequence(at(F.col("x0")), at(F.col("x1"))))).withColumn("cy", F.explode(F.sequence(at(F.col("y0")), at(F.col("y1")))))
    a = g.select("drawing", "cx", "cy", *(F.col(c).alias(f"{c}_a") for c in ("id", "ring", "area", "x0", "y0", "x1", "y1")))
    b = g.select("drawing", "cx", "cy", *(F.col(c).alias(f"{c}_b") for c in ("id", "ring", "area", "x0", "y0", "x1", "y1")))
    meet = "id_a < id_b and x0_a < x1_b and x0_b < x1_a and y0_a < y1_b and y0_b < y1_a"
    first = (at(F.greatest("x0_a", "x0_b")) == F.col("cx")) & (at(F.greatest("y0_a", "y0_b")) == F.col("cy"))
    # merged: sizes guessed from the narrow table would have the rings broadcast
    both = a.join(b.hint("merge"), ["drawing", "cx", "cy"]).where(meet).where(first)
    # exploded, so that the filter doesn't measure a second time
    both = both.withColumn("shared", F.explode(F.filter(F.array(G.intersection_area(F.col("ring_a"), F.col("ring_b"))), lambda s: s > NOISE)))
    return both.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.round(F.col("shared") + NUDGE, 3).alias("shared"), F.round(F.col("shared") / F.least("area_a", "area_b") * 100 + NUDGE, 2).alias("share_pct"))


#: A layer counts as within another that it leaves by so much at most.
BUFFER = 0.5
FENCE = [(0.0, 0.0), (30.0, 0.0), (30.0, 30.0), (0.0, 30.0)]


@query(f"""WITH p AS (SELECT p_partkey AS id, 30 - 5 - (1 + p_size % 4) + CASE p_partkey % 5 WHEN 0 THEN 0.4 WHEN 1 THEN 0.6 WHEN 2 THEN 0 ELSE -1 - p_partkey % 7 END AS x, 12 + p_partkey % 5 AS y, 1.0 + p_size % 4 AS w FROM part),
v AS (SELECT id, x, w, greatest(x + w + 5 - 30, 0) AS over FROM p)
SELECT id, round(over, 6) AS overhang, over <= {BUFFER} AS within_buffer, round(CASE WHEN x + w + 5 >= 32 THEN 0 ELSE 32 - (x + w + 5) END, 6) AS to_line FROM v""")
def layer_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each turned plot lies within its fence, give or take the buffer, how far it reaches out, and how far it is
    from a street line beyond (0 where it meets it)."""
    k, w = F.col("p_partkey"), 1.0 + F.col("p_size") % 4
    out = F.when(k % 5 == 0, 0.4).when(k % 5 == 1, 0.6).when(k % 5 == 2, 0.0).otherwise(-1.0 - k % 7)
    x, y = 30 - 5 - w + out, 12 + k % 5
    # a kite whose right corner lies at x + w + 5
    ring = F.array(point(x - 1, y), point(x + w, y - 3), point(x + w + 5, y), point(x + w, y + 3))
    fence, street = F.array(*(point(F.lit(a), F.lit(b)) for a, b in FENCE)), F.array(point(F.lit(32.0), F.lit(-5.0)), point(F.lit(32.0), F.lit(40.0)))
    own = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(k.alias("id"), ring.alias("ring"))
    own = own.select("id", G.overhang(F.col("ring"), fence).alias("o"), G.gap(F.col("ring"), street).alias("g"))
    return own.select("id", F.round("o", 6).alias("overhang"), (F.round("o", 6) <= BUFFER).alias("within_buffer"), F.round("g", 6).alias("to_line"))


@query(f"""WITH p AS (SELECT p_partkey AS id, 2.0 + p_size % 7 AS w, 2.0 + p_size % 5 AS h FROM part)
SELECT id, id % 5 < 2 AS was_valid, round(CASE id % 5 WHEN 0 THEN w * h WHEN 1 THEN w * h / 2 WHEN 2 THEN w * h / 2 WHEN 3 THEN w * h END + {NUDGE}, 3) AS area, CASE WHEN id % 5 < 2 THEN 1 WHEN id % 5 = 3 THEN 2 ELSE 2 END AS parts FROM p WHERE id % 5 < 4""".replace("WHEN id % 5 = 3 THEN 2 ELSE 2", "WHEN id % 5 = 3 THEN 1 ELSE 2"))
def ring_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles and triangles as they are, bow ties as their two wings, rectangles with a spike without it; lines go."""
    k, w, h = F.col("p_partkey"), 2.0 + F.col("p_size") % 7, 2.0 + F.col("p_size") % 5
    zero = F.lit(0.0)
    box, three = F.array(point(zero, zero), point(w, zero), point(w, h), point(zero, h)), F.array(point(zero, zero), point(w, zero), point(zero, h))
    tie = F.array(point(zero, zero), point(w, h), point(w, zero), point(zero, h))
    spike = F.array(point(zero, zero), point(w, zero), point(w, h / 2), point(w + 5, h / 2), point(w, h / 2), point(w, h), point(zero, h))
    line = F.array(point(zero, zero), point(w, h), point(w * 2, h * 2))
    ring = F.when(k % 5 == 0, box).when(k % 5 == 1, three).when(k % 5 == 2, tie).when(k % 5 == 3, spike).otherwise(line)
    made = overlay.repaired(table(spark, sf_dir, "part").select(k.alias("id"), ring.alias("ring")))
    return made.select("id", (F.col("id") % 5 < 2).alias("was_valid"), F.round(F.col("area") + NUDGE, 3).alias("area"), F.size("parts").alias("parts"))
