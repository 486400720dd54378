"""Areas of unions, intersections and differences of many rings, by slabs within grid cells.

Rings are cut along a grid; a piece belongs to its cell alone, so cells are worked on apart and a drawing of any size is
no task's own.  Pieces that fill their cell are only counted; a cell with too many others is quartered until it has few.
Within a cell, edges are cut into slabs at all vertices and crossings; in a slab no two edges cross, so their order by
height is the same everywhere in it, and sums of their directions from below say how many rings of each layer cover the
strip between two edges, whose area is its mean height times the slab's width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.operators import geometry as G
from gaugeline.sources.staging import staged

#: Pieces of a cell, other than full ones, beyond which it is quartered; how often at most; cells a ring may be cut into at once.
CROWD, DEEPEST, AT_ONCE = 24, 12, 64
CELL = ["drawing", "level", "cx", "cy"]
#: Edges of a task that compares them, by cells; a cell's edges make a few hundred strips, so the rows sorted are many times as many.
EDGES = 20_000


def in_cells(pieces: DataFrame, side: Column) -> DataFrame:
    """Each piece(drawing, layer, level, ring) cut to the cells of its level that its box meets, cx and cy in units of side."""
    lo, hi = lambda c: F.array_min(F.col(f"ring.{c}")), lambda c: F.array_max(F.col(f"ring.{c}"))
    at = lambda v: F.floor(v / F.col("side"))
    p = pieces.withColumn("side", side)
    p = p.withColumn("cx", F.explode(F.sequence(at(lo("x")), at(hi("x"))))).withColumn("cy", F.explode(F.sequence(at(lo("y")), at(hi("y")))))
    box = {"x0": F.col("cx") * F.col("side"), "y0": F.col("cy") * F.col("side"), "x1": (F.col("cx") + 1) * F.col("side"), "y1": (F.col("cy") + 1) * F.col("side")}
    p = p.withColumns(box)
    inside = G.within_box(F.col("ring"), *(F.col(b) for b in box))
    # exploded, so that the filter doesn't cut the ring a second time
    return p.withColumn("ring", F.explode(F.filter(F.array(inside), lambda r: G.area(r) > 0)))


def cells(rings: DataFrame, side: float | None = None) -> DataFrame:
    """(drawing, layer, level, cx, cy, side, x0, y0, x1, y1, ring, n): pieces by cell; those that fill it are one row without ring, n of them.

    rings: (drawing, layer, ring), simple.  side: of the first cells, by default twice the rings' mean extent."""
    rings = rings.where(G.valid(F.col("ring"))).select("drawing", "layer", G.anticlockwise(F.col("ring")).alias("ring"))
    extent = lambda c: F.array_max(F.col(f"ring.{c}")) - F.array_min(F.col(f"ring.{c}"))
    rings = staged(rings, "overlay-rings")
    most = F.max(F.greatest(extent("x"), extent("y")))
    mean, widest = rings.select(F.avg(F.greatest(extent("x"), extent("y"))), most).first() if side is None else (side / 2, rings.agg(most).first()[0])
    if not mean:
        mean, widest = 1.0, 1.0
    # rings that are much wider than most start in larger cells, so that none is cut into many at once
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent("x"), extent("y")) / (mean * 2 * AT_ONCE**0.5))))
    top = int(rings.agg(F.coalesce(F.max(level), F.lit(0))).first()[0])
    side_of = F.lit(float(mean) * 2) * F.pow(F.lit(2.0), -F.col("level").cast("double"))
    now, done = in_cells(rings.withColumn("level", F.lit(-top)), side_of), []
    for _ in range(top + DEEPEST + 1):
        full = G.area(F.col("ring")) >= (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * (1 - 1e-12)
        now = staged(now.withColumn("full", full).select(*CELL, "layer", "side", "x0", "y0", "x1", "y1", "full", F.when(~full, F.col("ring")).alias("ring")), "overlay-cells")
        whole = now.where("full").groupBy(*CELL, "layer", "side", "x0", "y0", "x1", "y1").agg(F.count(F.lit(1)).alias("n"))
        crowd = now.groupBy(*CELL).agg(F.count_if(~F.col("full")).alias("_n")).where((F.col("_n") > CROWD) & (F.col("level") < DEEPEST) | (F.col("level") < 0)).select(*CELL)
        crowd = staged(crowd, "overlay-crowd")
        parts = now.where("not full").withColumn("n", F.lit(1).cast("long")).drop("full")
        some = parts.unionByName(whole.withColumn("ring", F.lit(None).cast(parts.schema["ring"].dataType)))
        if not crowd.limit(1).count():
            done.append(some)
            break
        done.append(some.join(crowd, CELL, "left_anti"))
        corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
        square = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))
        again = some.join(crowd, CELL, "left_semi").select("drawing", "layer", (F.col("level") + 1).alias("level"), F.coalesce("ring", square).alias("ring"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("ring").isNull(), F.col("n")).otherwise(1).cast("int"))))
        now = in_cells(again.drop("col"), side_of)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return staged(out, "overlay-pieces")


def strips(pieces: DataFrame, layers: list[str], corners: bool = False) -> DataFrame:
    """(drawing, area, n_<layer> ...[, ring]): parts of the plane with how many rings of each layer cover them (or, for rings
    that cross themselves, how often they wind around), from cells(); with corners, each part as a ring."""
    c = F.col
    edge = lambda x0, y0, x1, y1, w: F.struct(x0.alias("ax"), y0.alias("ay"), x1.alias("bx"), y1.alias("by"), w.cast("long").alias("w"))
    box = F.array(edge(c("x0"), c("y0"), c("x1"), c("y0"), c("n")), edge(c("x0"), c("y1"), c("x1"), c("y1"), -c("n")))
    # from left to right: upwards across an edge that ran so the ring begins, across one that ran back it ends
    own = F.transform(G.edges(c("ring")), lambda e: F.when(e["a"]["x"] < e["b"]["x"], edge(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"], F.lit(1))).when(e["a"]["x"] > e["b"]["x"], edge(e["b"]["x"], e["b"]["y"], e["a"]["x"], e["a"]["y"], F.lit(-1))))
    edges = pieces.select(*CELL, "layer", F.explode(F.filter(F.when(c("ring").isNull(), box).otherwise(own), lambda e: e.isNotNull())).alias("e")).select(*CELL, "layer", "e.*")
    edges = edges.groupBy(*CELL, "layer", "ax", "ay", "bx", "by").agg(F.sum("w").alias("w")).where("w <> 0")  # edges that run both ways cancel
    edges = staged(edges, "overlay-edges")
    # all that follows stays within a cell, so cells are dealt out once and merged: the tasks grow in number, not in rows
    tasks = max(1, -(-edges.count() // EDGES))
    edges = edges.repartition(tasks, *CELL)
    p, q = edges.select(*CELL, *(c(x).alias(f"p{x}") for x in ("ax", "ay", "bx", "by"))), edges.select(*CELL, *(c(x).alias(f"q{x}") for x in ("ax", "ay", "bx", "by")))
    slope = lambda s: (c(f"{s}by") - c(f"{s}ay")) / (c(f"{s}bx") - c(f"{s}ax"))
    at = F.try_divide((c("qay") - slope("q") * c("qax")) - (c("pay") - slope("p") * c("pax")), slope("p") - slope("q"))
    meet = (c("pax") < c("qbx")) & (c("qax") < c("pbx")) & (F.struct("pax", "pay", "pbx", "pby") < F.struct("qax", "qay", "qbx", "qby"))
    cross = p.join(q.hint("merge"), CELL).where(meet).select(*CELL, at.alias("x"), F.greatest("pax", "qax").alias("lo"), F.least("pbx", "qbx").alias("hi")).where("x > lo and x < hi").select(*CELL, "x")
    cuts = edges.select(*CELL, F.explode(F.array("ax", "bx")).alias("x")).unionByName(cross).repartition(tasks, *CELL).distinct()
    slabs = cuts.withColumn("to", F.lead("x").over(Window.partitionBy(*CELL).orderBy("x"))).where("to is not null")
    mid = (c("x") + c("to")) / 2
    height = lambda x: c("ay") + (c("by") - c("ay")) * (x - c("ax")) / (c("bx") - c("ax"))
    ends = [height(c("x")).alias("l"), height(c("to")).alias("r"), "to"] if corners else []
    spans = edges.join(slabs.hint("merge"), CELL).where("ax <= x and bx >= to").select(*CELL, "x", (c("to") - c("x")).alias("width"), "layer", "w", height(mid).alias("y"), *ends)
    upwards = Window.partitionBy(*CELL, "x").orderBy("y", "layer", "w")
    counts = [F.sum(F.when(c("layer") == x, c("w")).otherwise(0)).over(upwards.rowsBetween(Window.unboundedPreceding, 0)).alias(f"n_{x}") for x in layers]
    if corners:
        at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
        counts.append(F.array(at(c("x"), c("l")), at(c("to"), c("r")), at(c("to"), F.lead("r").over(upwards)), at(c("x"), F.lead("l").over(upwards))).alias("ring"))
    return spans.select("drawing", ((F.lead("y").over(upwards) - c("y")) * c("width")).alias("area"), *counts).where("area > 0")


def covered(rings: DataFrame, areas: dict[str, Column], layers: list[str], side: float | None = None) -> DataFrame:
    """(drawing, <name> ...): for each of areas the area of what meets its condition, or its weight (a number), over n_<layer>.

    rings: (drawing, layer, ring) with simple rings; those of no area, or null, cover nothing."""
    found = strips(cells(rings, side), layers)
    weight = {n: F.when(w, F.col("area")).otherwise(0.0) if found.select(w).dtypes[0][1] == "boolean" else F.col("area") * w for n, w in areas.items()}
    return found.groupBy("drawing").agg(*(F.sum(w).alias(n) for n, w in weight.items()))


def repaired(rings: DataFrame) -> DataFrame:
    """(id, parts, area) for rings(id, ring) with unique ids: a simple ring as it is; of one that crosses, touches or
    doubles itself, what it winds around, as simple rings side by side.  Rings that wind around nothing have no row.

    A ring's own edges meet each other only, so the work grows with the square of a ring's vertices, not with the table."""
    rings = staged(rings.where(F.size("ring") >= 3).select("id", "ring", G.simple(F.col("ring")).alias("simple")), "repair-rings")
    good = rings.where("simple").where(G.area(F.col("ring")) > 0).select("id", F.array("ring").alias("parts"), G.area(F.col("ring")).alias("area"))
    zero = F.lit(0)
    bad = rings.where("not simple").select(F.col("id").alias("drawing"), zero.alias("level"), zero.alias("cx"), zero.alias("cy"), F.lit("r").alias("layer"), "ring", F.lit(1).cast("long").alias("n"), *(F.lit(0.0).alias(x) for x in ("x0", "y0", "x1", "y1")))
    parts = strips(bad, ["r"], corners=True).where("n_r <> 0")
    made = parts.groupBy(F.col("drawing").alias("id")).agg(F.sort_array(F.collect_list("ring")).alias("parts"), F.sum("area").alias("area"))
    return good.unionByName(made.select("id", F.col("parts").cast(good.schema["parts"].dataType).alias("parts"), "area"))
