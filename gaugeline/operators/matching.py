"""Block inserts and polygons matched one to one in the order of the inserts, without gathering a drawing.

An insert's preferences don't hang on what is free: first the polygons that hold it, in their order, then the nearest
centres; and every polygon prefers the smaller insert.  So rounds of deferred acceptance give what going through the
inserts in order gives: all open inserts propose to their best polygon not held by a smaller one, and each polygon keeps
the smallest.  Nearest centres are looked for in grid cells that double in width until the best one found is surely nearest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.operators import geometry as G
from gaugeline.sources.staging import staged


def centre(ring: Column) -> Column:
    """Centroid by the shoelace formula; of a ring without area, the vertices' mean."""
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("w"))

    def step(s, e):
        a, b = e["a"], e["b"]
        cross = a["x"] * b["y"] - b["x"] * a["y"]
        return F.struct((s["x"] + (a["x"] + b["x"]) * cross).alias("x"), (s["y"] + (a["y"] + b["y"]) * cross).alias("y"), (s["w"] + cross).alias("w"))

    mean = lambda c: F.try_divide(F.aggregate(ring, F.lit(0.0), lambda s, v: s + v[c]), F.size(ring))
    return F.aggregate(G.edges(ring), zero, step, lambda s: F.struct(*(F.when(s["w"] != 0, s[c] / (3 * F.nullif(s["w"], F.lit(0.0)))).otherwise(mean(c)).alias(c) for c in "xy")))


def held_by(inserts: DataFrame, polygons: DataFrame, grid: DataFrame) -> DataFrame:
    """(drawing, insert, polygon) for each polygon that holds an insert's point, found by cells of the grid."""
    p, q = inserts.join(grid, "drawing"), polygons.join(grid, "drawing")
    at = lambda v, o: F.floor((v - F.col(o)) / F.col("side"))
    lo, hi = lambda c: F.array_min(F.col(f"ring.{c}")), lambda c: F.array_max(F.col(f"ring.{c}"))
    # a ring lies in the cells of the level whose side is its extent at least, four at most
    wide = F.greatest(hi("x") - lo("x"), hi("y") - lo("y"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(wide / F.col("side"), F.lit(1.0))))).cast("int")
    q = q.withColumn("level", level).withColumn("side", F.col("side") * F.pow(F.lit(2.0), "level"))
    q = q.withColumn("cx", F.explode(F.sequence(at(lo("x"), "left"), at(hi("x"), "left")))).withColumn("cy", F.explode(F.sequence(at(lo("y"), "low"), at(hi("y"), "low")))).select("drawing", "level", "cx", "cy", "polygon", "ring")
    levels = q.groupBy("drawing").agg(F.collect_set("level").alias("levels"))  # some tens at most
    p = p.join(levels, "drawing").withColumn("level", F.explode("levels")).withColumn("side", F.col("side") * F.pow(F.lit(2.0), "level"))
    p = p.select("drawing", "level", at(F.col("x"), "left").alias("cx"), at(F.col("y"), "low").alias("cy"), "insert", "x", "y")
    return G.held(p.join(q, ["drawing", "level", "cx", "cy"])).select("drawing", "insert", "polygon").distinct()


def blocks_to_polygons(inserts: DataFrame, polygons: DataFrame) -> DataFrame:
    """(drawing, insert, polygon, contained) for inserts(drawing, insert, x, y) and polygons(drawing, polygon, ring), with
    unique ids within a drawing.

    In the order of insert each has the first free polygon, in the order of polygon, that holds it, else the free one
    whose centre is nearest (ties: the smaller polygon); with none left it has no row."""
    c = F.col
    inserts = staged(inserts.select("drawing", "insert", "x", "y").where("drawing is not null and insert is not null and x is not null and y is not null"), "match-inserts")
    polygons = staged(polygons.where("drawing is not null and polygon is not null").where(F.size("ring") > 0).select("drawing", "polygon", "ring", centre(c("ring")).alias("m")), "match-polygons")
    every = polygons.select("drawing", c("m.x").alias("x"), c("m.y").alias("y"), F.lit(1).alias("n")).unionByName(inserts.select("drawing", "x", "y", F.lit(0).alias("n")))
    grid = every.groupBy("drawing").agg(F.min("x").alias("left"), F.min("y").alias("low"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)).alias("extent"), F.sum("n").alias("n")).where("n > 0")
    # some one centre a cell at first, and one cell for all at last
    grid = grid.select("drawing", "left", "low", (c("extent") / F.ceil(F.sqrt("n"))).alias("side"), (F.ceil(F.log2(F.ceil(F.sqrt("n")))) + 1).cast("int").alias("top"))
    grid = staged(grid, "match-grid")
    inside = staged(held_by(inserts, polygons, grid), "match-inside")
    at = lambda v, o, level: F.floor((v - c(o)) / (c("side") * F.pow(F.lit(2.0), level)))
    cells = polygons.join(grid, "drawing").withColumn("level", F.explode(F.sequence(F.lit(0), c("top"))))
    cells = staged(cells.select("drawing", "level", at(c("m.x"), "left", c("level")).alias("cx"), at(c("m.y"), "low", c("level")).alias("cy"), "polygon", c("m.x").alias("mx"), c("m.y").alias("my")), "match-cells")
    # those that hold the insert come before all; else cells of twice the width at each level
    state = inserts.join(grid, "drawing").select("drawing", "insert", "x", "y", "left", "low", "side", "top", F.least(F.lit(1), c("top")).alias("level"), F.lit(None).cast("long").alias("polygon"))
    state = staged(state.withColumn("over", F.lit(False)), "match-state")
    while state.where("polygon is null and not over").limit(1).count():
        open_ = state.where("polygon is null and not over")
        holder = state.where("polygon is not null").select("drawing", "polygon", c("insert").alias("holder"))
        own = open_.select("drawing", "insert").join(inside, ["drawing", "insert"]).select("drawing", "insert", "polygon", F.lit(-1.0).alias("d"))
        near = open_.withColumn("i", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("j", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
        near = near.select("drawing", "insert", "x", "y", "level", (at(c("x"), "left", c("level")) + c("i")).alias("cx"), (at(c("y"), "low", c("level")) + c("j")).alias("cy")).join(cells, ["drawing", "level", "cx", "cy"])
        dx, dy = c("mx") - c("x"), c("my") - c("y")
        found = own.unionByName(near.select("drawing", "insert", "polygon", (dx * dx + dy * dy).alias("d"))).join(holder, ["drawing", "polygon"], "left").where("holder is null or holder > insert")
        best = found.groupBy("drawing", "insert").agg(F.min(F.struct("d", "polygon")).alias("b")).select("drawing", "insert", "b.d", c("b.polygon").alias("wants"))
        tried = state.join(best, ["drawing", "insert"], "left")
        # the cells around an insert's own hold all centres within their side
        reach = c("side") * F.pow(F.lit(2.0), "level")
        sure = c("wants").isNotNull() & ((c("d") <= reach * reach) | (c("level") >= c("top")))
        tried = tried.withColumn("polygon", F.coalesce("polygon", F.when(sure, c("wants"))))
        tried = tried.withColumn("over", c("over") | (c("polygon").isNull() & (c("level") >= c("top")) & c("wants").isNull()))
        tried = staged(tried.withColumn("level", F.when(c("polygon").isNull() & ~c("over"), c("level") + 1).otherwise(c("level"))).drop("d", "wants"), "match-tried")
        keeps = tried.where("polygon is not null").groupBy("drawing", "polygon").agg(F.min("insert").alias("keeps"))
        state = tried.join(keeps, ["drawing", "polygon"], "left").withColumn("polygon", F.when(c("keeps") == c("insert"), c("polygon"))).drop("keeps")
        state = staged(state.select("drawing", "insert", "x", "y", "left", "low", "side", "top", "level", "polygon", "over"), "match-state")
    got = state.where("polygon is not null").select("drawing", "insert", "polygon")
    return got.join(inside.withColumn("contained", F.lit(True)), ["drawing", "insert", "polygon"], "left").select("drawing", "insert", "polygon", F.coalesce("contained", F.lit(False)).alias("contained"))
