"""Connected components of an edge table, as Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(id, component): the smallest id reachable, for every id in edges(a, b).

    Each round takes the smallest label among neighbours, then jumps to the
    label's own label, so long chains shrink geometrically.  Labels are staged
    each round; the driver sees only the number of changes.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{label}-edges")
    cur = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"), f"{label}-0")
    step = 0
    while True:
        step += 1
        near = (
            both.join(cur.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        )
        new = cur.join(near.withColumnRenamed("a", "id"), "id", "left").select(
            "id", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("old")
        )
        root = new.select(F.col("id").alias("component"), F.col("component").alias("top"))
        new = staged(
            new.join(root, "component", "left").select("id", F.coalesce("top", "component").alias("component"), "old"),
            f"{label}-{step}",
        )
        changed = new.where("component <> old").limit(1).count()
        cur = new.select("id", "component")
        if not changed:
            return cur


def absorb(component: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """(id, component) after more links(a, b) between ids, of which those without a row are components of their own.
    Only the components that links join are worked on again."""
    name = component.toDF("n", "c")
    ends = links.join(name.toDF("a", "ca"), "a", "left").join(name.toDF("b", "cb"), "b", "left")
    joined = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct(), label)
    fresh = links.select(F.col("a").alias("id")).union(links.select("b")).distinct().join(component.select("id"), "id", "left_anti")
    every = component.unionByName(fresh.withColumn("component", F.col("id")))
    return staged(every.join(joined.toDF("component", "top"), "component", "left").select("id", F.coalesce("top", "component").alias("component")), f"{label}-all")
