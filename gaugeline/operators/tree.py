"""Ancestor chains of adjacency lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.sources.staging import staged


def with_parents(nodes: DataFrame, title: str) -> DataFrame:
    """nodes(id, parent, title) and, for every parent that no node is, a root of that id."""
    lost = nodes.where("parent is not null").select(F.col("parent").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    return nodes.select("id", "parent", "title").unionByName(lost.select("id", F.lit(None).cast(nodes.schema["parent"].dataType).alias("parent"), F.lit(title).alias("title")))


def ancestor_chains(nodes: DataFrame) -> DataFrame:
    """(id, chain) of nodes(id, parent, title), ids being unique: titles from the root down to the node, null ones
    too.  A parent that no node is, or that is already in a chain, ends it; chains may be of any depth.

    A chain grows by the chain of the node above it, so its reach doubles with each round; rounds are staged."""
    node = F.struct("id", "title")
    chains = staged(nodes.select("id", F.array(node).alias("way"), F.col("parent").alias("above")), "chains")
    for step in range(64):  # 2^64 nodes deep
        over = chains.select(F.col("id").alias("above"), F.col("way").alias("up"), F.col("above").alias("next"))
        grown = chains.where("above is not null").join(over, "above", "left")
        own = F.transform("way", lambda n: n["id"])
        # upwards, the first node that the chain already has ends it
        rise = F.reverse(F.coalesce("up", F.array().cast(over.schema["up"].dataType)))
        met = F.array_position(F.transform(rise, lambda n: F.array_contains(own, n["id"])), True)
        kept = F.when(met > 0, F.slice(rise, F.lit(1), (met - 1).cast("int"))).otherwise(rise)
        grown = grown.select("id", F.concat(F.reverse(kept), F.col("way")).alias("longer"), F.when(met == 0, F.col("next")).alias("top")).toDF("id", "way", "above")
        chains = staged(grown.unionByName(chains.where("above is null")), f"chains{step}")
        if not chains.where("above is not null").limit(1).count():
            break
    return chains.select("id", F.transform("way", lambda n: n["title"]).alias("chain"))
