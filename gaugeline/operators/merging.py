"""Run diffs, comparisons, upserts and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.operators.dedup import last_wins


def run_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys with status fixed (old only), still_open (both) or newly_detected (new only): one full join of distinct keys."""
    a, b = old.select(*keys).distinct().withColumn("_old", F.lit(True)), new.select(*keys).distinct().withColumn("_new", F.lit(True))
    status = F.when(F.col("_new").isNull(), "fixed").when(F.col("_old").isNull(), "newly_detected").otherwise("still_open")
    return a.join(b, keys, "full").select(*keys, status.alias("status"))


def three_way(source: DataFrame, response: DataFrame, revision: DataFrame, key: str, seq: str) -> DataFrame:
    """source left-joined with the last response and the last revision of its key."""
    return source.join(last_wins(response, [key], seq).drop(seq), key, "left").join(last_wins(revision, [key], seq).drop(seq), key, "left")


def compared(before: Column, after: Column, answered: Column) -> Column:
    """Status of a three-way comparison."""
    return (
        F.when(after.isNull(), "unclear").when((before == "fail") & (after == "pass"), "fixed")
        .when(after == before, F.when(before == "fail", F.when(answered, "needs fix").otherwise("unchanged")).otherwise("unchanged")).otherwise("needs fix")
    )


def upsert(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A change's non-empty values win, others heal from the base; new keys come in."""
    c = changes.select(key, *(F.col(x).alias(f"_{x}") for x in columns))
    return base.select(key, *columns).join(c, key, "full").select(key, *(F.coalesce(F.nullif(F.col(f"_{x}"), F.lit("")), F.col(x)).alias(x) for x in columns))


def insert_absent(base: DataFrame, new: DataFrame, key: str, canonical) -> DataFrame:
    """Rows of new whose canonical key the base lacks in any spelling."""
    have = base.select(canonical(F.col(key)).alias("_k")).distinct()
    return new.withColumn("_k", canonical(F.col(key))).join(have, "_k", "left_anti").drop("_k")


def overlay(base: DataFrame, over: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Only non-null overlay values replace base values; no row is added."""
    o = over.select(key, *(F.col(x).alias(f"_{x}") for x in columns))
    keep = [x for x in base.columns if x not in columns]
    return base.join(o, key, "left").select(*keep, *(F.coalesce(f"_{x}", x).alias(x) for x in columns))
