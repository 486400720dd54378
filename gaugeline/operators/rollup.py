"""Run summaries: zero-filled counts, pivots, clusters, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERDICTS = ("pass", "pass_with_note", "fail", "fail_borderline", "unevaluable", "not_applicable", "requires_review")
FAILURES = ("fail", "fail_borderline")


def zero_filled(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """(column, n) for every value of an enumeration, 0 where no row has it; one aggregation, one row wide."""
    wide = rows.agg(*(F.count_if(F.col(column) == v).alias(v) for v in values))
    return wide.unpivot([], list(values), column, "n")


def pivoted(rows: DataFrame, by: str, column: str, values: tuple[str, ...]) -> DataFrame:
    """A count column for each value, by key; the values are given, so no pass collects them."""
    return rows.groupBy(by).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values))


def clusters(rows: DataFrame, fingerprint: str, least: int) -> DataFrame:
    return rows.groupBy(fingerprint).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def fold(rows: DataFrame, by: list[str], clusterable: Column, least: int, keep: str) -> DataFrame:
    """Clusterable rows of a group of at least `least` become one row (smallest keep, count); others stay.

    Groups are summed once; rows of small groups come back by a semi join on the group, not by a window
    that would gather it."""
    some = rows.where(clusterable).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(keep).alias(keep))
    big = some.where(F.col("n") >= least)
    single = some.where(F.col("n") < least).select(*by)
    alone = rows.where(clusterable).join(single, by, "left_semi").unionByName(rows.where(~F.coalesce(clusterable, F.lit(False))))
    return big.select(*by, keep, "n").unionByName(alone.select(*by, keep, F.lit(1).cast("long").alias("n")))
