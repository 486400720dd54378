"""Data checks: each is a named condition that marks a bad row; one pass counts all of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, bad, passed) for conditions on single rows."""
    wide = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()))
    return wide.unpivot([], list(checks), "check", "bad").withColumn("passed", F.col("bad") == 0)


def duplicates(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows beyond the first of each key."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("bad")).select(F.lit(name).alias("check"), "bad", (F.col("bad") == 0).alias("passed"))


def dangling(df: DataFrame, key: str, parents: DataFrame, parent_key: str, name: str) -> DataFrame:
    """Rows whose non-null key no parent has."""
    lost = df.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("bad")).select(F.lit(name).alias("check"), "bad", (F.col("bad") == 0).alias("passed"))


def one(df: DataFrame, name: str, bad: Column) -> DataFrame:
    """(check, bad, passed) from one aggregate."""
    return df.agg(F.coalesce(bad.cast("long"), F.lit(0)).alias("bad")).select(F.lit(name).alias("check"), "bad", (F.col("bad") == 0).alias("passed"))


def between(df: DataFrame, least: int, most: int, name: str) -> DataFrame:
    """Whether a table has from least to most rows."""
    n = F.count(F.lit(1))
    return one(df, name, (~n.between(least, most)).cast("int"))


def present(wanted: DataFrame, df: DataFrame, key: str, name: str) -> DataFrame:
    """Wanted keys that no row has."""
    return one(wanted.join(df.select(key).distinct(), key, "left_anti"), name, F.count(F.lit(1)))


def unchanged(before: DataFrame, after: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """Rows of after that differ from those of before in a column, null equal to null, or have none there."""
    old = before.select(key, F.struct(*columns).alias("old"))
    both = after.select(key, F.struct(*columns).alias("new")).join(old, key, "left")
    return one(both, name, F.count_if(~F.col("new").eqNullSafe(F.col("old"))))


def counted(rows: DataFrame, column: str, summary: DataFrame, name: str) -> DataFrame:
    """Values whose count in summary(value, n) is not their count in rows; a value without rows counts 0."""
    own = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("own"))
    both = summary.select("value", "n").join(own, "value", "full")
    return one(both, name, F.count_if(F.coalesce("n", F.lit(0)) != F.coalesce("own", F.lit(0))))


def digests(df: DataFrame, of: dict[str, list[Column]]) -> DataFrame:
    """One row with, for each name, a number that the table's rows have in any order, of 32 bits of each row's MD5."""
    row = lambda columns: F.conv(F.substring(F.md5(F.concat(*columns)), 1, 8), 16, 10).cast("long")
    return df.agg(*(F.sum(row(c)).alias(n) for n, c in of.items()))


def digest(df: DataFrame, columns: list[Column]) -> DataFrame:
    """(digest): digests() of one list of columns."""
    return digests(df, {"digest": columns})


def suite(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
