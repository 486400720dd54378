"""One row a key: last or first wins, best by rank, ordered sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.sources.staging import staged


def first_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the order given (which should have no ties)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def last_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return first_by(df, keys, [F.col(seq).desc()])


def ranked(value: Column, order: list[str], other: int = 99) -> Column:
    """The place of a value in a fixed order, for sorting by priority."""
    place = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])
    return F.coalesce(F.try_element_at(place, value), F.lit(other))


#: Bits of the lower of two numbers that are packed in one.
LOW_BITS = 32


def packed(high: Column, low: Column) -> Column:
    """One long that orders as (high, low) does; low has LOW_BITS bits at most, and neither is negative."""
    return F.shiftleft(high.cast("long"), LOW_BITS).bitwiseOR(low.cast("long"))


def low_bits(value: Column) -> Column:
    return value.bitwiseAND(F.lit((1 << LOW_BITS) - 1))


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with place, its row numbers from 1 in the order given, which should have no ties.  Rows are sorted by range
    partitions, each counting on from those before it, so no task sorts more than its range."""
    rows = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    starts = F.broadcast(counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start")))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("_part", part).join(starts, "_part").withColumn("place", F.col("_start") + within + 1).drop("_at", "_part", "_start")
