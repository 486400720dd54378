"""Checks on documents made of pages: which pages a rule looks at, and what it wants of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


FIRST_PAGES = 5


def team_page(number: Column, text: Column, words: str, document) -> Column:
    """The number of the first of a document's first pages whose text has the words; a document is a window's partition."""
    return F.min(F.when((number <= FIRST_PAGES) & F.contains(F.coalesce(text, F.lit("")), F.lit(words)), number)).over(document)


def in_scope(scope: Column, number: Column, text: Column, team: Column) -> Column:
    """Whether a page belongs to a rule's scope: all of them or of their text, the first, all but the cover, the first five,
    those with text, the team's page; no scope, or an unknown one, means all pages."""
    return (
        F.when(scope == "first", number == 1).when(scope == "except_cover", number > 1).when(scope == "first_five", number <= FIRST_PAGES)
        .when(scope == "with_text", F.length(F.trim(F.coalesce(text, F.lit("")))) > 0).when(scope == "team_page", F.coalesce(number == team, F.lit(False)))
        .otherwise(F.lit(True))
    )


def size_within(width: Column, height: Column, want_w: float, want_h: float, slack: float) -> Column:
    """Page size as wanted, upright or turned."""
    near = lambda a, b: F.abs(a - b) <= slack
    return (near(width, F.lit(want_w)) & near(height, F.lit(want_h))) | (near(width, F.lit(want_h)) & near(height, F.lit(want_w)))


def allowed_font(font: Column, allowed: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, allowed)), lambda a: F.contains(F.lower(font), a))


def best_table(tables: DataFrame, doc: str, headers: Column, wanted: list[str], order: str) -> DataFrame:
    """Of each document the table with most wanted headers; ties go to the first in order."""
    hits = F.size(F.array_intersect(headers, F.array(*map(F.lit, wanted))))
    best = F.max_by(F.struct(F.col(order), hits.alias("hits")), F.struct(hits, -F.col(order)))
    return tables.groupBy(doc).agg(best.alias("b")).select(doc, f"b.{order}", "b.hits")


def divider(text: Column, most: int = 50) -> Column:
    """A chapter divider has some, but under `most` words."""
    n = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    return (n > 0) & (n < most)


def once_per_value(rows: DataFrame, column: str, schema: str, expensive) -> DataFrame:
    """Apply an expensive mapInPandas function to each distinct value once and join it back."""
    return rows.join(rows.select(column).distinct().mapInPandas(expensive, schema), column, "left")


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """What a content-addressed cache doesn't hold yet."""
    return wanted.select(key).distinct().join(cache.select(key), key, "left_anti")
