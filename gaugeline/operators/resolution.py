"""Which rules govern an entity, and which of them are overridden."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def governing_rules(entities: DataFrame, links: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity x rule rows, entities whose plan has no link).  entities: entity, plan; links: plan, coverage_type;
    rules: plan, rule_code, is_active.  Adjacent references govern nothing."""
    live = links.where("coverage_type <> 'adjacent_reference'")
    every = entities.join(live, "plan").join(rules.where("is_active"), "plan")
    return every, entities.join(links, "plan", "left_anti")


def active(expires: Column, as_of: Column) -> Column:
    """An exception without end, or one that ends later."""
    return expires.isNull() | (expires > as_of)


def with_exceptions(rules: DataFrame, exceptions: DataFrame, as_of: Column, order: list[str]) -> DataFrame:
    """Rules with their last active exception by the given order (project, rule_code)."""
    last = Window.partitionBy("project", "rule_code").orderBy(*(F.col(c).desc_nulls_last() for c in order))
    one = exceptions.where(active(F.col("expires_at"), as_of)).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return rules.join(one, ["project", "rule_code"], "left")


def extra_params(fixed: dict[str, Column], extras: Column) -> dict[str, Column]:
    """Extra keys never override a fixed column, null ones included."""
    return fixed | {"extras": F.map_filter(extras, lambda k, v: ~k.isin(*fixed))}
