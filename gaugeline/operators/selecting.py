"""Which rows a stage works on: critical findings, slices, named clauses, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def critical(confidence: Column, pages: Column, value: Column, indicator: Column, clause: Column) -> Column:
    """A finding worth a second opinion: sure, placed, with a number, and either judged or a row of the table of rights."""
    sure = (confidence == "high") & (F.size(F.coalesce(pages, F.array())) > 0) & F.coalesce(value, F.lit("")).rlike(r"[-+]?\d")
    return F.coalesce(sure & (indicator.isin("compliant", "non_compliant") | F.startswith(F.coalesce(clause, F.lit("")), F.lit("5.table"))), F.lit(False))


def selected(df: DataFrame, wanted: list[str] | None, key: str, otherwise: Column) -> DataFrame:
    """The rows of a named slice, whatever else holds of them; without one, those that otherwise hold."""
    return df.where(F.col(key).isin(wanted) if wanted else otherwise)


def named_clauses(clauses: DataFrame, wanted: DataFrame) -> DataFrame:
    """(clause, text, note) for wanted(clause): normative ones, others with a note that they were asked for, and
    "unknown" for names that no clause has."""
    own = clauses.select("clause", "text", "is_normative")
    note = F.when(F.col("is_normative").isNull(), "unknown").when(~F.col("is_normative"), "non-normative but explicitly requested")
    return wanted.select("clause").distinct().join(own, "clause", "left").select("clause", "text", note.alias("note"))


PROBLEMS = ("fail", "fail_borderline", "requires_review", "unevaluable", "not_submitted")


def shown(verdict: Column, toggles: tuple[str, ...] = PROBLEMS) -> Column:
    """What a list of findings shows; by default verdicts that ask for something."""
    return verdict.isin(*toggles)


def residential(uses: Column, allowed: list[str]) -> Column:
    """Any of a parcel's uses is in the list."""
    return F.coalesce(F.arrays_overlap(uses, F.array(*map(F.lit, allowed))), F.lit(False))


def row_key(kind: str, *parts: Column) -> Column:
    """A key that stays the same from run to run: kind:part|part, a null part being empty."""
    return F.concat(F.lit(f"{kind}:"), F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
