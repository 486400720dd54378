"""Classifying drawing layers, dimensions and pages; worldfiles and spreadsheet headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def layer_role(name: Column, exact: dict[str, str], prefixes: list[tuple[str, str]], patterns: list[tuple[str, str]]) -> Column:
    """Exact name, then case-blind name, then prefix, then pattern; else UNKNOWN."""
    table = F.create_map(*[F.lit(x) for p in exact.items() for x in p])
    folded = F.create_map(*[F.lit(x) for k, v in exact.items() for x in (k.lower(), v)])
    out = F.coalesce(F.try_element_at(table, name), F.try_element_at(folded, F.lower(name)))
    rest = F.when(F.lit(False), F.lit(""))
    for prefix, role in prefixes:
        rest = rest.when(F.startswith(F.upper(name), F.lit(prefix.upper())), role)
    for pattern, role in patterns:
        rest = rest.when(name.rlike(pattern), role)
    return F.coalesce(out, rest, F.lit("UNKNOWN"))


def dimension_kinds(value: Column, context: Column) -> Column:
    """0 to 2 kinds of a height: basement before ground before top, a wide fallback last; a context
    that names two levels ("ground/top") gives both."""
    low = F.lower(F.coalesce(context, F.lit("")))
    one = lambda c: (
        F.when(F.contains(c, F.lit("basement")) | (value < 0), "BASEMENT").when(F.contains(c, F.lit("ground")), "GROUND_REFERENCE")
        .when(F.contains(c, F.lit("top")) | F.contains(c, F.lit("roof")), "TRUE_BUILDING_TOP").when(value.between(35, 100), "INTERMEDIATE_LEVEL")
    )
    return F.filter(F.array_distinct(F.transform(F.slice(F.split(low, "/"), 1, 2), one)), lambda k: k.isNotNull())


def page_coverage(requested: Column, found: Column) -> Column:
    """All of the wanted categories found, some, or none."""
    missing = F.size(F.array_except(requested, found))
    return F.when(missing == 0, "FULL").when(F.arrays_overlap(requested, found), "PARTIAL").otherwise("UNADDRESSED")


def worldfile(text: Column) -> Column:
    """Six lines of an image's worldfile: pixel sizes, rotations and the upper left corner."""
    names = ("x_size", "y_rotation", "x_rotation", "y_size", "x", "y")
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda v: F.trim(v)), lambda v: v != "")
    return F.when(F.size(lines) >= 6, F.struct(*(F.element_at(lines, i + 1).try_cast("double").alias(n) for i, n in enumerate(names))))


def outside_bounds(points: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Whether most of the sample points lie outside the bounds."""
    out = F.size(F.filter(points, lambda p: ~(p["x"].between(x0, x1) & p["y"].between(y0, y1))))
    return 2 * out > F.size(points)


def resolved_headers(columns: list[str], wanted: dict[str, list[str]], critical: set[str]) -> dict[str, str]:
    """Wanted name -> column, found by any of its spellings wherever it stands; critical ones must be there."""
    folded = {c.strip().lower(): c for c in columns}
    got = {n: folded[s] for n, spellings in wanted.items() for s in reversed([x.lower() for x in spellings]) if s in folded}
    if lost := critical - set(got):
        raise ValueError(f"columns missing: {sorted(lost)}")
    return got
