"""Rule evaluators as column expressions: each returns a verdict and why."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TOLERANCE = 2.0
FLOOR_HEIGHT = 3.0
HEIGHT_TOLERANCE = 0.5
PARKING_RATIO = 1.3


def outcome(verdict: str, mode: str = "none", confidence: str = "high") -> Column:
    return F.struct(F.lit(verdict).alias("verdict"), F.lit(mode).alias("failure_mode"), F.lit(confidence).alias("confidence"))


def compare(op: Column, actual: Column, expected: Column) -> Column:
    """Null for an unknown operator."""
    return (
        F.when(op.isin("<=", "≤"), actual <= expected).when(op.isin(">=", "≥"), actual >= expected)
        .when(op == "<", actual < expected).when(op == ">", actual > expected)
        .when(op.isin("==", "="), actual == expected).when(op.isin("!=", "≠"), actual != expected)
    )


def tolerance(pct: Column) -> Column:
    """A missing or zero tolerance is the default."""
    return F.coalesce(F.nullif(pct, F.lit(0.0)), F.lit(DEFAULT_TOLERANCE))


def in_band(actual: Column, edge: Column, pct: Column) -> Column:
    """Within pct percent of the edge; at an edge of zero only equality.  A negative pct is no band at all."""
    return F.when(edge == 0, (actual == 0) & (pct >= 0)).otherwise(F.try_divide(F.abs(actual - edge), F.abs(edge)) * 100 <= pct)


def decorate(passed: Column, near: Column) -> Column:
    """Passes near the edge get a note, failures near it are borderline."""
    return (
        F.when(passed & near, outcome("pass_with_note")).when(passed, outcome("pass"))
        .when(near, outcome("fail_borderline")).otherwise(outcome("fail"))
    )


def nearest_edge(actual: Column, lo: Column, hi: Column) -> Column:
    return F.when(F.abs(actual - lo) <= F.abs(actual - hi), lo).otherwise(hi)


def numeric(actual: Column, op: Column, threshold: Column, text: Column, lo: Column, hi: Column, pct: Column) -> Column:
    """Text-only threshold, missing value, range, missing operator or threshold, comparison, unknown operator: in this order."""
    ranged = lo.isNotNull() & hi.isNotNull()
    tol = tolerance(pct)
    return (
        F.when(threshold.isNull() & text.isNotNull(), outcome("unevaluable", "ambiguous_rule"))
        .when(actual.isNull(), outcome("unevaluable", "missing_data"))
        .when(ranged, decorate(actual.between(lo, hi), in_band(actual, nearest_edge(actual, lo, hi), tol)))
        .when(op.isNull() | threshold.isNull(), outcome("unevaluable", "ambiguous_rule"))
        .when(compare(op, actual, threshold).isNull(), outcome("unevaluable", "ambiguous_rule"))
        .otherwise(decorate(compare(op, actual, threshold), in_band(actual, threshold, tol)))
    )


def presence(documents: Column, key: Column) -> Column:
    """map<string, boolean>: an absent key can't be judged, a present one passes if true."""
    return (
        F.when(~F.map_contains_key(documents, key), outcome("unevaluable", "missing_data"))
        .when(F.coalesce(F.try_element_at(documents, key), F.lit(False)), outcome("pass")).otherwise(outcome("fail"))
    )


def procedural(flags: Column, key: Column, expected: Column, op: Column) -> Column:
    """map<string, string>: text equality (!= turns it round), else truth of the value; a key with a null
    value is present and false."""
    value = F.try_element_at(flags, key)
    equal = F.coalesce(value == expected, F.lit(False))
    true = F.coalesce(~F.lower(value).isin("", "0", "false", "no"), F.lit(False))
    return (
        F.when(~F.map_contains_key(flags, key), outcome("unevaluable", "missing_data"))
        .when(expected.isNotNull(), F.when(F.when(op == "!=", ~equal).otherwise(equal), outcome("pass")).otherwise(outcome("fail")))
        .when(true, outcome("pass")).otherwise(outcome("fail"))
    )


def geometric() -> Column:
    return outcome("unevaluable", "missing_data")


def qualitative() -> Column:
    return outcome("requires_review", "none", "low")


RULE_TYPES = ("numeric", "document_presence", "procedural", "geometric", "qualitative")


def dispatch(rule_type: Column, by_type: dict[str, Column], not_applicable: Column) -> Column:
    """Not-applicable first, then the evaluator of the rule's type; every type must have one."""
    if set(by_type) != set(RULE_TYPES):
        raise ValueError(f"evaluators for {sorted(by_type)}, rule types {sorted(RULE_TYPES)}")
    out = F.when(not_applicable, outcome("not_applicable"))
    for name, expr in by_type.items():
        out = out.when(rule_type == name, expr)
    return out.otherwise(outcome("unevaluable", "engine_error"))


def at_most(actual: Column, cap: Column, pct: Column) -> Column:
    """Content check: no cap, then no value, then the cap with a percent tolerance."""
    over = actual - cap
    return (
        F.when(cap.isNull(), outcome("not_applicable", "NONE")).when(actual.isNull(), outcome("not_submitted", "DOCUMENT_NOT_PROVIDED"))
        .when(actual <= cap, outcome("pass", "NONE")).when(over <= cap * pct / 100, outcome("fail_borderline", "OVERRUN")).otherwise(outcome("fail", "OVERRUN"))
    )


def count_at_most(actual: Column, cap: Column) -> Column:
    return at_most(actual, cap, F.lit(0.0))


def height(heights: Column, cap: Column, floors: Column) -> Column:
    """The largest height against the cap, or floors times FLOOR_HEIGHT, with half a metre of slack."""
    most, limit = F.array_max(heights), F.coalesce(cap, floors * FLOOR_HEIGHT)
    return (
        F.when(limit.isNull(), outcome("not_applicable", "NONE")).when(most.isNull(), outcome("not_submitted", "DOCUMENT_NOT_PROVIDED"))
        .when(most <= limit, outcome("pass", "NONE")).when(most <= limit + HEIGHT_TOLERANCE, outcome("fail_borderline", "OVERRUN")).otherwise(outcome("fail", "OVERRUN"))
    )


def parking(spaces: Column, units: Column, required: Column | None = None) -> Column:
    """Spaces a unit against the given or the baseline ratio."""
    ratio = F.try_divide(spaces, units)
    need = F.coalesce(required, F.lit(PARKING_RATIO)) if required is not None else F.lit(PARKING_RATIO)
    return F.when(ratio.isNull(), outcome("not_submitted", "DOCUMENT_NOT_PROVIDED")).when(ratio >= need, outcome("pass", "NONE")).otherwise(outcome("fail", "UNDERRUN"))


def parking_short(spaces: Column, units: Column, required: float = PARKING_RATIO) -> Column:
    """Spaces that lack for the ratio, rounded; null without units."""
    return F.when(units > 0, F.greatest(F.lit(0), F.round(units * F.lit(required) - spaces).cast("long")))


def split_tiers(count: Column, total: Column, open_: Column, tiers: list[Column]) -> Column:
    """A share against the sum of its tiers' least percents; an open count is a lower bound and asks for review."""
    need = sum((F.coalesce(t, F.lit(0.0)) for t in tiers), F.lit(0.0))
    share = F.try_divide(count.cast("double"), total) * 100
    return (
        F.when(need == 0, outcome("not_applicable", "NONE")).when(share.isNull(), outcome("not_submitted", "DOCUMENT_NOT_PROVIDED")).when(open_, outcome("requires_review", "NONE"))
        .when(share >= need, outcome("pass", "NONE")).otherwise(outcome("fail", "UNDERRUN"))
    )


def attempt(judged: Column, faults: list[tuple[Column, str, Column]]) -> Column:
    """An evaluator's outcome, or the first of its faults (condition, kind, message) that holds: then an engine error,
    with a seed of kind and message.  No other row is touched."""
    parts = lambda o, seed: F.struct(*(o[n].alias(n) for n in ("verdict", "failure_mode", "confidence")), seed.cast("string").alias("seed"))
    error = outcome("unevaluable", "engine_error")
    out = F.when(F.lit(False), parts(error, F.lit(None)))
    for holds, kind, message in faults:
        out = out.when(holds, parts(error, F.concat(F.lit(f"engine_error:{kind}:"), F.substring(message, 1, 200))))
    return out.otherwise(parts(judged, F.lit(None)))


def dispatch_attempts(rule_type: Column, attempts: dict[str, Column]) -> Column:
    """struct(verdict, failure_mode, confidence, fingerprint): each row's attempt by its type; a type without one is an
    ambiguous rule.  Like faults have one fingerprint."""
    fields = lambda o: F.struct(o["verdict"].alias("verdict"), o["failure_mode"].alias("failure_mode"), o["confidence"].alias("confidence"), fingerprint(o["seed"]).alias("fingerprint"))
    lost = outcome("unevaluable", "ambiguous_rule")
    no_one = F.struct(*(lost[n].alias(n) for n in ("verdict", "failure_mode", "confidence")), fingerprint(F.concat(F.lit("dispatch:no_evaluator:"), rule_type)).alias("fingerprint"))
    out = F.when(F.lit(False), no_one)
    for name, tried in attempts.items():
        out = out.when(rule_type == name, fields(tried))
    return out.otherwise(no_one)


def fingerprint(seed: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(seed, 256), 1, 16)


def by_code(rows, keys: list[str], rules: list[tuple[str, str]], per_parcel: dict[str, Column], plan_wide: dict[str, Column], plan: list[str]):
    """(plan, keys, rule_code, verdict, failure_mode) of rules(code, scope): a per-parcel rule gives a row for each of rows by
    its code's handler, a plan-wide one a row for each plan, with null keys, by an aggregate handler; a code without a
    handler of its scope gives one engine error for each plan."""
    lost = [(code, scope) for code, scope in rules if code not in (per_parcel if scope == "per_parcel" else plan_wide)]
    made = lambda code, o: F.struct(F.lit(code).alias("rule_code"), o["verdict"].alias("verdict"), o["failure_mode"].alias("failure_mode"))
    each = [made(code, per_parcel[code]) for code, scope in rules if scope == "per_parcel" and (code, scope) not in lost]
    out = rows.select(*plan, *keys, F.explode(F.array(*each)).alias("r")).select(*plan, *keys, "r.*")
    wide = [made(code, F.col(f"_{code}")) for code, scope in rules if scope != "per_parcel" and (code, scope) not in lost]
    wide += [made(code, outcome("unevaluable", "engine_error")) for code, _ in lost]
    asked = [(code, plan_wide[code]) for code, scope in rules if scope != "per_parcel" and code in plan_wide]
    plans = rows.groupBy(*plan).agg(*(h.alias(f"_{code}") for code, h in asked)) if asked else rows.select(*plan).distinct()
    nulls = [F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys]
    return out.unionByName(plans.select(*plan, *nulls, F.explode(F.array(*wide)).alias("r")).select(*plan, *keys, "r.*")) if wide else out
