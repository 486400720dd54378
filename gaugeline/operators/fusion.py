"""Evidence fusion: one ordered precedence over flags that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Indicator of the evidence -> verdict; anything else asks for review.
INDICATORS = (("compliant", "pass"), ("non_compliant", "fail"), ("requires_review", "requires_review"), ("missing", "not_submitted"), ("deferred_to_dwg", "requires_review"))

#: Wordings of notes that doubt their own pass.
HEDGING_MARKERS = [
    "ראשונית",
    "לא ניתן לאמת",
    "דורש טבלת",
    "אינו כולל",
    "נדרשת השלמה",
    "לא קיימת בהגשה",
    "preliminary",
    "cannot be verified",
]


def mapped(value: Column, pairs, other: str) -> Column:
    table = F.create_map(*[F.lit(x) for p in pairs for x in p])
    return F.coalesce(F.try_element_at(table, F.lower(value)), F.lit(other))


def indicator_verdict(value: Column) -> Column:
    return mapped(value, INDICATORS, "requires_review")


def hedged(verdict: Column, notes: Column, markers: list[str]) -> Column:
    """A pass whose notes carry a marker of doubt."""
    found = F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(F.coalesce(notes, F.lit("")), m))
    return (verdict == "pass") & found


def numeric_pass(verdict: Column, submitted: Column, allowed: Column) -> Column:
    """A pass that its own two numbers bear out."""
    return F.coalesce((verdict == "pass") & (F.try_to_number(submitted, F.lit("999999999.999")) <= F.try_to_number(allowed, F.lit("999999999.999"))), F.lit(False))


def plot_binds(scope: Column, finding: Column, evidence: Column) -> Column:
    """Whether evidence about a plot speaks to a finding about one: any, the same, plan-wide, or unbound."""
    return (
        F.when(scope == "any", F.lit(True)).when(scope == "same", finding == evidence)
        .when(scope == "plan_wide", evidence.isNull()).otherwise(evidence.isNull() | (finding == evidence))
    )


def fuse(rows: DataFrame) -> DataFrame:
    """rows: verdict, hedged, matched, critic, deferred, sure_pass, indicator, confidence.  Adds final_verdict,
    override_source, sidecar (the evidence is reported beside a kept pass) and annotated."""
    c = F.col
    evidence = indicator_verdict(c("indicator"))
    flips = (c("confidence") == "high") & (evidence != c("verdict"))
    step = (
        F.when(~c("matched"), F.when(c("hedged"), "escalate").otherwise("passthrough"))
        .when(c("hedged"), "escalate_annotate")
        .when((c("critic") == "disagree") & c("sure_pass"), "guard_sidecar")
        .when(c("critic") == "disagree", "critic")
        .when(c("deferred"), "deferred")
        .when(flips & c("sure_pass"), "guard_annotate")
        .when(flips, "evidence")
        .otherwise("annotate")
    )
    out = rows.withColumn("step", step)
    s = c("step")
    return out.withColumns({
        "final_verdict": F.when(s.isin("escalate", "escalate_annotate", "critic"), F.lit("requires_review")).when(s == "evidence", evidence).otherwise(c("verdict")),
        "override_source": F.when(s.isin("escalate", "escalate_annotate"), "hedged_reasoning_escalation").when(s == "critic", "m3_critic_disagreement")
        .when(s == "evidence", "m2_finding").when(s == "deferred", "dwg_deferred_annotation").when(s.isin("guard_sidecar", "guard_annotate"), "m2_provenance_suppressed"),
        "sidecar": s.isin("guard_sidecar", "guard_annotate"),
        "annotated": s.isin("escalate_annotate", "deferred", "guard_annotate", "annotate"),
    })
