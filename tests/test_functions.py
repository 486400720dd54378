"""Evaluators and helpers on boundary values."""

import pytest
from pyspark.sql import functions as F

from gaugeline.functions import drawing as D
from gaugeline.functions import text as X
from gaugeline.functions import verdicts as V
from gaugeline.operators import fusion, merging
from gaugeline.sources import tables


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("actual", "op", "threshold", "text", "lo", "hi", "tol", "want"),
    [
        (50.0, "<=", 50.0, None, None, None, None, "pass_with_note"),
        (51.0, "<=", 50.0, None, None, None, 2.0, "fail_borderline"),
        (51.01, "<=", 50.0, None, None, None, 0.0, "fail"),
        (10.0, "≥", 5.0, None, None, None, None, "pass"),
        (0.0, "=", 0.0, None, None, None, None, "pass_with_note"),
        (None, "<=", 50.0, None, None, None, None, "unevaluable"),
        (1.0, None, None, "see plan", None, None, None, "unevaluable"),
        (1.0, "~", 1.0, None, None, None, None, "unevaluable"),
        (7.5, None, None, None, 5.0, 10.0, None, "pass"),
        (10.1, None, None, None, 5.0, 10.0, None, "fail_borderline"),
    ],
)
def test_numeric(spark, actual, op, threshold, text, lo, hi, tol, want):
    d = [F.lit(v).cast(t) for v, t in zip((actual, op, threshold, text, lo, hi, tol), ("double", "string", "double", "string", "double", "double", "double"), strict=True)]
    assert one(spark, V.numeric(*d)["verdict"]) == want


def test_absent_key_is_not_a_null_value(spark):
    m = F.create_map(F.lit("a"), F.lit(None).cast("string"))
    assert one(spark, V.procedural(m, F.lit("a"), F.lit(None).cast("string"), F.lit(None))["verdict"]) == "fail"
    assert one(spark, V.procedural(m, F.lit("b"), F.lit(None).cast("string"), F.lit(None))["verdict"]) == "unevaluable"


def test_every_rule_type_has_an_evaluator():
    with pytest.raises(ValueError, match="evaluators"):
        V.dispatch(F.lit("x"), {"numeric": F.lit(1)}, F.lit(False))


@pytest.mark.parametrize(("value", "cap", "want"), [(5000, 5000, "pass"), (5100, 5000, "fail_borderline"), (5500, 5000, "fail"), (None, 5000, "not_submitted"), (1, None, "not_applicable")])
def test_content_cap(spark, value, cap, want):
    assert one(spark, V.at_most(F.lit(value).cast("double"), F.lit(cap).cast("double"), F.lit(2.0))["verdict"]) == want


def test_heights(spark):
    h = lambda v: one(spark, V.height(F.array(F.lit(v)), F.lit(30.0), F.lit(None).cast("int"))["verdict"])
    assert (h(30.0), h(30.4), h(31.5)) == ("pass", "fail_borderline", "fail")


def test_strings(spark):
    assert one(spark, X.next_revision(F.lit("v9"))) == "v10" and one(spark, X.next_revision(F.lit("a"))) == "a-r2"
    assert one(spark, X.canonical_version(F.lit("../x"))) is None
    assert one(spark, X.section_key(F.lit("2.10"))) == [2, 10]
    assert one(spark, X.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0
    assert one(spark, X.without_qualifiers(F.lit("Shade trees (new) - north, east"))) == "Shade trees"
    for dash in "-–—":
        assert one(spark, X.without_qualifiers(F.lit(f"קו בניין {dash} קדמי"))) == "קו בניין"
    assert one(spark, X.without_qualifiers(F.lit("well-lit yard, north"))) == "well-lit yard"
    assert one(spark, X.squashed(F.lit("קו–בניין (קדמי).\u00a0א"))) == "קובנייןקדמיא" and one(spark, X.squashed(F.lit(" - ()"))) is None
    assert one(spark, X.tokens(F.lit("קו בניין/קדמי,(א) קו"))) == ["קו", "בניין", "קדמי", "א"]
    assert one(spark, X.capped(F.lit("x" * 300))) == "x" * 197 + "..."
    assert one(spark, X.appended(F.lit(" "), F.lit("b"))) == "b"
    assert one(spark, X.iso_date(F.lit("3/7/2024"))).isoformat() == "2024-07-03"


def test_fusion_ladder(spark):
    rows = spark.createDataFrame(
        [("pass", True, True, "agree", False, True, "compliant", "high"), ("pass", False, True, "disagree", False, True, "x", "low"), ("fail", False, True, "agree", False, False, "compliant", "high"), ("pass", False, False, None, False, False, None, None)],
        "verdict string, hedged boolean, matched boolean, critic string, deferred boolean, sure_pass boolean, indicator string, confidence string",
    )
    got = [(r.final_verdict, r.override_source, r.sidecar, r.annotated) for r in fusion.fuse(rows).collect()]
    assert got == [("requires_review", "hedged_reasoning_escalation", False, True), ("pass", "m2_provenance_suppressed", True, False), ("pass", "m2_finding", False, False), ("pass", None, False, False)]


def test_overlay_keeps_nulls_out(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    over = spark.createDataFrame([(1, None), (2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, merging.overlay(base, over, "k", ["v"]).collect())) == [(1, "a"), (2, "c")]


def test_commented_json_and_missing_overlay(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n // note\n "a": 1\n}')
    assert tables.json_documents(spark, str(tmp_path / "a.json"), "a int").first().doc.a == 1
    assert tables.overlay_or_empty(spark, str(tmp_path / "none.json"), "a int").count() == 0


def test_more_strings(spark):
    assert one(spark, X.terse(F.lit("Too high; see plan"))) == "Too high" and one(spark, X.terse(F.lit("x" * 200 + ". y"))) == "x" * 120
    assert one(spark, X.compound_plots(F.lit("3+4, 5"))) == [3, 4, 5] and one(spark, X.compound_plots(F.lit("3+a"))) is None
    assert one(spark, X.self_evident(F.lit("Plot 7"), ["plot"])) is True and one(spark, X.self_evident(F.lit(""), ["plot"])) is False
    assert one(spark, X.decision_basis(F.lit("approved"), F.lit(2))) == "conditional"
    assert one(spark, X.score([(F.lit(True), 0.7), (F.lit(True), 0.6), (F.lit(None).cast("boolean"), 0.5)])) == 1.0
    assert one(spark, X.without_suffixes(F.lit("Cohen Architects Ltd."), ["Ltd", "Architects"])) == "Cohen" and one(spark, X.without_suffixes(F.lit("Ltd"), ["Ltd"])) == "Ltd"
    assert one(spark, X.percent_delta(F.lit(3), F.lit(2))) == 50.0 and one(spark, X.percent_delta(F.lit(3), F.lit(0))) is None


def test_drawings(spark):
    role = lambda n: one(spark, D.layer_role(F.lit(n), {"RZ_AREA": "PLOT_BOUNDARY"}, [("park", "PARKING")], [("(?i)setback", "SETBACK_LINE")]))
    assert [role(n) for n in ("RZ_AREA", "rz_area", "Parking-1", "my SETBACK", "x")] == ["PLOT_BOUNDARY", "PLOT_BOUNDARY", "PARKING", "SETBACK_LINE", "UNKNOWN"]
    assert one(spark, D.dimension_kinds(F.lit(41.0), F.lit("ground/top"))) == ["GROUND_REFERENCE", "TRUE_BUILDING_TOP"]
    assert one(spark, D.dimension_kinds(F.lit(1.0), F.lit(None).cast("string"))) == []
    cover = lambda f: one(spark, D.page_coverage(F.array(F.lit("a"), F.lit("b")), F.array(*map(F.lit, f)).cast("array<string>")))
    assert [cover(f) for f in (["a", "b"], ["b"], ["c"])] == ["FULL", "PARTIAL", "UNADDRESSED"]
    assert one(spark, D.worldfile(F.lit("0.5\n0\n0\n-0.5\n100\n200\n"))).x == 100.0 and one(spark, D.worldfile(F.lit("1"))) is None
    points = F.array(*(F.struct(F.lit(float(v)).alias("x"), F.lit(1.0).alias("y")) for v in (1, 50, 60)))
    assert one(spark, D.outside_bounds(points, 0, 0, 10, 10)) is True
    assert D.resolved_headers([" Status ", "ID"], {"id": ["id"], "status": ["state", "status"]}, {"id"}) == {"id": "ID", "status": " Status "}
    with pytest.raises(ValueError, match="missing"):
        D.resolved_headers(["x"], {"id": ["id"]}, {"id"})
