"""Sinks, optional sources and page checks."""

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import pages, resolution, sinks
from gaugeline.operators.dedup import last_wins
from gaugeline.operators.merging import compared
from gaugeline.sources import tables


def test_runs_append_and_read_alone(spark, tmp_path):
    path = str(tmp_path / "verdicts")
    ddl = "engine_run_id string, parcel_id string, rule_id string, verdict string, failure_mode string, confidence string"
    sinks.append_verdicts(spark.createDataFrame([("a", "p1", "r2", "pass", None, None), ("a", None, "r1", "fail", "engine_error", "low")], ddl), path)
    sinks.append_verdicts(spark.createDataFrame([("b", "p1", "r1", "pass", None, None)], ddl), path)
    got = [(r.rule_id, r.failure_mode, r.confidence) for r in sinks.read_run(spark, path, "a").collect()]
    assert got == [("r1", "engine_error", "low"), ("r2", "none", "high")]


def test_lifecycle_log_keeps_the_last_state(spark, tmp_path):
    path = str(tmp_path / "log")
    for run, status, at in [("a", "running", "1"), ("a", "complete", "2"), ("b", "running", "1"), ("c", "running", "1"), ("c", "failed", "1")]:
        sinks.log_run(spark, path, run, status, at)
    assert {r.engine_run_id: r.status for r in sinks.latest_state(spark, path).collect()} == {"a": "complete", "b": "running", "c": "failed"}


def test_canonical_bytes(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    texts = []
    for i, d in enumerate([rows, rows.orderBy("k").select("v", "k")]):
        sinks.canonical_json(d, str(tmp_path / str(i)), ["k"])
        texts.append("".join(p.read_text() for p in sorted((tmp_path / str(i)).glob("part-*"))))
    assert texts[0] == texts[1] == '{"k":1,"v":"a"}\n{"k":2,"v":"b"}\n'
    old = sinks.archive_then_replace(rows, str(tmp_path / "over"), "20240101")
    assert spark.read.parquet(old).count() == 2


def test_expensive_calls_run_once_per_value(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "i int, v string")
    got = pages.once_per_value(rows, "v", "v string, n int", lambda it: (p.assign(n=len(p)) for p in it))
    assert got.count() == 10 and got.where("n is null").count() == 0
    cache = spark.createDataFrame([("a",)], "v string")
    assert [r.v for r in pages.cache_misses(rows, cache, "v").collect()] == ["b"]


def test_findings_of_manual_files_are_left_out(spark, tmp_path):
    (tmp_path / "x-findings.json").write_text('{"extracted_by": "auto-1", "cases": [{"id": 1}, {"id": 2}]}')
    (tmp_path / "y-findings.json").write_text('{"extracted_by": "manual-9", "cases": [{"id": 3}]}')
    got = tables.findings(spark, str(tmp_path / "*-findings.json"), "extracted_by string, cases array<struct<id: int>>")
    assert sorted((r.file_name, r.case.id) for r in got.collect()) == [("x-findings.json", 1), ("x-findings.json", 2)]


def test_extras_never_override_columns(spark):
    rows = spark.createDataFrame([(None, {"op": "x", "note": "n"})], "op string, extras map<string, string>")
    got = rows.select(*(c.alias(n) for n, c in resolution.extra_params({"op": F.col("op")}, F.col("extras")).items())).first()
    assert got.op is None and got.extras == {"note": "n"}


def test_last_wins_and_comparison(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, seq int, v string")
    assert sorted((r.k, r.v) for r in last_wins(rows, ["k"], "seq").collect()) == [("a", "y"), ("b", "z")]
    cases = spark.createDataFrame([("fail", "pass", True), ("fail", "fail", True), ("fail", "fail", False), ("pass", None, True), ("pass", "pass", False)], "b string, a string, r boolean")
    assert [r[0] for r in cases.select(compared(F.col("b"), F.col("a"), F.col("r"))).collect()] == ["fixed", "needs fix", "unchanged", "unclear", "unchanged"]


def test_a_run_from_open_to_close(spark, tmp_path):
    ddl = "parcel_id string, rule_id string, verdict string, failure_mode string, confidence string"
    rows = spark.createDataFrame([("p1", "r1", "pass", None, None), ("p1", "r2", "fail", None, "low"), ("p2", "r1", "pass", None, None)], ddl)
    verdicts, log = str(tmp_path / "v"), str(tmp_path / "l")
    got = {r.verdict: r.n for r in sinks.evaluate_run(rows, verdicts, log, "one", "1").collect()}
    assert got == {"pass": 2, "fail": 1}
    with pytest.raises(Exception, match="nonsense"):
        sinks.evaluate_run(rows.withColumn("verdict", F.raise_error(F.lit("nonsense"))), verdicts, log, "two", "2")
    assert {r.engine_run_id: r.status for r in sinks.latest_state(spark, log).collect()} == {"one": "complete", "two": "failed"}


def test_a_table_is_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for n in (3, 5, 7):
        sinks.replace_whole(spark.range(n), path)
        assert sinks.current(spark, path).count() == n
    (tmp_path / "t" / "v-000000009").mkdir()  # a version that was cut short
    assert sinks.current(spark, path).count() == 7 and sinks.versions(spark, path) == ["v-000000002", "v-000000003"]
    sinks.replace_whole(spark.range(2), path)
    assert sinks.current(spark, path).count() == 2


def test_a_document_is_bounded(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.canonical_json(spark.range(11), str(tmp_path / "d"), ["id"], most=10)


def test_responses_find_their_columns(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Note, STATUS,Row Id\nfine,ok,7\n,bad, \nx,,9\n")
    wanted = {"id": ["row id", "id"], "status": ["status"], "note": ["note", "remark"], "who": ["who"]}
    got = [tuple(r) for r in tables.responses(spark, str(tmp_path / "r.csv"), wanted, "id", {"status"}).collect()]
    assert got == [("7", "ok", "fine", None), ("9", None, "x", None)]
