"""Sinks and file sources, each written to the shared folder and read back, bound to the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators import sinks
from gaugeline.plans.evaluation import JUDGED_SQL, judged
from gaugeline.plans.registry import query
from gaugeline.sources import tables as S
from gaugeline.sources.staging import shared_dir
from gaugeline.sources.tables import table


def folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


@query(f"WITH {JUDGED_SQL} SELECT entity AS parcel_id, rule_id, verdict, failure_mode, 'high' AS confidence, 'complete' AS status FROM verdicts")
def persisted_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs appended, the second read back alone, in order, with defaults, and with its state from the log."""
    path, log = folder(spark, "verdicts"), folder(spark, "log")
    rows = judged(spark, sf_dir).select(F.col("entity").alias("parcel_id"), "rule_id", "o.verdict", F.nullif(F.col("o.failure_mode"), F.lit("none")).alias("failure_mode"), F.lit(None).cast("string").alias("confidence"))
    sinks.evaluate_run(rows.where("parcel_id < 3"), path, log, "first", "2024-01-01")
    sinks.evaluate_run(rows, path, log, "second", "2024-01-02")
    state = F.broadcast(sinks.latest_state(spark, log).where("engine_run_id = 'second'").select("engine_run_id", "status"))  # one row
    return sinks.read_run(spark, path, "second").join(state, "engine_run_id").select("parcel_id", "rule_id", "verdict", "failure_mode", "confidence", "status")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 1")
def replaced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table replaced as a whole, and an archive of which the newest stamp counts."""
    path, archive = folder(spark, "table"), folder(spark, "archive")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    for odd in (0, 1):
        sinks.replace_whole(c.where(f"c_custkey % 2 = {odd}"), path)
        newest = sinks.archive_then_replace(sinks.current(spark, path), archive, f"2024-01-0{odd + 1}")
    return spark.read.parquet(newest)


DOC = "id string, title string, extracted_by string, cases array<struct<case_id: string, findings: array<string>>>"


@query("""SELECT 's' || CAST(s_suppkey AS VARCHAR) AS id, s_name AS title, 'c' || CAST(s_suppkey % 5 AS VARCHAR) AS case_id, f.finding FROM supplier CROSS JOIN (VALUES ('a'), ('b')) f(finding) WHERE s_suppkey % 4 <> 0""")
def findings_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case files written as JSON and read back without those a person made; cases and findings unfolded."""
    path, s = folder(spark, "cases"), F.col("s_suppkey")
    case = F.struct(F.concat(F.lit("c"), (s % 5).cast("string")).alias("case_id"), F.array(F.lit("a"), F.lit("b")).alias("findings"))
    docs = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), s.cast("string")).alias("id"), F.col("s_name").alias("title"), F.when(s % 4 == 0, "manual-review").otherwise("model").alias("extracted_by"), F.array(case).alias("cases"))
    docs.write.json(path)
    got = spark.read.schema(DOC).json(path)
    return S.unfolded(got).select("id", "title", F.col("case.case_id").alias("case_id"), F.explode("case.findings").alias("finding"))


@query("""SELECT n_nationkey AS k, n_name AS name, CAST(NULL AS VARCHAR) AS extra, true AS found FROM nation""")
def commented_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON with // comment lines, one document a file, beside an overlay that isn't there."""
    path = folder(spark, "commented")
    n = table(spark, sf_dir, "nation")
    text = F.concat(F.lit('// a comment\n{"k": '), F.col("n_nationkey").cast("string"), F.lit(',\n  // another\n"name": "'), F.col("n_name"), F.lit('"}\n'))
    n.select(text.alias("value"), "n_nationkey").repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    docs = S.json_documents(spark, f"{path}/*", "k int, name string")
    none = S.overlay_or_empty(spark, f"{path}/no-such-file.json", "k int, extra string")
    return docs.select("doc.k", "doc.name").join(none, "k", "left").select("k", "name", "extra", F.col("name").isNotNull().alias("found"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS status, CAST(NULL AS VARCHAR) AS who FROM customer WHERE c_custkey % 6 <> 0""")
def responses_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in a table whose columns stand in another order under other names; rows without a key go."""
    path, k = folder(spark, "responses"), F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("STATUS"), F.when(k % 6 == 0, "  ").otherwise(k.cast("string")).alias("Row Id"))
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return S.responses(spark, path, {"id": ["row id", "id"], "status": ["status"], "who": ["who"]}, "id", {"status"})


@query("""SELECT r_regionkey AS k, r_name AS name FROM region""")
def canonical_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded report as one canonical document, read back."""
    path = folder(spark, "canonical")
    sinks.canonical_json(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), path, ["k"])
    return spark.read.schema("k int, name string").json(path)
