"""Where results go: verdict rows by run, run lifecycle, canonical documents, archived overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators.dedup import first_by


def append_verdicts(rows: DataFrame, path: str) -> None:
    """Append a run's rows; runs are directories, so one can be read or dropped alone."""
    rows.write.mode("append").partitionBy("engine_run_id").parquet(path)


def read_run(spark: SparkSession, path: str, run: str) -> DataFrame:
    """A run's rows in rule order with defaults for missing modes; only its directory is read."""
    rows = spark.read.parquet(path).where(F.col("engine_run_id") == run)
    return rows.withColumns({"failure_mode": F.coalesce("failure_mode", F.lit("none")), "confidence": F.coalesce("confidence", F.lit("high"))}).orderBy("rule_id", F.col("parcel_id").asc_nulls_first())


def log_run(spark: SparkSession, path: str, run: str, status: str, at: str) -> None:
    """Append-only lifecycle log: running, then complete or failed."""
    spark.createDataFrame([(run, status, at)], "engine_run_id string, status string, at string").write.mode("append").json(path)


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    log = spark.read.schema("engine_run_id string, status string, at string").json(path)
    return first_by(log, ["engine_run_id"], [F.col("at").desc(), (F.col("status") == "running").cast("int").asc()])


def canonical_json(rows: DataFrame, path: str, order: list[str], most: int = 1_000_000) -> None:
    """One document with sorted columns and rows: the same rows give the same bytes.  For reports: one file is one task's,
    so a table of more than most rows is refused."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows for one document")
    rows.select(sorted(rows.columns)).orderBy(*order).coalesce(1).write.mode("overwrite").json(path)


def archive_then_replace(rows: DataFrame, path: str, stamp: str) -> str:
    """Write rows under path/<stamp>; the newest stamp is current, older ones stay."""
    out = f"{path.rstrip('/')}/{stamp}"
    rows.write.mode("errorifexists").parquet(out)
    return out


def versions(spark: SparkSession, path: str) -> list[str]:
    """The finished versions of a table that replace_whole() writes, oldest first."""
    top = spark._jvm.org.apache.hadoop.fs.Path
    store = top(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(top(path))] if store.exists(top(path)) else []
    return sorted(n for n in names if n.startswith("v-") and store.exists(top(f"{path}/{n}/_SUCCESS")))


def replace_whole(rows: DataFrame, path: str, keep: int = 2) -> None:
    """Replace the table at path by a new version beside the old ones.  A version counts once it is whole, so a reader
    finds the old or the new table, never a part or none; all but the newest `keep` go."""
    spark = rows.sparkSession
    have = versions(spark, path)
    n = int(have[-1].removeprefix("v-")) + 1 if have else 1
    rows.write.mode("overwrite").parquet(f"{path}/v-{n:09d}")
    for old in versions(spark, path)[:-keep]:
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{old}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of the table at path."""
    return spark.read.parquet(f"{path}/{versions(spark, path)[-1]}")


def evaluate_run(rows: DataFrame, verdicts: str, log: str, run: str, at: str) -> DataFrame:
    """One run from open to close: logged as running, its rows appended, summarised by verdict, logged as complete; a
    run that fails is logged as failed before its error goes on."""
    spark = rows.sparkSession
    log_run(spark, log, run, "running", at)
    try:
        append_verdicts(rows.withColumn("engine_run_id", F.lit(run)), verdicts)
        summary = read_run(spark, verdicts, run).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    except Exception:
        log_run(spark, log, run, "failed", at)
        raise
    log_run(spark, log, run, "complete", at)
    return summary
