"""A content-addressed store of expensive results that grows over runs, and manual overrides that win over them.

Entries and overrides are appended as Parquet folders of their own, one a run, so a run that fails leaves nothing half
written, and a reader sees whole runs only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stored(spark: SparkSession, folder: str, kind: str, schema: str) -> DataFrame:
    """All finished runs' rows of a kind, with run, the number of the run that wrote them; none without runs."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}")
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(top)] if store.exists(top) else []
    done = sorted(n for n in names if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}/{n}/_SUCCESS")))
    if not done:
        return spark.createDataFrame([], f"{schema}, run int")
    return spark.read.schema(schema).option("basePath", f"{folder}/{kind}").parquet(*(f"{folder}/{kind}/{n}" for n in done)).withColumn("run", F.regexp_extract("_metadata.file_path", r"/run-(\d+)/", 1).cast("int"))


def append(rows: DataFrame, folder: str, kind: str, run: int) -> None:
    rows.write.mode("errorifexists").parquet(f"{folder}/{kind}/run-{run:06d}")


def get_or_compute(wanted: DataFrame, folder: str, run: int, compute: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """The result of each distinct key of wanted(key, payload); compute gets the (key, payload) rows that the store
    lacks, one a key, and returns schema ("key string, ..."), which is stored before it is read.

    Returned: schema, run (when it was computed) and overridden.  An override replaces the entry's columns for good."""
    spark = wanted.sparkSession
    have = stored(spark, folder, "entries", schema)
    lack = wanted.where("key is not null").join(have.select("key"), "key", "left_anti")
    append(compute(lack.groupBy("key").agg(F.min("payload").alias("payload"))), folder, "entries", run)
    entries = stored(spark, folder, "entries", schema).join(wanted.select("key").distinct(), "key", "left_semi")
    return with_overrides(entries, spark, folder, schema)


def with_overrides(entries: DataFrame, spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Entries, the latest override in the place of what was computed."""
    rest = [c for c in entries.columns if c not in ("key", "run")]
    own = stored(spark, folder, "overrides", f"{schema}, note string")
    last = own.groupBy("key").agg(F.max(F.struct("run", F.struct(*rest).alias("new"))).alias("o")).select("key", F.col("o.new").alias("new"))
    both = entries.join(last, "key", "left")
    pick = [F.when(F.col("new").isNotNull(), F.col("new")[c]).otherwise(F.col(c)).alias(c) for c in rest]
    return both.select("key", *pick, "run", F.col("new").isNotNull().alias("overridden"))


def override(new: DataFrame, folder: str, run: int, schema: str) -> None:
    """Store new(schema, note) as authoritative from now on; a key that has no entry is refused."""
    spark = new.sparkSession
    lost = new.join(stored(spark, folder, "entries", schema).select("key"), "key", "left_anti").limit(3).collect()
    if lost:
        raise KeyError(f"no cache entry for {[r.key for r in lost]}")
    append(new, folder, "overrides", run)
