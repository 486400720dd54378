"""Shared helpers: the cluster's shared folder, staged tables, small-side hints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast; counted before the hint is given.
BROADCAST_ROWS = 20_000
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and the session runs on this machine alone, one
    of our own.  A cluster must name one: a folder of one machine is not seen by the others."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="gaugeline-"))
        spark.sparkContext.setCheckpointDir(_own[0])
    return _own[0]


def stage_path(spark: SparkSession, label: str, folder: str | None = None) -> str:
    return f"{(folder or shared_dir(spark)).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, label: str, partition_by: str | None = None, folder: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder (or the one given) and read it again: cuts
    lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = stage_path(spark, label, folder)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; else leave the join to AQE, which
    shuffles and splits skewed keys."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def newest(spark: SparkSession, folder: str, prefix: str) -> tuple[int, str | None]:
    """(number, path) of the finished table in folder named prefix and a number that has the largest; (0, None) without."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(top)] if store.exists(top) else []
    found = [int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    best = max(found, default=0)
    return best, f"{folder.rstrip('/')}/{prefix}{best}" if best else None
